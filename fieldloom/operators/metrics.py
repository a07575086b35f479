"""Scores of predictions. A prediction has (adm, harv_year, yield, y_pred, y_bench) and, for several runs, run_id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _squared(a: Column, b: Column) -> Column:
    return (a - b) * (a - b)


def errors(df: DataFrame, by: Sequence[str] = (), y: str = "yield", pred: str = "y_pred") -> DataFrame:
    """(by, n, mse, rmse) over rows with both values."""
    e = _squared(F.col(y), F.col(pred))
    return df.groupBy(*by).agg(F.count(e).alias("n"), F.avg(e).alias("mse"), F.sqrt(F.avg(e)).alias("rmse"))


def loo_mean(df: DataFrame, group: Sequence[str], y: str = "yield", out: str = "loo_mean") -> DataFrame:
    """Mean of the group's other rows; null in a group of one. Skips null yields."""
    w = W.partitionBy(*group)
    own = F.coalesce(F.col(y), F.lit(0.0))
    n = F.count(y).over(w) - F.when(F.col(y).isNotNull(), 1).otherwise(0)
    return df.withColumn(out, F.when(n > 0, (F.sum(y).over(w) - own) / n))


def _relative(y: Column, pred: Column, bench: Column) -> Column:
    """1 - sum of squared errors / the same of the benchmark, over rows that have all three."""
    ok = y.isNotNull() & pred.isNotNull() & bench.isNotNull()
    return 1 - F.try_divide(F.sum(F.when(ok, _squared(y, pred))), F.sum(F.when(ok, _squared(y, bench))))


def r2_loo(df: DataFrame, group: Sequence[str], y: str = "yield", pred: str = "y_pred") -> DataFrame:
    """(group, r2) against each row's mean of the group's other rows."""
    rows = loo_mean(df, group, y, "__mean")
    return rows.groupBy(*group).agg(_relative(F.col(y), F.col(pred), F.col("__mean")).alias("r2"))


def brr2(df: DataFrame, by: Sequence[str] = (), bench: str = "y_bench", y: str = "yield", pred: str = "y_pred") -> DataFrame:
    """(by, brr2): R squared relative to a benchmark column."""
    return df.groupBy(*by).agg(_relative(F.col(y), F.col(pred), F.col(bench)).alias("brr2"))


def nse(df: DataFrame, group: Sequence[str], reference: str = "variance", y: str = "yield", pred: str = "y_pred") -> DataFrame:
    """(group, mse, nse): 1 - mse / population variance, or / the mean square of y with ``reference="square"``."""
    e = F.avg(_squared(F.col(y), F.col(pred)))
    base = F.var_pop(y) if reference == "variance" else F.avg(F.col(y) * F.col(y))
    return df.groupBy(*group).agg(e.alias("mse"), (1 - F.try_divide(e, base)).alias("nse"))


def region_performance(df: DataFrame, benchmark: DataFrame | None = None, min_rows: int = 3, group: Sequence[str] = ("country", "adm")) -> DataFrame:
    """(group, n, rmse, r2, brr2) of regions with ``min_rows`` or more; the benchmark is joined where ``df`` lacks it."""
    if "y_bench" not in df.columns:
        df = df.join(benchmark.select("adm", "harv_year", "y_bench"), ["adm", "harv_year"], "left")
    y, p = F.col("yield"), F.col("y_pred")
    rows = loo_mean(df, group, "yield", "__mean").groupBy(*group)
    out = rows.agg(F.count("*").alias("n"), F.sqrt(F.avg(_squared(y, p))).alias("rmse"), _relative(y, p, F.col("__mean")).alias("r2"), _relative(y, p, F.col("y_bench")).alias("brr2"))
    return out.where(F.col("n") >= min_rows)


def run_performance(df: DataFrame, group: Sequence[str] = ("country", "adm1", "adm2")) -> DataFrame:
    """(group, avg_opt_trials, avg_train_mse, mse, nse), as a run writes them."""
    e = F.avg(_squared(F.col("yield"), F.col("y_pred")))
    return df.groupBy(*group).agg(
        F.avg("n_opt_trials").alias("avg_opt_trials"), F.avg("train_mse").alias("avg_train_mse"), e.alias("mse"), (1 - F.try_divide(e, F.var_pop("yield"))).alias("nse")
    )


def compare_runs(df: DataFrame, expected_rows: int, runtimes: DataFrame | None = None, digits: int = 2) -> DataFrame:
    """(run_id, n, rmse, r2, brr2[, hours, avg_trials]) rounded, of the runs that have predicted every row.

    R squared is against the mean of each region's other years.
    """
    rows = loo_mean(df, ["run_id", "adm"], "yield", "__mean").groupBy("run_id")
    y, p = F.col("yield"), F.col("y_pred")
    out = rows.agg(F.count(p).alias("n"), F.sqrt(F.avg(_squared(y, p))).alias("rmse"), _relative(y, p, F.col("__mean")).alias("r2"), _relative(y, p, F.col("y_bench")).alias("brr2"))
    out = out.where(F.col("n") == expected_rows)
    if runtimes is not None:
        out = out.join(runtimes, "run_id", "left").withColumns({"hours": F.round("hours", digits), "avg_trials": F.round("avg_trials", digits)})
    return out.withColumns({c: F.round(c, digits) for c in ("rmse", "r2", "brr2")})


def regions_above(df: DataFrame, levels: Sequence[float] = (0.0, 0.3)) -> DataFrame:
    """(run_id, avg_r2, one count for each level): regions whose R squared exceeds it."""
    per = loo_mean(df, ["run_id", "adm"], "yield", "__mean").groupBy("run_id", "adm").agg(_relative(F.col("yield"), F.col("y_pred"), F.col("__mean")).alias("r2"))
    return per.groupBy("run_id").agg(F.avg("r2").alias("avg_r2"), *[F.count_if(F.col("r2") > x).alias(f"above_{str(x).replace('.', '_')}") for x in levels])


def study_runtime(trials: DataFrame, studies: DataFrame | None = None) -> DataFrame:
    """(run_id, study, seconds, trials): summed durations where trials ran one after another, else last end - first start.

    ``studies`` (run_id, study) adds those without trials, with zeros.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    duration = (micros("t_complete") - micros("t_start")) / 1e6
    whole = (F.max(F.struct("trial", micros("t_complete").alias("t")))["t"] - F.min(F.struct("trial", micros("t_start").alias("t")))["t"]) / 1e6
    out = trials.groupBy("run_id", "study").agg(F.when(F.max("sequential"), F.sum(duration)).otherwise(whole).alias("seconds"), F.count("*").alias("trials"))
    if studies is not None:
        out = studies.select("run_id", "study").distinct().join(out, ["run_id", "study"], "left")
    return out.select("run_id", "study", F.coalesce("seconds", F.lit(0.0)).alias("seconds"), F.coalesce("trials", F.lit(0)).alias("trials"))


def run_runtime(per_study: DataFrame) -> DataFrame:
    """(run_id, hours, avg_trials)."""
    return per_study.groupBy("run_id").agg((F.sum("seconds") / 3600).alias("hours"), F.avg("trials").alias("avg_trials"))


def squared_error_summary(df: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """(by, n, mean, q1, median, q3, low, high) of squared errors; whiskers are the extremes within 1.5 interquartile ranges."""
    e = df.where(F.col("yield").isNotNull() & F.col("y_pred").isNotNull()).withColumn("__e", _squared(F.col("yield"), F.col("y_pred")))
    stats = e.groupBy(*by).agg(F.count("*").alias("n"), F.avg("__e").alias("mean"), F.percentile("__e", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    stats = stats.select(*by, "n", "mean", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = e.select(*by, "__e").join(stats, list(by)).where(F.col("__e").between(F.col("q1") - reach, F.col("q3") + reach))
    return stats.join(inside.groupBy(*by).agg(F.min("__e").alias("low"), F.max("__e").alias("high")), list(by))


def best_of_family(summary: DataFrame, family: Column) -> DataFrame:
    """(family, best_mean): the smallest mean error among the runs of each model family."""
    return summary.groupBy(family.alias("family")).agg(F.min("mean").alias("best_mean"))


def error_by_year(df: DataFrame, country: str) -> DataFrame:
    """(harv_year, mse, bench_mse) in one country."""
    rows = df.where(F.col("country") == country).groupBy("harv_year")
    return rows.agg(F.avg(_squared(F.col("yield"), F.col("y_pred"))).alias("mse"), F.avg(_squared(F.col("yield"), F.col("y_bench"))).alias("bench_mse"))


def shortfall(df: DataFrame, base_years: Sequence[int], event_year: int, key: str = "adm") -> DataFrame:
    """(key, actual, predicted, both_short): the event year's values relative to the mean of the base years."""
    base = F.col("harv_year").isin(*base_years)
    ratio = lambda c: F.try_divide(F.avg(F.when(F.col("harv_year") == event_year, F.col(c))), F.avg(F.when(base, F.col(c))))
    out = df.groupBy(key).agg(ratio("yield").alias("actual"), ratio("y_pred").alias("predicted"))
    return out.withColumn("both_short", (F.col("actual") < 1) & (F.col("predicted") < 1))


def fold_metrics(df: DataFrame, fold: Sequence[str] = ("split", "year_out")) -> DataFrame:
    """(fold, train_mse, train_r2, test_mse, test_r2, n_opt_trials) of rows with a ``role``; test R squared needs over 3 rows.

    R squared is against the mean of the fold's other rows of the same role.
    """
    rows = loo_mean(df, [*fold, "role"], "yield", "__mean").groupBy(*fold)
    out = []
    for role in ("train", "test"):
        own = lambda c: F.when(F.col("role") == role, F.col(c))  # noqa: E731, B023
        r2 = _relative(own("yield"), own("y_pred"), own("__mean"))
        out += [F.avg(_squared(own("yield"), own("y_pred"))).alias(f"{role}_mse"), (r2 if role == "train" else F.when(F.count(own("yield")) > 3, r2)).alias(f"{role}_r2")]
    return rows.agg(*out, F.max("n_opt_trials").alias("n_opt_trials"))


def with_fold_metrics(df: DataFrame, fold: Sequence[str] = ("split", "year_out")) -> DataFrame:
    """The test rows of each fold with that fold's metrics."""
    return df.where("role = 'test'").drop("n_opt_trials").join(fold_metrics(df, fold), list(fold))
