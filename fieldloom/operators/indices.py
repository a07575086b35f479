"""Standardised anomaly indices by region and day of the year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.functions.gamma import gamma_score, gamma_shape
from fieldloom.operators.profiles import rolling_gaussian
from fieldloom.operators.trends import linear_trend, real_spread


def fill_small_gaps(series: DataFrame) -> DataFrame:
    """A null becomes the mean of the values right before and after it, if any; zeros stay."""
    near = F.avg("value").over(W.partitionBy("adm").orderBy("date").rowsBetween(-1, 1))
    return series.withColumn("value", F.coalesce("value", near))


def _positions(series: DataFrame) -> DataFrame:
    return series.withColumn("position", F.row_number().over(W.partitionBy("adm").orderBy("date")) - 1)


def series_trends(series: DataFrame) -> DataFrame:
    """(adm, n, slope, intercept, r2, p_value) of each series by position."""
    return linear_trend(_positions(series), ["adm"], "position", "value")


def trend_report(series: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row: series, share with a significant trend, share of those that rise, mean slope."""
    significant = F.col("p_value") < alpha
    return series_trends(series).agg(
        F.count("*").alias("series"),
        F.avg(F.coalesce(significant, F.lit(False)).cast("int")).alias("significant_share"),
        F.avg(F.when(significant, (F.col("slope") > 0).cast("int"))).alias("rising_share"),
        F.avg("slope").alias("mean_slope"),
    )


def standardized_index(series: DataFrame, window: int | None = None, dist: str = "gaussian", detrend: bool = True, alpha: float = 0.05) -> DataFrame:
    """(adm, date, value): each value against those of its region on the same day of other years.

    Small gaps are filled, the series smoothed by a Gaussian ``window`` and its linear trend removed if its slope is
    significant. Day 366 counts as 365. A day with an exact 0 in any year is 0 in all. Else ``gaussian`` gives the distance from
    the mean in population deviations, null where all are equal but for rounding; ``gamma`` the normal quantile of the probability under
    a gamma fitted to the day's positive values, null where it has none. Windows by region and day do all of it; no Python.
    """
    if dist not in ("gaussian", "gamma"):
        raise ValueError(f"unknown distribution {dist}")
    rows = fill_small_gaps(series.select("adm", "date", "value"))
    if window:
        rows = rolling_gaussian(rows, window)
    if detrend:
        fits = series_trends(rows).where(F.col("p_value") < alpha).select("adm", "slope", "intercept")
        line = F.coalesce(F.col("intercept") + F.col("slope") * F.col("position"), F.lit(0.0))
        rows = _positions(rows).join(fits, "adm", "left").withColumn("value", F.col("value") - line).select("adm", "date", "value")
    rows = rows.withColumn("doy", F.least(F.dayofyear("date"), F.lit(365)))
    w = W.partitionBy("adm", "doy")
    zero = F.coalesce(F.max(F.col("value") == 0).over(w), F.lit(False))
    if dist == "gamma":
        positive = F.when(F.col("value") > 0, F.col("value"))
        fit = rows.select("adm", "date", "value", zero.alias("__zero"), F.avg(positive).over(w).alias("__mean"), F.avg(F.log(positive)).over(w).alias("__log"))
        fit = fit.withColumn("__shape", gamma_shape(F.col("__mean"), F.col("__log")))
        score = F.when(F.col("value").isNotNull() & F.col("__mean").isNotNull(), gamma_score(F.col("__shape"), F.col("value") / F.col("__mean")))
        return fit.select("adm", "date", F.when(F.col("__zero"), F.when(F.col("value").isNotNull(), F.lit(0.0))).otherwise(score).alias("value"))
    spread = real_spread(F.stddev_pop("value").over(w), F.max(F.abs(F.col("value"))).over(w))
    z = (F.col("value") - F.avg("value").over(w)) / spread
    return rows.select("adm", "date", F.when(zero, F.when(F.col("value").isNotNull(), F.lit(0.0))).otherwise(z).alias("value"))
