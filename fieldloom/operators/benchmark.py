"""The trivial benchmark: a region's yield predicted from its other years."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _left_out_fit(df: DataFrame, group: Sequence[str], x: str, y: str, quadratic: bool, out: str) -> DataFrame:
    """Sums over the group less the row's own terms, with x centred on the group's mean; closed-form solve of what is left."""
    w = W.partitionBy(*group)
    df = df.withColumn("__c", F.col(x) - F.avg(x).over(w)).withColumn("__y", F.col(y).cast("double"))
    c, v = F.col("__c"), F.col("__y")
    powers = {"n": F.lit(1.0), "x": c, "xx": c * c, "y": v, "xy": c * v}
    if quadratic:
        powers |= {"x3": c**3, "x4": c**4, "xxy": c * c * v}
    df = df.withColumns({f"__{k}": F.sum(p).over(w) - p for k, p in powers.items()})
    s = {k: F.col(f"__{k}") for k in powers}
    n = F.nullif(s["n"], F.lit(0.0))
    mean_x, mean_y = s["x"] / n, s["y"] / n
    sxx, sxy = s["xx"] - s["x"] * mean_x, s["xy"] - s["x"] * mean_y
    line = mean_y + F.coalesce(F.when(sxx > 1e-9, F.try_divide(sxy, sxx)), F.lit(0.0)) * (c - mean_x)
    fit = line
    if quadratic:
        mean_q = s["xx"] / n
        sxq, sqq, sqy = s["x3"] - s["x"] * mean_q, s["x4"] - s["xx"] * mean_q, s["xxy"] - s["xx"] * mean_y
        det = sxx * sqq - sxq * sxq
        b, a = F.try_divide(sxy * sqq - sqy * sxq, det), F.try_divide(sqy * sxx - sxy * sxq, det)
        fit = F.when(det > 1e-9 * sxx * sqq, mean_y + b * (c - mean_x) + a * (c * c - mean_q)).otherwise(line)
    return df.withColumn(out, F.when(s["n"] >= 1, fit)).drop("__c", "__y", *[f"__{k}" for k in powers])


def benchmark_predictions(df: DataFrame, model: str = "linear", group: Sequence[str] = ("adm",), x: str = "harv_year", y: str = "yield", out: str = "y_bench") -> DataFrame:
    """Every row with its yield predicted from its region's other rows by year alone; null in a region of one row.

    ``linear`` and ``quadratic`` are least squares, the simpler one where years do not determine it. ``knn`` is the mean of the 4
    nearest years, 2 if fewer than 5 other rows, of equally near ones the earlier. Rows have distinct years in a region.
    """
    if model in ("linear", "quadratic"):
        return _left_out_fit(df, group, x, y, model == "quadratic", out)
    if model != "knn":
        raise ValueError(f"unknown model {model}")
    w = W.partitionBy(*group)
    order = w.orderBy(x)
    near = [F.lag(F.struct(F.col(x).alias("x"), F.col(y).alias("y")), i).over(order) for i in range(1, 5)]
    near += [F.lead(F.struct(F.col(x).alias("x"), F.col(y).alias("y")), i).over(order) for i in range(1, 5)]
    # Four neighbours on each side hold the four nearest.
    rows = df.withColumn("__near", F.filter(F.array(*near), lambda e: e.isNotNull())).withColumn("__n", F.count("*").over(w))
    ranked = F.array_sort(F.transform("__near", lambda e: F.struct(F.abs(e["x"] - F.col(x)).alias("d"), e["x"].alias("x"), e["y"].alias("y"))))
    k = F.when(F.col("__n") - 1 < 5, 2).otherwise(4)
    chosen = F.slice(ranked, F.lit(1), k)
    mean = F.try_divide(F.aggregate(chosen, F.lit(0.0), lambda a, e: a + e["y"]), F.size(chosen))
    return rows.withColumn(out, mean).drop("__near", "__n")
