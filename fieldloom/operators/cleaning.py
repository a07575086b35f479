"""Cleaning and merging of reported yields.

A yield fact has (country, adm1, adm2, season, harv_year, area, production, yield). ``group`` names the columns that
identify one region's series; all windows of one call share that partitioning, so they cost one shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.sources.reports import union_all

#: Names of the reported indicators in the fact; fixed by the reports.
INDICATORS = {"Area Planted": "area", "Quantity Produced": "production", "Yield": "yield"}


def drop_conflicting_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equal rows collapse to one; keys that still have several rows are dropped entirely."""
    n = F.count("*").over(W.partitionBy(*keys))
    return df.dropDuplicates().withColumn("__n", n).where("__n = 1").drop("__n")


def pivot_indicators(df: DataFrame, keys: Sequence[str], names: Mapping[str, str] = INDICATORS, exclude_seasons: Sequence[str] = (), exclude_regions: Sequence[str] = ()) -> DataFrame:
    """Indicator rows to columns; rows missing one are dropped, as are the excluded seasons and first-level regions."""
    rows = df
    if exclude_seasons:
        rows = rows.where(~F.col("season").isin(*exclude_seasons))
    if exclude_regions:
        rows = rows.where(~F.col("adm1").isin(*exclude_regions))
    wide = rows.groupBy(*keys).pivot("indicator", list(names)).agg(F.first("value"))
    return wide.withColumnsRenamed(dict(names)).dropna(subset=list(names.values()))


def consistency_check(df: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """``yield`` recomputed as production / area, and whether the reported one is ``consistent`` with it.

    A difference that can't be computed is no contradiction.
    """
    new = F.try_divide("production", "area")
    apart = F.coalesce(F.abs(new - F.col("yield")) >= tolerance, F.lit(False))
    return df.withColumn("consistent", ~apart).withColumn("yield", new)


def consistency_filter(df: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Consistent rows with their recomputed yield."""
    return consistency_check(df, tolerance).where("consistent").drop("consistent")


def min_mean_area_filter(df: DataFrame, group: Sequence[str], min_area: float = 1000.0) -> DataFrame:
    """Drop whole series whose mean area is below ``min_area``."""
    return df.withColumn("__mean", F.avg("area").over(W.partitionBy(*group))).where(F.col("__mean") >= min_area).drop("__mean")


def row_bounds_filter(df: DataFrame, min_area: float | None = 1000.0, max_yield: float = 10.0) -> DataFrame:
    """Drop rows with less area, then rows with a yield of ``max_yield`` or more."""
    rows = df if min_area is None else df.where(F.col("area") >= min_area)
    return rows.where(F.col("yield") < max_yield)


def suspicious_repeats(df: DataFrame, group: Sequence[str], col: str = "yield", threshold: float = 1e-3) -> DataFrame:
    """Mark rows whose value nearly equals the one before or after in the series: ``suspicious``."""
    w = W.partitionBy(*group).orderBy("harv_year")
    near = lambda c: F.coalesce(F.abs(F.col(col) - c) < threshold, F.lit(False))
    return df.withColumn("suspicious", near(F.lag(col).over(w)) | near(F.lead(col).over(w)))


def polyfit_z(df: DataFrame, group: Sequence[str], col: str, degree: int = 2, x: str = "harv_year", out: str = "z") -> DataFrame:
    """Residual of a polynomial in ``x`` of degree 1 or 2 divided by the residuals' population deviation, per series.

    Null for series of fewer than five rows, and where all residuals are zero. The fit is in closed form from sums over the
    series, with x centred on its mean, so two windows of one partitioning do it.
    """
    if degree not in (1, 2):
        raise ValueError("degree must be 1 or 2")
    w = W.partitionBy(*group)
    mean = lambda c: F.avg(c).over(w)
    both = F.col(x).isNotNull() & F.col(col).isNotNull()
    df = df.withColumn("__x", F.when(both, F.col(x).cast("double"))).withColumn("__y", F.when(both, F.col(col)))
    df = df.withColumn("__c", F.col("__x") - mean("__x")).withColumn("__d", F.col("__y") - mean("__y"))
    c, d = F.col("__c"), F.col("__d")
    # d is fitted by b c + a (c^2 - mean c^2): normal equations of centred regressors.
    moments = {"__s2": mean(c * c), "__s3": mean(c**3), "__s4": mean(c**4), "__p1": mean(c * d), "__p2": mean(c * c * d), "__n": F.count(c).over(w)}
    df = df.withColumns(moments)
    s2, s3, s4, p1, p2 = (F.col(f"__{k}") for k in ("s2", "s3", "s4", "p1", "p2"))
    if degree == 1:
        fit = F.coalesce(F.try_divide(p1, s2) * c, F.lit(0.0))
    else:
        det = s2 * (s4 - s2 * s2) - s3 * s3
        flat = F.coalesce(F.try_divide(p1, s2) * c, F.lit(0.0))
        slope = F.try_divide(p1 * (s4 - s2 * s2) - p2 * s3, det)
        bend = F.try_divide(p2 * s2 - p1 * s3, det)
        fit = F.when(det > 1e-9 * s2 * s4, slope * c + bend * (c * c - s2)).otherwise(flat)
    df = df.withColumn("__r", d - fit)
    z = F.when(F.col("__n") >= 5, F.try_divide(F.col("__r"), F.stddev_pop("__r").over(w)))
    return df.withColumn(out, z).drop("__x", "__y", "__c", "__d", *moments, "__r")


def polyfit_outliers(df: DataFrame, group: Sequence[str], col: str, degree: int = 2, threshold: float = 3.0, side: str = "both", x: str = "harv_year") -> DataFrame:
    """Mark rows further than ``threshold`` deviations from the fit, on both sides or only above it: ``outlier``."""
    z = F.col("__z") if side == "high" else F.abs("__z")
    marked = polyfit_z(df, group, col, degree, x, "__z")
    return marked.withColumn("outlier", F.coalesce(z > threshold, F.lit(False))).drop("__z")


def drop_outliers(df: DataFrame, group: Sequence[str], col: str, side: str = "both", threshold: float = 3.0) -> DataFrame:
    return polyfit_outliers(df, group, col, 2, threshold, side).where("NOT outlier").drop("outlier")


def min_datapoints_filter(df: DataFrame, group: Sequence[str], n: int = 4) -> DataFrame:
    """Drop series with fewer than ``n`` yields."""
    return df.withColumn("__n", F.count("yield").over(W.partitionBy(*group))).where(F.col("__n") >= n).drop("__n")


def clean_yield(df: DataFrame, group: Sequence[str] = ("country", "adm1", "adm2", "season"), min_area: float = 1000.0, max_yield: float = 10.0, threshold: float = 3.0) -> DataFrame:
    """All filters in order, each on what the one before left: consistency, mean area, bounds, outliers, length.

    Consistency and bounds run before the series are brought together; everything after shares that one shuffle.
    """
    rows = consistency_filter(df)
    rows = row_bounds_filter(min_mean_area_filter(rows, group, min_area), min_area, max_yield)
    rows = drop_outliers(drop_outliers(rows, group, "area", "both", threshold), group, "yield", "high", threshold)
    return min_datapoints_filter(rows, group, 4)


def clean_yield_only(df: DataFrame, group: Sequence[str] = ("country", "adm1", "adm2", "season"), max_yield: float = 10.0, threshold: float = 3.0) -> DataFrame:
    """The same for reports without area: repeats, bounds, outliers, at least seven years."""
    rows = suspicious_repeats(df, group).where("NOT suspicious").drop("suspicious")
    rows = drop_outliers(row_bounds_filter(rows, None, max_yield), group, "yield", "high", threshold)
    return min_datapoints_filter(rows, group, 7)


def event_exclusion(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Drop the (country, harv_year) pairs of ``rules``, a short list."""
    return df.join(rules.select("country", "harv_year").distinct(), ["country", "harv_year"], "left_anti")


def _close(a: Column, b: Column, tolerance: float) -> Column:
    return F.coalesce(F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b)), F.lit(False))


def tolerant_merge(first: DataFrame, second: DataFrame, on: Sequence[str], value: str = "yield", tolerance: float = 0.01) -> DataFrame:
    """(on, value, origin) of two sources with unique keys: the first's value where both are close, none where they are not.

    ``origin`` is both, first or second; see ``merge_report`` for the counts, contradictions included.
    """
    return _merged(first, second, on, value, tolerance).where("origin <> 'inconsistent'")


def _merged(first: DataFrame, second: DataFrame, on: Sequence[str], value: str, tolerance: float) -> DataFrame:
    a = first.select(*on, F.col(value).alias("__a"), F.lit(True).alias("__in_a"))
    b = second.select(*on, F.col(value).alias("__b"), F.lit(True).alias("__in_b"))
    both = F.when(_close(F.col("__a"), F.col("__b"), tolerance), F.lit("both")).otherwise(F.lit("inconsistent"))
    origin = F.when(F.col("__in_b").isNull(), F.lit("first")).when(F.col("__in_a").isNull(), F.lit("second")).otherwise(both)
    return a.join(b, list(on), "full_outer").select(*on, F.when(F.col("__in_a"), F.col("__a")).otherwise(F.col("__b")).alias(value), origin.alias("origin"))


def merge_report(first: DataFrame, second: DataFrame, on: Sequence[str], value: str = "yield", tolerance: float = 0.01) -> DataFrame:
    """(origin, n): how many keys are in both, in one only, and contradictory."""
    return _merged(first, second, on, value, tolerance).groupBy("origin").agg(F.count("*").alias("n"))


def coalesce_sources(first: DataFrame, second: DataFrame, on: Sequence[str], value: str = "yield", tolerance: float = 0.1) -> DataFrame:
    """Outer merge: the value that is there; where both are, the second unless they differ by ``tolerance`` or more, then none."""
    a, b = first.select(*on, F.col(value).alias("__a")), second.select(*on, F.col(value).alias("__b"))
    x, y = F.col("__a"), F.col("__b")
    one = F.when(x.isNull(), y).when(y.isNull(), x).when(F.abs(x - y) < tolerance, y)
    return a.join(b, list(on), "full_outer").select(*on, one.alias(value)).where(F.col(value).isNotNull())


def union_sources(frames: Sequence[DataFrame], exclude_countries: Sequence[str] = (), after_year: int = 2000) -> DataFrame:
    """All sources' rows after ``after_year`` without the excluded countries. Sort when writing, not here."""
    rows = union_all(frames).where(F.col("harv_year") > after_year)
    return rows.where(~F.col("country").isin(*exclude_countries)) if exclude_countries else rows
