"""Features of the growing season of each reported yield.

``yields`` has (adm, harv_year), ``calendar`` (adm, sos, eos), a series (adm, date, value); several series are one table with a
``feature`` column, so that all of them are cut and aggregated in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.operators.profiles import year_day_to_date

SEASON = ("adm", "harv_year")
#: Season windows (yield rows) up to which they are broadcast.
BROADCAST_WINDOWS = 1_000_000


def season_windows(yields: DataFrame, calendar: DataFrame, before_sos: int = 60, before_eos: int = 60) -> DataFrame:
    """(adm, harv_year, first, last) day of each season: sowing in the year before the harvest, both limits included."""
    rows = yields.select(*SEASON).distinct().join(calendar.select("adm", "sos", "eos"), "adm")
    first = year_day_to_date(F.col("harv_year") - 1, F.col("sos") - before_sos)
    return rows.select(*SEASON, first.alias("first"), year_day_to_date(F.col("harv_year"), F.col("eos") - before_eos).alias("last"))


def season_window_join(yields: DataFrame, calendar: DataFrame, series: DataFrame, before_sos: int = 60, before_eos: int = 60, strict: bool = False) -> DataFrame:
    """Rows of a series with the harvest year whose season they lie in; the windows of two years may overlap.

    The windows are broadcast after a check of their number, else dates are first expanded to the harvest years that they can
    belong to, which turns the interval into an equi-join. ``strict`` fails the job if a season has no date.
    """
    windows = season_windows(yields, calendar, before_sos, before_eos)
    inside = F.col("date").between(F.col("first"), F.col("last"))
    if windows.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        joined = series.join(F.broadcast(windows), "adm").where(inside)
    else:
        years = F.sequence(F.year("date") - 1, F.year("date") + 2)
        joined = series.withColumn("harv_year", F.explode(years)).join(windows, list(SEASON)).where(inside)
    if strict and windows.join(joined.select(*SEASON).distinct(), list(SEASON), "left_anti").limit(1).count():
        raise ValueError("a season has no date")
    return joined.drop("first", "last")


AGGREGATES: Mapping[str, Callable[[Column], Column]] = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum}


def _placed(season: DataFrame, keys: Sequence[str]) -> DataFrame:
    """With position ``__p`` from 0 by date and number of dates ``__n``."""
    w = W.partitionBy(*keys)
    return season.withColumn("__p", F.row_number().over(w.orderBy("date")) - 1).withColumn("__n", F.count("*").over(w))


def max_consecutive_dry_days(df: DataFrame, group: Sequence[str], threshold: float = 1.0) -> DataFrame:
    """(group, max_cdd): the longest run of values below ``threshold`` in order of dates, 0 if none."""
    wet = F.when(F.coalesce(F.col("value") < threshold, F.lit(False)), 0).otherwise(1)
    runs = df.withColumn("__wet", wet).withColumn("__run", F.sum("__wet").over(W.partitionBy(*group).orderBy("date")))
    counts = runs.groupBy(*group, "__run").agg(F.sum(1 - F.col("__wet")).alias("__days"))
    return counts.groupBy(*group).agg(F.max("__days").cast("int").alias("max_cdd"))


def segment_aggregate(season: DataFrame, length: int, funcs: Sequence[str], keys: Sequence[str] = SEASON) -> DataFrame:
    """(keys, func, step, value): aggregates of ``length`` segments of ceil(n / length) dates each, steps from 1.

    Functions are mean, min, max, sum and max-cdd, the longest run below 1. A last segment without dates is the last single
    value; other empty segments are null.
    """
    keys = list(keys)
    rows = _placed(season, keys).withColumn("__size", F.ceil(F.col("__n") / length)).withColumn("step", (F.floor(F.col("__p") / F.col("__size")) + 1).cast("int"))
    last = rows.where(F.col("__p") == F.col("__n") - 1).where(F.col("step") < length).withColumn("step", F.lit(length))
    rows = rows.unionByName(last)
    plain = [f for f in funcs if f != "max-cdd"]
    out = None
    if plain:
        sums = rows.groupBy(*keys, "step").agg(*[AGGREGATES[f]("value").cast("double").alias(f) for f in plain])
        out = sums.unpivot([*keys, "step"], plain, "func", "value").select(*keys, "func", "step", "value")
    if "max-cdd" in funcs:
        cdd = max_consecutive_dry_days(rows, [*keys, "step"]).select(*keys, F.lit("max-cdd").alias("func"), "step", F.col("max_cdd").cast("double").alias("value"))
        out = cdd if out is None else out.unionByName(cdd)
    steps = season.select(*keys).distinct().select(*keys, F.explode(F.array(*map(F.lit, funcs))).alias("func")).select("*", F.explode(F.sequence(F.lit(1), F.lit(length))).alias("step"))
    return steps.join(out, [*keys, "func", "step"], "left")


def rescale_series(season: DataFrame, length: int, keys: Sequence[str] = SEASON) -> DataFrame:
    """(keys, values): each season's values in order of dates, brought to ``length``.

    As they are if there are as many; by linear interpolation at evenly spaced places if ``length`` is larger or above 10; else
    by means of segments. A season is an array of some hundred values.
    """
    keys = list(keys)
    arrays = season.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("date", "value"))).alias("v")).withColumn("v", F.transform("v", lambda x: x["value"]))
    n = F.size("v")

    def at(i: Column) -> Column:
        place = i * (n - 1) / F.lit(max(1, length - 1))
        low = F.floor(place).cast("int")
        a, b = F.get(F.col("v"), low), F.get(F.col("v"), F.least(low + 1, n - 1))
        return a + (b - a) * (place - low)

    size = F.ceil(n / length).cast("int")

    def mean(i: Column) -> Column:
        start = (i * size).cast("int")
        part = F.filter(F.slice("v", start + 1, size), lambda x: x.isNotNull())
        value = F.try_divide(F.aggregate(part, F.lit(0.0), lambda s, x: s + x), F.size(part))
        return F.when(start < n, value).when(i == length - 1, F.get(F.col("v"), n - 1))

    steps = F.sequence(F.lit(0), F.lit(length - 1))
    interpolate = (F.lit(length) > n) | F.lit(length > 10)
    values = F.when(n == length, F.col("v")).when(interpolate, F.transform(steps, at)).otherwise(F.transform(steps, mean))
    return arrays.select(*keys, values.alias("values"))


def feature_name(feature: Column, func: Column, step: Column, length: int) -> Column:
    return F.concat_ws("_", feature, func) if length == 1 else F.concat_ws("_", feature, func, step.cast("string"))


def designed_features(yields: DataFrame, calendar: DataFrame, series: DataFrame, funcs: Mapping[str, Sequence[str]], length: int, before_sos: int = 60, before_eos: int = 60) -> DataFrame:
    """One wide row for each (adm, harv_year): ``feature_func_step`` columns, without the step if ``length`` is 1.

    ``series`` has (feature, adm, date, value); ``funcs`` names the functions of each feature.
    """
    keys = ["feature", *SEASON]
    season = season_window_join(yields, calendar, series.where(F.col("feature").isin(*funcs)), before_sos, before_eos)
    every = sorted({f for fs in funcs.values() for f in fs})
    long = segment_aggregate(season, length, every, keys)
    names = [f"{feature}_{f}" + (f"_{i}" if length > 1 else "") for feature, fs in funcs.items() for f in fs for i in range(1, length + 1)]
    long = long.withColumn("name", feature_name(F.col("feature"), F.col("func"), F.col("step"), length)).where(F.col("name").isin(*names))
    return long.groupBy(*SEASON).pivot("name", names).agg(F.first("value"))


def timeseries_tensor(yields: DataFrame, calendar: DataFrame, series: DataFrame, features: Sequence[str], length: int = 32, uncentred: Sequence[str] = ("preci",), before_sos: int = 60, before_eos: int = 60) -> DataFrame:
    """(adm, harv_year, tensor): ``length`` rows of scaled feature values, as a nested array.

    Each feature is scaled by its mean and population deviation over all seasons and steps; those in ``uncentred`` keep their zero.
    """
    keys = ["feature", *SEASON]
    season = season_window_join(yields, calendar, series.where(F.col("feature").isin(*features)), before_sos, before_eos)
    steps = rescale_series(season, length, keys).select(*keys, F.posexplode("values").alias("step", "value"))
    moments = steps.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    centre = F.when(F.col("feature").isin(*uncentred), F.lit(0.0)).otherwise(F.col("m"))
    scaled = steps.join(F.broadcast(moments), "feature").withColumn("value", F.try_divide(F.col("value") - centre, "s"))  # one row a feature
    wide = scaled.groupBy(*SEASON, "step").pivot("feature", list(features)).agg(F.first("value")).select(*SEASON, "step", F.array(*[f"`{f}`" for f in features]).alias("row"))
    return wide.groupBy(*SEASON).agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "row"))), lambda x: x["row"]).alias("tensor"))
