"""Gap filling, smoothing, seasonal profiles and the crop calendar. A series has (adm, date, value)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.functions.lineage import cut_lineage
from fieldloom.functions.numeric import gaussian_smooth

PERIOD = 365


def day_of_year(date: Column) -> Column:
    return F.dayofyear(date)


def year_day_to_date(year: Column, doy: Column) -> Column:
    """Day ``doy`` of a year; days outside 1..365 reach into the years around."""
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (doy - 1).cast("int"))


def _harmonics(doy: Column, n: int) -> list[Column]:
    waves = [f(2 * math.pi * k * doy / PERIOD) for k in range(1, n + 1) for f in (F.cos, F.sin)]
    return [F.lit(0.5), *waves]


def _coefficients(series: DataFrame, basis: list[Column], value: str) -> DataFrame:
    """(adm, beta): least squares of each series on the basis, from sums of products; the smallest solution where several fit.

    Only one row of sums for each region is shuffled and solved, never the series itself.
    """
    p = len(basis)
    rows = series.where(F.col(value).isNotNull()).select("adm", F.col(value).alias("__y"), F.array(*basis).alias("__b"))
    b = F.col("__b")
    gram = [F.sum(b[i] * b[j]).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)]
    cross = [F.sum(b[i] * F.col("__y")).alias(f"c{i}") for i in range(p)]
    sums = rows.groupBy("adm").agg(*gram, *cross)
    sums = sums.select("adm", F.array(*[f"g{min(i, j)}_{max(i, j)}" for i in range(p) for j in range(p)]).alias("g"), F.array(*[f"c{i}" for i in range(p)]).alias("c"))

    @F.pandas_udf("array<double>")
    def solve(g: pd.Series, c: pd.Series) -> pd.Series:
        out = [np.linalg.lstsq(np.array(m, float).reshape(p, p), np.array(v, float), rcond=1e-11)[0].tolist() for m, v in zip(g, c)]
        return pd.Series(out, dtype=object)

    return sums.select("adm", solve("g", "c").alias("beta"))


def _evaluated(basis: list[Column]) -> Column:
    """Inner product of ``beta`` with the basis."""
    return sum((F.col("beta")[i] * b for i, b in enumerate(basis)), F.lit(0.0))


def fourier_profile(series: DataFrame, n: int = 5, value: str = "value") -> DataFrame:
    """(adm, doy, value) for days 1..365: the least-squares sum of ``n`` harmonics of a year over all years of a series."""
    fits = _coefficients(series, _harmonics(F.dayofyear("date"), n), value)
    days = fits.withColumn("doy", F.explode(F.sequence(F.lit(1), F.lit(PERIOD))))
    return days.select("adm", "doy", _evaluated(_harmonics(F.col("doy"), n)).alias("value"))


def fill_gaps_fourier(series: DataFrame, n: int = 5, value: str = "value") -> DataFrame:
    """Null values become the profile's value of their day; observed ones stay. Series without any value stay null."""
    fits = _coefficients(series, _harmonics(F.dayofyear("date"), n), value)
    filled = F.coalesce(F.col(value), _evaluated(_harmonics(F.dayofyear("date"), n)))
    return series.join(fits, "adm", "left").withColumn(value, filled).drop("beta")


def polynomial_profile(series: DataFrame, degree: int, value: str = "value") -> DataFrame:
    """(adm, doy, value): the least-squares polynomial in the day of the year, days scaled to -1..1 for the fit."""
    powers = lambda doy: [F.pow((doy - 183) / 182.0, F.lit(k)) if k else F.lit(1.0) for k in range(degree + 1)]
    fits = _coefficients(series, powers(F.dayofyear("date")), value)
    days = fits.withColumn("doy", F.explode(F.sequence(F.lit(1), F.lit(PERIOD))))
    return days.select("adm", "doy", _evaluated(powers(F.col("doy"))).alias("value"))


def interpolate_linear(series: DataFrame, value: str = "value") -> DataFrame:
    """Fill runs of nulls linearly by position; runs at an end take the nearest value."""
    order = W.partitionBy("adm").orderBy("date")
    before, after = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(0, W.unboundedFollowing)
    df = series.withColumn("__i", F.row_number().over(order))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("__i").alias("i"), F.col(value).alias("v")))
    df = df.withColumn("__a", F.last(known, True).over(before)).withColumn("__b", F.first(known, True).over(after))
    a, b, i = F.col("__a"), F.col("__b"), F.col("__i")
    between = a["v"] + (b["v"] - a["v"]) * (i - a["i"]) / F.nullif(b["i"] - a["i"], F.lit(0))
    return df.withColumn(value, F.coalesce(F.col(value), between, a["v"], b["v"])).drop("__i", "__a", "__b")


def rolling_mean_centered(series: DataFrame, window: int = 5, value: str = "value") -> DataFrame:
    """Centred mean of the interpolated series, shorter at the ends; an even window reaches one further back."""
    w = W.partitionBy("adm").orderBy("date").rowsBetween(-(window // 2), (window - 1) // 2)
    return interpolate_linear(series, value).withColumn(value, F.avg(value).over(w))


def rolling_gaussian(series: DataFrame, window: int, std: float | None = None, value: str = "value") -> DataFrame:
    """Centred Gaussian-weighted mean over present values.

    Up to 15 positions it is a weighted window in the plan; beyond, each region's series is convolved in one task.
    """
    std = std or window / 3
    if window <= 15:
        order = W.partitionBy("adm").orderBy("date")
        total, weight = F.lit(0.0), F.lit(0.0)
        for lag in range(-(window // 2), (window + 1) // 2):
            g = math.exp(-0.5 * ((lag + (0.5 if window % 2 == 0 else 0.0)) / std) ** 2)
            v = F.lead(value, lag).over(order) if lag > 0 else F.lag(value, -lag).over(order)
            total, weight = total + F.coalesce(g * v, F.lit(0.0)), weight + F.when(v.isNotNull(), F.lit(g)).otherwise(F.lit(0.0))
        return series.withColumn(value, F.try_divide(total, weight))

    def smooth(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date", kind="stable")
        out = gaussian_smooth(rows[value].to_numpy(float), window, std)
        return rows.assign(**{value: np.where(np.isnan(out), None, out)})

    return series.groupBy("adm").applyInPandas(smooth, series.schema)


def detect_season(profile: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(adm, sos, eos): the days around the minimum on which a 365-day profile rises above, and falls to, a level.

    The level lies ``threshold`` of the way from minimum to maximum. From the day after the (first) minimum on, going round the
    year, ``sos`` is the first day above it; from the day before the minimum backwards ``eos`` is the day after the first
    such day, 366 after day 365. Null for flat profiles.
    """
    sums = profile.groupBy("adm").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.min_by("doy", F.struct("value", "doy")).alias("at"))
    level = F.col("low") + threshold * (F.col("high") - F.col("low"))
    rows = profile.join(sums, "adm").withColumn("offset", F.pmod(F.col("doy") - F.col("at"), F.lit(PERIOD)))
    above = (F.col("value") > level) & (F.col("offset") >= 1)
    hits = rows.groupBy("adm").agg(
        F.min_by(F.when(above, F.col("doy")), F.when(above, F.col("offset"))).alias("sos"), (F.max_by(F.when(above, F.col("doy")), F.when(above, F.col("offset"))) + 1).alias("eos")
    )
    return hits


def season_length(calendar: DataFrame) -> DataFrame:
    days = F.col("eos") - F.col("sos")
    return calendar.withColumn("season_length", F.when(days < 0, days + PERIOD).otherwise(days))


def calendar_exceeds(calendar: DataFrame, reference: DataFrame, harvest_end: str = "harvest_end") -> DataFrame:
    """(adm, eos, harvest_end) of the regions whose season ends after the reference calendar's harvest."""
    return calendar.join(reference.select("adm", harvest_end), "adm").where(F.col("eos") > F.col(harvest_end)).select("adm", "eos", harvest_end)


def calendar_from_dekads(df: DataFrame, sos: str = "sos", eos: str = "eos") -> DataFrame:
    """Dekads as days: ten times, rounded; ``growth`` is the difference before days are brought into 1..365."""
    days = {c: F.round(F.col(c) * 10).cast("int") for c in (sos, eos)}
    day = lambda c: F.when(F.pmod(c, F.lit(PERIOD)) == 0, PERIOD).otherwise(F.pmod(c, F.lit(PERIOD)))
    return df.withColumn("growth", days[eos] - days[sos]).withColumns({c: day(d) for c, d in days.items()})


def wrap_dekads(df: DataFrame, sos: str = "sos", eos: str = "eos") -> DataFrame:
    """Dekads in 1..36, and the growing time in dekads round the year."""
    wrap = lambda c: F.pmod(F.col(c) - 1, F.lit(36)) + 1
    return df.withColumn("growth", F.pmod(F.col(eos) - F.col(sos), F.lit(36))).withColumns({sos: wrap(sos), eos: wrap(eos)})


def pick_by_season_count(df: DataFrame, count: str = "seasons", first: str = "season_1", second: str = "season_2", max_valid: int = 200) -> DataFrame:
    """The second season's value where there are two, else the first's; codes above ``max_valid`` are null."""
    valid = lambda c: F.when(F.col(c) <= max_valid, F.col(c))
    return df.withColumn("value", F.when(F.col(count) == 2, valid(second)).otherwise(valid(first)))


def fill_from_donor(calendar: DataFrame, donors: Sequence[tuple[str, str]], columns: Sequence[str], key: str = "adm1", seasons: Sequence[str] = ("season",)) -> DataFrame:
    """Give each listed region all season rows of its donor, in the order of the list, so that a donor may have been filled before."""
    origin: dict[str, str] = {}
    for target, donor in donors:
        origin[target] = origin.get(donor, donor)
    if not origin:
        return calendar
    pairs = calendar.sparkSession.createDataFrame(list(origin.items()), "__target string, __donor string")
    given = calendar.join(F.broadcast(pairs), F.col(key) == F.col("__donor"))  # as short as the given list
    copied = given.withColumn(key, F.col("__target")).select(*calendar.columns)
    return calendar.where(~F.col(key).isin(*origin)).unionByName(copied)


def fill_from_nearest(calendar: DataFrame, centroids: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Regions without values take those of the nearest region that has them, by squared distance of centroids; ties by name.

    Centroids meet by square tiles: a region looks in its own tile and the eight around it, and is done if what it finds is nearer
    than a tile's width. Those that are not look again in tiles twice as wide, until one tile holds everything.
    """
    rows = centroids.join(calendar, "adm", "left")
    rows = cut_lineage(rows.select("adm", "lon", "lat", *columns))
    full = rows.where(F.col(columns[0]).isNotNull())
    box = full.agg(*[f(c).cast("double").alias(f"{k}_{c}") for c in ("lon", "lat") for k, f in (("low", F.min), ("high", F.max))], F.count("*").alias("n")).head()
    left = rows.where(F.col(columns[0]).isNull()).select(F.col("adm").alias("to"), F.col("lon").cast("double").alias("x"), F.col("lat").cast("double").alias("y"))
    given = full.select("adm", *columns)
    if not box.n:
        return given
    extent = max(box.high_lon - box.low_lon, box.high_lat - box.low_lat) or 1.0
    width, out = extent / max(1.0, box.n**0.5), [given]
    square = (F.col("x") - F.col("lon")) ** 2 + (F.col("y") - F.col("lat")) ** 2
    around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    while True:
        whole = width >= extent
        tile = lambda c: F.lit(0).cast("long") if whole else F.floor(F.col(c) / F.lit(width))  # noqa: E731, B023
        spread = left.withColumns({"i": tile("x"), "j": tile("y")})
        if not whole:
            spread = spread.withColumn("i", around("i")).withColumn("j", around("j"))
        met = spread.join(full.withColumns({"i": tile("lon"), "j": tile("lat")}), ["i", "j"])
        best = met.groupBy("to").agg(F.min(F.struct(square.alias("d"), "adm", *columns)).alias("v"))
        near = cut_lineage(best if whole else best.where(F.sqrt("v.d") < width))
        out.append(near.select(F.col("to").alias("adm"), *[F.col(f"v.{c}").alias(c) for c in columns]))
        if whole:
            return reduce(DataFrame.unionByName, out)
        left, width = cut_lineage(left.join(near.select("to"), "to", "left_anti")), 2 * width
        if left.isEmpty():
            return reduce(DataFrame.unionByName, out)


def rotate_profile(profile: DataFrame, calendar: DataFrame, length: int = 250) -> DataFrame:
    """(adm, step, value): the profile from the start of the season on, round the year, ``length`` days long."""
    rows = profile.join(calendar.select("adm", "sos"), "adm").withColumn("step", F.pmod(F.col("doy") - F.col("sos"), F.lit(PERIOD)))
    return rows.where(F.col("step") < length).select("adm", "step", "value")


def diff_profile(profile: DataFrame) -> DataFrame:
    """First differences by step; the first step has none."""
    d = F.col("value") - F.lag("value").over(W.partitionBy("adm").orderBy("step"))
    return profile.withColumn("value", d).where(F.col("value").isNotNull())


def profile_arrays(profile: DataFrame) -> DataFrame:
    """(adm, features): one array a region, a profile's values in order of steps."""
    rows = profile.groupBy("adm").agg(F.array_sort(F.collect_list(F.struct("step", "value"))).alias("v"))
    return rows.select("adm", F.transform("v", lambda x: x["value"]).alias("features"))


