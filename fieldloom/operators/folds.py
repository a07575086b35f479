"""Folds of leave-one-year-out validation, and the scaling of model inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pending_folds(folds: DataFrame, predictions: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Folds (split, year_out) without complete predictions; ``expected`` (split, year_out, n) says how many rows a fold has."""
    done = predictions.where(F.col("y_pred").isNotNull()).groupBy("split", "year_out").agg(F.count("*").alias("__done"))
    if expected is not None:
        done = done.join(expected, ["split", "year_out"]).where(F.col("__done") >= F.col("n"))
    return folds.join(done.select("split", "year_out"), ["split", "year_out"], "left_anti")


def one_hot_regions(df: DataFrame, regions: Sequence[str], col: str = "adm") -> DataFrame:
    """An indicator column for each of the given regions."""
    return df.withColumns({f"{col}_{r}": F.coalesce((F.col(col) == r).cast("int"), F.lit(0)) for r in regions})


def region_codes(df: DataFrame, col: str = "adm", scope: str = "block") -> DataFrame:
    """(col, place, n, high, low): a place for each region in order of its name, and what its indicator column holds once scaled.

    ``high`` stands in the region's own rows and ``low`` in all others. They are what ``make_x`` makes of ``one_hot_regions`` with the same scope,
    worked out from the regions' counts alone; null where a column would be constant. Rows without a region count in the moments.
    """
    counts = df.groupBy(col).agg(F.count("*").alias("n"))
    rows, known = F.sum("n").over(W.partitionBy()), F.count(col).over(W.partitionBy())  # as many rows as regions
    placed = counts.withColumns({"__rows": rows, "__known": known, "__inside": F.sum(F.when(F.col(col).isNotNull(), F.col("n"))).over(W.partitionBy())}).where(F.col(col).isNotNull())
    mean = F.col("__inside") / (F.col("__rows") * F.col("__known")) if scope == "block" else F.col("n") / F.col("__rows")
    deviation = F.when(F.col("n") < F.col("__rows"), F.sqrt(mean - mean * mean))
    place = (F.row_number().over(W.orderBy(col)) - 1).alias("place")
    return placed.select(col, place, "n", F.try_divide(1 - mean, deviation).alias("high"), F.try_divide(-mean, deviation).alias("low"))


def coded_regions(df: DataFrame, codes: DataFrame, col: str = "adm", few: int = 100_000) -> DataFrame:
    """``df`` with ``{col}_code``: (place, high, low) of its region as one column in place of an indicator for each; null for unknown regions.

    A row's scaled indicator vector is ``low`` of every region, but ``high`` at ``place``. So a linear model's part in it is the sum of all weights times
    their ``low``, once for all rows, plus the weight at ``place`` times ``high - low``.
    """
    side = codes.select(F.col(col).alias("__region"), F.struct("place", "high", "low").alias(f"{col}_code"))
    side = F.broadcast(side) if side.limit(few + 1).count() <= few else side
    return df.join(side, F.col(col) == F.col("__region"), "left").drop("__region")


def make_x(df: DataFrame, blocks: Sequence[Sequence[str]], scope: str = "block") -> DataFrame:
    """Scale blocks of columns and drop constant ones; all moments come from one aggregation.

    ``scope="block"``: one mean and one population deviation for all columns of a block together; ``"column"``: for each.
    """
    columns = [c for b in blocks for c in b]
    sums = df.agg(*[x for c in columns for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"), F.count(c).alias(f"n_{c}"), F.sum(c).alias(f"s_{c}"), F.sum(F.col(c) * F.col(c)).alias(f"q_{c}"))]).head()
    scaled: dict[str, Column] = {}
    for block in blocks:
        kept = [c for c in block if sums[f"lo_{c}"] is not None and sums[f"lo_{c}"] != sums[f"hi_{c}"]]
        for group in ([kept] if scope == "block" else [[c] for c in kept]):
            n = sum(sums[f"n_{c}"] for c in group)
            if not n:
                continue
            mean = sum(sums[f"s_{c}"] for c in group) / n
            deviation = max(0.0, sum(sums[f"q_{c}"] for c in group) / n - mean * mean) ** 0.5
            scaled |= {c: (F.col(c) - mean) / deviation for c in group if deviation}
    return df.select(*[c for c in df.columns if c not in columns], *[v.alias(k) for k, v in scaled.items()])


def standardize_columns(df: DataFrame, cols: Sequence[str], only_if_max_gt: float | None = None) -> DataFrame:
    """Columns as distances from their mean in population deviations, null where that is 0; others than ``only_if_max_gt`` admits stay."""
    moments = df.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop), ("x", F.max))])
    rows = df.crossJoin(F.broadcast(moments))  # one row
    out = {}
    for c in cols:
        z = F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}"))
        out[c] = z if only_if_max_gt is None else F.when(F.col(f"x_{c}") > only_if_max_gt, z).otherwise(F.col(c))
    return rows.withColumns(out).drop(*moments.columns)


def group_years(df: DataFrame, n: int, seed: int = 42, col: str = "harv_year") -> DataFrame:
    """(harv_year, fold): distinct years in a seeded order dealt to ``n`` folds, or a fold of its own each if there are no more."""
    years = df.select(col).distinct()
    place = F.row_number().over(W.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(col).cast("string"))), col)) - 1  # as many rows as years
    count = F.count("*").over(W.partitionBy())
    return years.select(col, F.when(count > n, place % n).otherwise(place).cast("int").alias("fold"))


def loyo_folds(df: DataFrame, split: str) -> DataFrame:
    """(split, year_out): the folds of each value of the column ``split``; train and test are told apart by the year alone."""
    return df.select(F.col(split).alias("split"), F.col("harv_year").alias("year_out")).distinct()


def with_roles(df: DataFrame, split: str, folds: DataFrame | None = None) -> DataFrame:
    """Every row once for each fold of its split, with ``role`` test in its own year, else train.

    Copies the rows as often as there are years; where sums suffice, subtract a year's sums from the total instead.
    """
    folds = loyo_folds(df, split) if folds is None else folds
    rows = df.withColumn("split", F.col(split)).join(F.broadcast(folds) if folds.limit(100_001).count() <= 100_000 else folds, "split")
    return rows.withColumn("role", F.when(F.col("harv_year") == F.col("year_out"), "test").otherwise("train"))


def external_folds(df: DataFrame) -> DataFrame:
    """(year_out, country_out): leave one country out inside a held-out year; only countries with rows in that year."""
    return df.select(F.col("harv_year").alias("year_out"), F.col("country").alias("country_out")).distinct()


def source_target(df: DataFrame, target: str, year_out: int, by: str = "country") -> DataFrame:
    """Role of each row for a transfer to ``target``: test (its held-out year), target (its other years), source, or null (others' held-out year)."""
    mine, out = F.col(by) == target, F.col("harv_year") == year_out
    return df.withColumn("role", F.when(mine & out, "test").when(mine, "target").when(~out, "source"))
