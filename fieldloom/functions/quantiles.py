"""Exact quantiles of many groups with bounded state, by refining value ranges in passes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.functions.lineage import cut_lineage

#: Values of a range that are sorted in one array, and parts that a longer range is cut into.
ARRAY, PARTS = 4096, 256
#: Rows up to which the table of ranges is broadcast.
_BROADCAST = 100_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(_BROADCAST + 1).count() <= _BROADCAST else df


def grouped_quantiles(rows: DataFrame, by: Sequence[str], value: str, quantiles: Sequence[float]) -> DataFrame:
    """(by, quantiles: array of doubles): exact quantiles of the values of each group, interpolated between neighbours as ``percentile`` does.

    A quantile lies between two ranks. For each wanted rank the range of values that holds it is cut into ``PARTS`` parts, whose values
    are counted, and the part with the rank is the next range, narrowed to its own least and largest value; so outliers cost one
    pass. A range of ``ARRAY`` values or fewer is sorted. No task ever holds more of a group than that; each pass reads ``rows`` again and sends
    partial counts. Null and NaN values are left out, groups without others are absent, null keys form groups.
    """
    v = F.col("__v")
    given = rows.select(F.struct(*by).alias("__g"), F.col(value).cast("double").alias("__v")).where(v.isNotNull() & ~F.isnan(v))
    groups = cut_lineage(given.groupBy("__g").agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high")))
    place = [F.lit(float(q)) * (F.col("n") - 1) for q in quantiles]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in place])))
    targets = cut_lineage(groups.select("__g", F.explode(ranks).alias("rank"), "low", "high", F.lit(0).cast("long").alias("below"), "n"))
    range_ = ["__g", "low", "high"]
    while True:
        wide = targets.where((F.col("n") > ARRAY) & (F.col("low") < F.col("high")))
        if wide.isEmpty():
            break
        # Halves are taken before the difference, which a double might not hold.
        width = F.col("high") / 2 - F.col("low") / 2
        part = F.least(F.floor((v / 2 - F.col("low") / 2) / width * PARTS), F.lit(PARTS - 1))
        met = given.join(_small(wide.select(*range_).distinct()), "__g").where(v.between(F.col("low"), F.col("high")))
        counts = met.groupBy(*range_, part.alias("part")).agg(F.count("*").alias("k"), F.min(v).alias("from"), F.max(v).alias("to"))
        upto = F.sum("k").over(W.partitionBy(*range_).orderBy("part"))  # PARTS rows a range
        counts = counts.withColumn("upto", upto)
        found = wide.join(counts, range_).where((F.col("rank") < F.col("below") + F.col("upto")) & (F.col("rank") >= F.col("below") + F.col("upto") - F.col("k")))
        narrower = found.select("__g", "rank", F.col("from").alias("low"), F.col("to").alias("high"), (F.col("below") + F.col("upto") - F.col("k")).alias("below"), F.col("k").alias("n"))
        targets = cut_lineage(targets.where((F.col("n") <= ARRAY) | (F.col("low") >= F.col("high"))).unionByName(narrower))
    short = targets.where(F.col("low") < F.col("high"))
    met = given.join(_small(short.select(*range_).distinct()), "__g").where(v.between(F.col("low"), F.col("high")))
    arrays = met.groupBy(*range_).agg(F.sort_array(F.collect_list(v)).alias("values"))  # ARRAY values at most
    sorted_ = short.join(arrays, range_).select("__g", "rank", F.element_at("values", (F.col("rank") - F.col("below") + 1).cast("int")).alias("x"))
    ranked = sorted_.unionAll(targets.where(F.col("low") >= F.col("high")).select("__g", "rank", F.col("low").alias("x")))
    at = groups.select("__g", "n").join(ranked.groupBy("__g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("of")), "__g")  # two ranks a quantile

    def between(p):
        a, b = F.col("of")[F.floor(p)], F.col("of")[F.ceil(p)]
        return F.when(a == b, a).otherwise((F.ceil(p) - p) * a + (p - F.floor(p)) * b)

    return at.select(*[F.col("__g")[c].alias(c) for c in by], F.array(*map(between, place)).alias("quantiles"))


def null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """A join whose null keys meet, with the keys of ``left``."""
    renamed = reduce(lambda d, c: d.withColumnRenamed(c, f"__{c}"), on, right)
    same = reduce(lambda a, b: a & b, [left[c].eqNullSafe(renamed[f"__{c}"]) for c in on])
    return left.join(renamed, same, how).drop(*[f"__{c}" for c in on])
