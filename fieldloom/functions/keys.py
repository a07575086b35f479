"""Region keys, name harmonisation, and joins of results to regions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def adm_key(country: Column, adm1: Column, adm2: Column) -> Column:
    """``[Malawi Central Dedza]``; a second level ``"None"`` is left out, as are apostrophes."""
    text = F.concat(F.lit("["), F.concat_ws(" ", country, F.nullif(adm1, F.lit("None")), F.nullif(adm2, F.lit("None"))), F.lit("]"))
    return F.replace(text, F.lit("'"), F.lit(""))


def with_adm(df: DataFrame) -> DataFrame:
    return df.withColumn("adm", adm_key(F.col("country"), F.col("adm1"), F.col("adm2")))


def rename_values(df: DataFrame, col: str, mapping: Mapping[str, str]) -> DataFrame:
    """Replace values by a short mapping. Chain calls where a later rule must see the results of earlier ones."""
    if not mapping:
        return df
    names = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return df.withColumn(col, F.coalesce(names[F.col(col)], F.col(col)))


def assign_parent(df: DataFrame, mapping: Mapping[str, str], child: str = "adm2", parent: str = "adm1") -> DataFrame:
    """Give the listed children another parent."""
    if not mapping:
        return df
    parents = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return df.withColumn(parent, F.coalesce(parents[F.col(child)], F.col(parent)))


def attach_geometry(df: DataFrame, regions: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Results joined to all regions on the key columns that both have, with a label: the second level, else the first.

    A region without results stays with nulls; a region without geometry fails the job.
    """
    keys = [c for c in ("country", "adm1", "adm2", "adm") if c in df.columns and c in regions.columns]
    if regions.where(F.col(geometry).isNull()).limit(1).count():
        raise ValueError("a region has no geometry")
    return df.join(regions, keys, "right").withColumn("label", F.when(F.col("adm2") != "None", F.col("adm2")).otherwise(F.col("adm1")))


def unmatched_regions(regions: DataFrame, yields: DataFrame, keys: Sequence[str] = ("adm",)) -> DataFrame:
    """(keys, missing): map regions without yields (``yield``), and yield regions without a map region (``geometry``)."""
    a, b, on = regions.select(*keys).distinct(), yields.select(*keys).distinct(), list(keys)
    return a.join(b, on, "left_anti").withColumn("missing", F.lit("yield")).unionByName(b.join(a, on, "left_anti").withColumn("missing", F.lit("geometry")))
