"""Feature selection in each fold: mutual information, then variance inflation."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.lineage import cut_lineage
from fieldloom.functions.numeric import greedy_vif, knn_information

FOLD = ("split", "year_out")


def mutual_information(rows: DataFrame, features: Sequence[str], y: str, k: int = 3, least: float = 1e-3) -> DataFrame:
    """(split, year_out, feature, mi) above ``least``: information on ``y`` in each feature over the rows of each fold.

    ``rows`` has (split, year_out, features, y) and holds the training rows. Up to five rows the size of Pearson's correlation
    stands in. Each task gets one fold and feature as two columns, all of their rows.
    """
    long = rows.select(*FOLD, F.col(y).cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in features]).unpivot([*FOLD, "y"], list(features), "feature", "x")
    long = long.where(F.col("x").isNotNull() & F.col("y").isNotNull())

    def estimate(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["x", "y"], kind="stable")
        x, t = part["x"].to_numpy(), part["y"].to_numpy()
        if len(part) <= 5:
            mi = abs(float(np.corrcoef(x, t)[0, 1])) if len(part) > 1 and x.std() and t.std() else 0.0
        else:
            mi = knn_information(x, t, k)
        return pd.DataFrame({"split": [part["split"].iloc[0]], "year_out": [part["year_out"].iloc[0]], "feature": [part["feature"].iloc[0]], "mi": [mi]})

    kind = dict(rows.dtypes)
    found = long.groupBy(*FOLD, "feature").applyInPandas(estimate, f"split {kind['split']}, year_out {kind['year_out']}, feature string, mi double")
    return found.where(F.col("mi") > least)


def fold_correlations(df: DataFrame, split: str, features: Sequence[str]) -> DataFrame:
    """(split, year_out, r): correlation matrix, row by row, of the rows of all years but ``year_out``.

    Sums by split and year, less the held-out year's own, give every fold's matrix: rows are read once, never copied.
    """
    pairs = list(combinations_with_replacement(range(len(features)), 2))
    centre = df.agg(*[F.avg(c).alias(c) for c in features]).head()
    rows = df.dropna(subset=list(features)).select(F.col(split).alias("split"), F.col("harv_year").alias("year_out"), *[(F.col(c) - float(centre[c] or 0.0)).alias(f"x{i}") for i, c in enumerate(features)])
    sums = rows.groupBy(*FOLD).agg(F.count("*").cast("double").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(len(features))], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs])
    names = [c for c in sums.columns if c not in FOLD]
    total = sums.groupBy("split").agg(*[F.sum(c).alias(f"t_{c}") for c in names])
    left = sums.join(total, "split").select(*FOLD, *[(F.col(f"t_{c}") - F.col(c)).alias(c) for c in names])
    cov = lambda i, j: F.col(f"p{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.nullif(F.col("n"), F.lit(0.0))

    def r(i: int, j: int):
        if i == j:
            return F.lit(1.0)
        i, j = min(i, j), max(i, j)
        scale = F.sqrt(cov(i, i) * cov(j, j))
        return F.coalesce(F.when(scale > 0, cov(i, j) / scale), F.lit(0.0))

    return left.select(*FOLD, F.array(*[r(i, j) for i in range(len(features)) for j in range(len(features))]).alias("r"))


def mi_vif_selection(df: DataFrame, split: str, features: Sequence[str], y: str, limit: float = 5.0, k: int = 3) -> DataFrame:
    """(split, year_out, rank, feature): in each fold features by information, less those that inflate variance beyond ``limit``.

    ``df`` has (split column, harv_year, features, y). The training rows of a fold are those of its split's other years. Features that
    tell equally much, but for the rounding of sums, come in order of their names.
    """
    from fieldloom.operators.folds import with_roles

    df = cut_lineage(df.select(*dict.fromkeys([split, "harv_year", *features, y])))  # read for folds, information and correlations
    train = with_roles(df, split).where("role = 'train'")
    information = mutual_information(train, features, y, k)
    ranked = information.groupBy(*FOLD).agg(F.array_sort(F.collect_list(F.struct(F.round(-F.col("mi"), 12).alias("m"), "feature"))).alias("f"))
    both = ranked.select(*FOLD, F.transform("f", lambda x: x["feature"]).alias("f")).join(fold_correlations(df, split, features), list(FOLD))
    names = list(features)

    @F.pandas_udf("array<string>")
    def choose(order: pd.Series, r: pd.Series) -> pd.Series:
        p = len(names)
        picked = [[names[i] for i in greedy_vif(np.array(m, float).reshape(p, p), [names.index(f) for f in o], limit)] for o, m in zip(order, r)]
        return pd.Series(picked, dtype=object)

    return both.select(*FOLD, choose("f", "r").alias("f")).select(*FOLD, F.posexplode("f").alias("pos", "feature")).select(*FOLD, (F.col("pos") + 1).alias("rank"), "feature")


def selection_frequency(selection: DataFrame, folds: DataFrame, features: Sequence[str], steps: int) -> DataFrame:
    """(base, then one column for each step): share of all folds in which a feature was selected; 0 if it never was.

    A feature's step is its last character and its base the name without the last two; with one step the whole name.
    """
    share = folds.select(*FOLD).distinct().agg(F.count("*").alias("folds"))
    counts = selection.select(*FOLD, "feature").distinct().groupBy("feature").agg(F.count("*").alias("n"))
    every = selection.sparkSession.createDataFrame([(f,) for f in features], "feature string").join(counts, "feature", "left").crossJoin(F.broadcast(share))
    name = F.col("feature")
    base = name if steps == 1 else F.substring(name, F.lit(1), F.length(name) - 2)
    step = F.lit("1") if steps == 1 else F.right(name, F.lit(1))
    rows = every.select(base.alias("base"), step.alias("step"), F.coalesce(F.col("n") / F.col("folds"), F.lit(0.0)).alias("share"))
    return rows.groupBy("base").pivot("step", [str(i) for i in range(1, steps + 1)]).agg(F.first("share"))


def selected_columns(selection: DataFrame) -> DataFrame:
    """(split, year_out, features) as an array in order of rank."""
    return selection.groupBy(*FOLD).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda x: x["feature"]).alias("features"))
