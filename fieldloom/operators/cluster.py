"""Correlations between regions and features, and clusters of profiles."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.functions.numeric import tau_p_value
from fieldloom.functions.stats import correlation


def pairwise_region_correlation(df: DataFrame, min_common: int = 5, value: str = "yield", blocks: int = 16) -> DataFrame:
    """(a, b, n, r): Pearson correlation of every pair of regions over the years that both have, at least ``min_common``.

    The result is all pairs of regions. A year is met by all regions, so its rows are dealt into blocks of regions and met block by
    block: a task's share of a year falls with the square of ``blocks``.
    """
    rows = df.where(F.col(value).isNotNull()).select("adm", "harv_year", F.col(value).alias("v"), F.pmod(F.xxhash64("adm"), F.lit(blocks)).cast("int").alias("k"))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = rows.select(F.col("adm").alias("a"), "harv_year", F.col("v").alias("x"), F.col("k").alias("i"), numbers.alias("j"))
    right = rows.select(F.col("adm").alias("b"), "harv_year", F.col("v").alias("y"), F.col("k").alias("j"), numbers.alias("i"))
    met = left.join(right, ["harv_year", "i", "j"]).where(F.col("a") <= F.col("b"))
    return met.groupBy("a", "b").agg(F.count("*").alias("n"), correlation("x", "y").alias("r")).where(F.col("n") >= min_common)


def within_group_correlation(corr: DataFrame, clusters: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, mean_r): mean over the full symmetric matrix of each cluster, the diagonal included; ``all`` for everything,
    ``within`` for the mean over clusters. Undefined correlations are skipped.
    """
    weight = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    pairs = corr.where(F.col("r").isNotNull() & ~F.isnan("r")).withColumn("w", weight)
    side = lambda c: clusters.select(F.col("adm").alias(c), F.col(cluster).cast("string").alias(f"c_{c}"))
    mean = (F.sum(F.col("w") * F.col("r")) / F.sum("w")).alias("mean_r")
    own = pairs.join(side("a"), "a").join(side("b"), "b").where("c_a = c_b").groupBy(F.col("c_a").alias("cluster")).agg(mean)
    every = pairs.agg(mean).select(F.lit("all").alias("cluster"), "mean_r")
    return own.unionByName(every).unionByName(own.agg(F.avg("mean_r").alias("mean_r")).select(F.lit("within").alias("cluster"), "mean_r"))


def between_feature_correlation(features: DataFrame, level: str = "season") -> DataFrame:
    """(f, g, r) of rows (feature, adm, harv_year, step, value).

    ``season``: correlation of two features' season means over a region's years, averaged over regions. ``step``: over the time
    steps of a region and year, averaged over those. Undefined ones are skipped.
    """
    if level == "season":
        rows, on, by = features.groupBy("feature", "adm", "harv_year").agg(F.avg("value").alias("value")), ["adm", "harv_year"], ["adm"]
    else:
        rows, on, by = features, ["adm", "harv_year", "step"], ["adm", "harv_year"]
    left = rows.select(*on, F.col("feature").alias("f"), F.col("value").alias("x"))
    right = rows.select(*on, F.col("feature").alias("g"), F.col("value").alias("y"))
    each = left.join(right, on).where(F.col("f") < F.col("g")).groupBy("f", "g", *by).agg(correlation("x", "y").alias("r"))
    return each.where(F.col("r").isNotNull() & ~F.isnan("r")).groupBy("f", "g").agg(F.avg("r").alias("r"))


def feature_target_correlation(features: DataFrame, target: str = "yield", method: str = "pearson", alpha: float = 0.1) -> DataFrame:
    """(feature, r): correlation with the target in each region, averaged over regions, of rows (adm, feature, harv_year, value, target).

    ``kendall`` is tau-b; a region's rows are its years, so pairs of years in it are few. Undefined ones are skipped, and taus
    whose p-value exceeds ``alpha``.
    """
    if method == "pearson":
        each = features.groupBy("adm", "feature").agg(correlation("value", target).alias("r"))
    else:
        rows = features.select("adm", "feature", "harv_year", "value", F.col(target).alias("y")).dropna()
        later = rows.select("adm", "feature", F.col("harv_year").alias("h2"), F.col("value").alias("v2"), F.col("y").alias("y2"))
        pairs = rows.join(later, ["adm", "feature"]).where("harv_year < h2").select("adm", "feature", F.signum(F.col("v2") - F.col("value")).alias("a"), F.signum(F.col("y2") - F.col("y")).alias("b"))
        norm = F.sqrt(F.sum(F.abs("a")) * F.sum(F.abs("b")))
        agree = F.col("a") * F.col("b")
        each = pairs.groupBy("adm", "feature").agg(F.try_divide(F.sum(agree), norm).alias("r"), F.sum(agree).alias("s"), F.count_if(agree < 0).alias("against"))
        # Every row stands for its tie's share of the sums over ties.
        tied = rows
        for c in ("value", "y"):
            tied = tied.withColumn(f"t_{c}", F.count("*").over(W.partitionBy("adm", "feature", c)).cast("double"))
        t = {c: F.col(f"t_{c}") for c in ("value", "y")}
        ties = [F.sum(f).alias(f"{k}_{c}") for c in t for k, f in (("pairs", (t[c] - 1) / 2), ("cubes", (t[c] - 1) * (t[c] - 2)), ("fifths", (t[c] - 1) * (2 * t[c] + 5)))]
        each = each.join(tied.groupBy("adm", "feature").agg(F.count("*").alias("n"), *ties), ["adm", "feature"])
        each = each.where(_tau_p_value(*[F.col(c).cast("double") for c in ("s", "against", "n", "pairs_value", "pairs_y", "cubes_value", "cubes_y", "fifths_value", "fifths_y")]) <= alpha)
    return each.where(F.col("r").isNotNull() & ~F.isnan("r")).groupBy("feature").agg(F.avg("r").alias("r"))


def _tau_p_value(*columns: Column) -> Column:
    """Two-sided p-value of each tau from its counts, one row a region and feature."""

    @F.pandas_udf("double")
    def p_value(*counts: pd.Series) -> pd.Series:
        return pd.Series([tau_p_value(*c) for c in zip(*counts)], dtype="float64")

    return p_value(*columns)


def kmeans_regions(profiles: DataFrame, k: int, features: str = "features", seed: int = 42, max_iter: int = 20, tol: float = 1e-4) -> DataFrame:
    """Rows with ``cluster`` of k-means on an array column; stops when no centre moves by more than ``tol``."""
    rows = profiles.withColumn("__v", array_to_vector(F.col(features).cast("array<double>")))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, tol=tol, featuresCol="__v", predictionCol="cluster").fit(rows)
    return model.transform(rows).drop("__v")


def misplaced(found: DataFrame, features: str = "features", slack: float = 1e-9) -> DataFrame:
    """One row (points, clusters, misplaced): how many points lie nearer, by more than ``slack``, to the mean of another cluster than to their own's.

    ``found`` has ``cluster`` and vectors of equal length. Means are sums by cluster and place; one array of them goes to the points.
    """
    rows = found.select("cluster", F.col(features).cast("array<double>").alias("v"))
    sums = rows.select("cluster", F.posexplode("v").alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg("x").alias("x"))
    means = sums.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("m"))
    every = means.agg(F.collect_list(F.struct("cluster", "m")).alias("means"))  # one row of k means
    gap = lambda m: F.aggregate(F.zip_with("v", m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    least = F.array_min(F.transform("means", lambda c: gap(c["m"])))
    own = F.element_at(F.filter("means", lambda c: c["cluster"] == F.col("cluster")), 1)["m"]
    wrong = F.count_if(gap(own) > least + slack)
    return rows.crossJoin(F.broadcast(every)).agg(F.count("*").alias("points"), F.count_distinct("cluster").alias("clusters"), wrong.alias("misplaced"))


def kmeans_elbow(profiles: DataFrame, max_k: int, features: str = "features", seed: int = 42, max_iter: int = 20) -> DataFrame:
    """(k, wcss, silhouette) for k from 2: within-cluster squares relative to the largest, and the squared-Euclidean silhouette."""
    rows = profiles.select(array_to_vector(F.col(features).cast("array<double>")).alias("__v")).cache()
    out = []
    for k in range(2, max_k + 1):  # a short list of distributed fits
        model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="__v", predictionCol="cluster").fit(rows)
        silhouette = ClusteringEvaluator(featuresCol="__v", predictionCol="cluster").evaluate(model.transform(rows))
        out.append((k, float(model.summary.trainingCost), float(silhouette)))
    rows.unpersist()
    top = max((w for _, w, _ in out), default=1.0) or 1.0
    return profiles.sparkSession.createDataFrame([(k, w / top, s) for k, w, s in out], "k int, wcss double, silhouette double")


def lagged_event_join(yields: DataFrame, events: DataFrame, lag: int = 1, count: str = "fatalities") -> DataFrame:
    """(year, mean_yield, events): mean yield of each year with the events of ``lag`` years before."""
    per_year = events.groupBy("year").agg(F.sum(count).alias("events")).select((F.col("year") + lag).alias("year"), "events")
    return yields.groupBy(F.col("harv_year").alias("year")).agg(F.avg("yield").alias("mean_yield")).join(per_year, "year")
