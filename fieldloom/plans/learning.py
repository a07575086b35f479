"""Registered queries on folds, selection, models, scores and clusters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.lineage import cut_lineage, shared_folder
from fieldloom.operators import cluster, folds, metrics, models, runs, selection, soil
from fieldloom.plans import fixtures as fx
from fieldloom.plans.fixtures import recursive, rnd, sql, steady
from fieldloom.plans.registry import Registry, table
from fieldloom.plans.yields import rounded

REGISTRY = Registry()
query = REGISTRY.query


@query("o66_pending_folds", sql("yf", """+ f AS (SELECT DISTINCT country AS split, harv_year AS year_out FROM yf), d AS (SELECT country AS split, harv_year AS year_out, count(*) AS n, count(*) FILTER (length(adm2) + harv_year % 3 > 9) AS k FROM yf GROUP BY ALL)
  SELECT split, year_out FROM f ANTI JOIN (SELECT * FROM d WHERE k >= n - 10) USING (split, year_out)"""))
def o66(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = fx.yield_fact(spark, sf_dir).withColumns({"split": F.col("country"), "year_out": F.col("harv_year")})
    done = fact.withColumn("y_pred", F.when(F.length("adm2") + F.col("harv_year") % 3 > 9, F.col("yield")))
    expected = fact.groupBy("split", "year_out").agg((F.count("*") - 10).alias("n"))
    return folds.pending_folds(folds.loyo_folds(fact, "country"), done, expected)


@query("o67_one_hot_regions", sql("yf", "SELECT country, harv_year, count(*) FILTER (adm2 = 'BUILDING') AS b, count(*) FILTER (adm2 = 'MACHINERY') AS m FROM yf GROUP BY ALL"))
def o67(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = folds.one_hot_regions(fx.yield_fact(spark, sf_dir), ["BUILDING", "MACHINERY"], "adm2")
    return hot.groupBy("country", "harv_year").agg(F.sum("adm2_BUILDING").alias("b"), F.sum("adm2_MACHINERY").alias("m"))


@query("o67_region_codes", sql("yf", """+ c AS (SELECT adm, count(*) AS n FROM yk GROUP BY adm), t AS (SELECT sum(n)::DOUBLE AS rows, count(*) AS known FROM c)
  SELECT adm, (row_number() OVER (ORDER BY adm) - 1)::INT AS place, n, round((1 - n / rows) / sqrt(n / rows - n / rows * n / rows), 6) AS high, round(-n / rows / sqrt(n / rows - n / rows * n / rows), 6) AS low FROM c, t"""))
def o67_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region's place and scaled indicator, each column by itself."""
    return rounded(folds.region_codes(fx.keyed_fact(spark, sf_dir), scope="column"), "high", "low")


@query("o68_make_x", sql("yf", """+ s AS (SELECT sum(area) + sum(production) AS t, sum(area * area) + sum(production * production) AS q, 2 * count(*) AS n, avg(harv_year) AS my, stddev_pop(harv_year) AS sy FROM yf)
  SELECT country, adm1, adm2, round((harv_year - my) / sy, 5) AS harv_year, round((area - t / n) / sqrt(q / n - (t / n) * (t / n)), 5) AS area, round((production - t / n) / sqrt(q / n - (t / n) * (t / n)), 5) AS production FROM yf, s"""))
def o68(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.yield_fact(spark, sf_dir).select("country", "adm1", "adm2", "harv_year", "area", "production", F.lit(1).alias("one"))
    return rounded(folds.make_x(rows, [["harv_year"], ["area", "production"], ["one"]]), "harv_year", "area", "production", digits=5)


@query("o69_standardize_columns", sql("yf", "SELECT country, adm1, adm2, harv_year, round((area - avg(area) OVER ()) / stddev_pop(area) OVER (), 6) AS area, round(yield, 6) AS yield FROM yf"))
def o69(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.yield_fact(spark, sf_dir).select("country", "adm1", "adm2", "harv_year", "area", "yield")
    return rounded(folds.standardize_columns(rows, ["area", "yield"], only_if_max_gt=10), "area", "yield")


@query("o70_group_years", """WITH y AS (SELECT DISTINCT year(o_orderdate)::INT AS harv_year FROM orders)
  SELECT harv_year, ((row_number() OVER (ORDER BY md5('42:' || harv_year), harv_year) - 1) % 3)::INT AS fold FROM y""")
def o70(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.group_years(table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("harv_year")), 3)


@query("o71_loyo_folds", sql("yf", """+ f AS (SELECT DISTINCT country AS split, harv_year AS year_out FROM yf)
  SELECT split, year_out, count(*) FILTER (harv_year <> year_out) AS train, count(*) FILTER (harv_year = year_out) AS test, count(*) FILTER (harv_year = year_out AND adm2 = 'BUILDING') AS own
  FROM yf JOIN f ON country = split GROUP BY ALL"""))
def o71(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = folds.with_roles(fx.yield_fact(spark, sf_dir), "country")
    count = lambda c: F.count_if(c)
    return rows.groupBy("split", "year_out").agg(count(F.col("role") == "train").alias("train"), count(F.col("role") == "test").alias("test"), count((F.col("role") == "test") & (F.col("adm2") == "BUILDING")).alias("own"))


@query("o71_source_target", sql("yf", """SELECT CASE WHEN country = 'ASIA' AND harv_year = 1998 THEN 'test' WHEN country = 'ASIA' THEN 'target' WHEN harv_year <> 1998 THEN 'source' END AS role, count(*) AS n, round(sum(area), 2) AS area FROM yf GROUP BY ALL"""))
def o71_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.source_target(fx.yield_fact(spark, sf_dir), "ASIA", 1998).groupBy("role").agg(F.count("*").alias("n"), rnd(F.sum("area"), 2).alias("area"))


@query("o71_external_folds", sql("yf", "SELECT DISTINCT harv_year AS year_out, country AS country_out FROM yf"))
def o71_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.external_folds(fx.yield_fact(spark, sf_dir))


SOIL = [f"e{i}" for i in range(6)]


def _vectors(spark: SparkSession, sf_dir: str, n: int = 6) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("adm"), "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(n)])


def _top(matrix: str, out: str) -> str:
    """CTEs to ``out`` (v, m): the first eigenvector of a 6 x 6 matrix, its largest loading positive, and the matrix without it; by squaring."""
    return f"""{out}_p AS (SELECT 1 AS k, m FROM {matrix} UNION ALL SELECT k + 1, list_transform(m, lambda r: list_transform(m, lambda c: list_inner_product(r, c) / pow(list_sum(list_transform(range(1, 7), lambda i: m[i][i])), 2))) FROM {out}_p WHERE k < 40),
{out}_j AS (SELECT m, list_position(list_transform(range(1, 7), lambda i: m[i][i]), list_max(list_transform(range(1, 7), lambda i: m[i][i]))) AS j FROM {out}_p WHERE k = 40),
{out}_v AS (SELECT list_transform(m[j], lambda x: x / sqrt(list_inner_product(m[j], m[j]))) AS v FROM {out}_j),
{out}_l AS (SELECT x.v AS v, y.m AS m, list_inner_product(x.v, list_transform(y.m, lambda r: list_inner_product(r, x.v))) AS l FROM {out}_v x, {matrix} y),
{out} AS (SELECT v, list_transform(m, lambda r, i: list_transform(r, lambda x, j: x - l * v[i] * v[j])) AS m FROM {out}_l)"""


_COVARIANCE = "[" + ", ".join("[" + ", ".join(f"covar_pop(e[{i}]::DOUBLE, e[{j}]::DOUBLE)" for j in range(1, 7)) + "]" for i in range(1, 7)) + "]"
_SCORE = " + ".join(f"(e[{i}]::DOUBLE - m{i}) * {{v}}[{i}]" for i in range(1, 7))


@query("o72_soil_pca", recursive(f"""WITH x AS (SELECT vec_id AS adm, embedding AS e FROM embeddings), ok AS (SELECT e FROM x WHERE {" AND ".join(f"e[{i}] IS NOT NULL" for i in range(1, 7))}),
  c AS (SELECT {_COVARIANCE} AS m FROM ok), a AS (SELECT {", ".join(f"avg(e[{i}]::DOUBLE) AS m{i}" for i in range(1, 7))} FROM ok), {_top("c", "one")}, {_top("one", "two")}
  SELECT adm, round({_SCORE.format(v="one.v")}, 6) AS soil_1, round({_SCORE.format(v="two.v")}, 6) AS soil_2 FROM x, a, one, two"""))
def o72(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(soil.soil_pca(_vectors(spark, sf_dir), SOIL, 2), "soil_1", "soil_2")


def _learning_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(country, adm, harv_year, yield, y_bench, features): lagged and mixed columns of the fact, stored, so that the tables are read once for all folds and steps."""
    from pyspark.sql import Window as W

    w = W.partitionBy("adm").orderBy("harv_year")
    rows = fx.predictions(spark, sf_dir).where("run_id = 'run1'").withColumn("before", F.coalesce(F.lag("yield").over(w), F.col("y_bench")))
    rows = rows.withColumns({"size": F.log("area"), "noisy": F.col("y_pred"), "again": 2 * F.log("area") + 1 + F.col("before") / 1000})
    return cut_lineage(rows.select("country", "adm1", "adm2", "adm", "harv_year", "area", "yield", "y_bench", "before", "size", "noisy", "again"))


FEATURES = ["before", "size", "noisy", "again"]


_ROWS = """ln AS (SELECT country, adm, harv_year, yield, coalesce(lag(yield) OVER (PARTITION BY adm ORDER BY harv_year), y_bench) AS before, ln(area) AS size, y_pred AS noisy FROM pred WHERE run_id = 'run1'),
wide AS (SELECT *, 2 * size + 1 + before / 1000 AS again FROM ln)"""
_DIGAMMA = "coalesce(list_sum(list_transform(range(1, {n}), lambda i: 1.0::DOUBLE / i)), 0)"


def _information(features: str) -> str:
    """CTEs to ``i`` (split, year_out, feature, mi): the nearest-neighbour estimate for each fold and feature, by all pairs of its rows."""
    return f"""+{_ROWS}, long AS (UNPIVOT wide ON {features} INTO NAME feature VALUE x),
  fold AS (SELECT split, year_out, feature, row_number() OVER () AS id, x, yield AS y FROM (SELECT DISTINCT country AS split, harv_year AS year_out FROM wide)
    JOIN long ON country = split AND harv_year <> year_out WHERE x IS NOT NULL AND yield IS NOT NULL),
  z AS (SELECT split, year_out, feature, id, (x - avg(x) OVER w) / coalesce(nullif(stddev_pop(x) OVER w, 0), 1) AS x,
    (y - avg(y) OVER w) / coalesce(nullif(stddev_pop(y) OVER w, 0), 1) AS y, count(*) OVER w AS n FROM fold WINDOW w AS (PARTITION BY split, year_out, feature)),
  near AS (SELECT a.id, min(greatest(abs(a.x - b.x), abs(a.y - b.y)), 3)[3] AS reach FROM z a JOIN z b USING (split, year_out, feature) WHERE a.id <> b.id GROUP BY a.id),
  c AS (SELECT a.split, a.year_out, a.feature, a.id, any_value(a.n) AS n, count(*) FILTER (abs(a.x - b.x) < reach - 1e-9) AS cx,
    count(*) FILTER (abs(a.y - b.y) < reach - 1e-9) AS cy FROM z a JOIN near USING (id)
    JOIN z b ON a.split = b.split AND a.year_out = b.year_out AND a.feature = b.feature AND a.id <> b.id GROUP BY ALL),
  i AS (SELECT split, year_out, feature, 1.5 + any_value({_DIGAMMA.format(n="n")}) - avg({_DIGAMMA.format(n="cx + 1")} + {_DIGAMMA.format(n="cy + 1")}) AS mi FROM c GROUP BY ALL)"""


@query("o74_mutual_information", sql("yf pred", _information(", ".join(FEATURES)) + " SELECT split, year_out, feature, round(mi, 6) AS mi FROM i WHERE mi > 1e-3"))
def o74(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = folds.with_roles(_learning_rows(spark, sf_dir), "country").where("role = 'train'")
    return rounded(selection.mutual_information(train, FEATURES, "yield"), "mi")


@query("o75_mi_vif_selection")
def o75(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.mi_vif_selection(_learning_rows(spark, sf_dir), "country", FEATURES, "yield")


@query("o75_two_features", sql("yf pred", _information(", ".join(FEATURES)) + """,
  f AS (SELECT DISTINCT country AS split, harv_year AS year_out FROM wide),
  r AS (SELECT split, year_out, corr(size, again) AS near, corr(before, noisy) AS far FROM f JOIN wide ON country = split AND harv_year <> year_out GROUP BY ALL),
  p AS (SELECT *, CASE WHEN feature IN ('size', 'again') THEN 'near' ELSE 'far' END AS pair FROM i WHERE mi > 1e-3),
  o AS (SELECT *, row_number() OVER (PARTITION BY pair, split, year_out ORDER BY round(mi, 12) DESC, feature) AS place FROM p)
  SELECT pair, split, year_out, place::INT AS rank, feature FROM o JOIN r USING (split, year_out)
  WHERE place = 1 OR 1 / (1 - pow(CASE pair WHEN 'near' THEN near ELSE far END, 2)) <= 5"""))
def o75_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two features: the one that tells more, and the other unless it inflates the variance, as it does where they share a part (``near``)."""
    rows = _learning_rows(spark, sf_dir)
    near, far = (selection.mi_vif_selection(rows, "country", two, "yield").select(F.lit(name).alias("pair"), "*") for name, two in (("near", ["size", "again"]), ("far", ["before", "noisy"])))
    return near.unionAll(far)


@query("o76_selection_frequency", sql("yf", """+ k AS (SELECT DISTINCT country AS split, harv_year AS year_out FROM yf), s AS (SELECT * FROM k, (VALUES ('ndvi_1'), ('ndvi_2'), ('temp_1')) AS f(feature) WHERE (year_out + length(split) + length(feature) + ascii(right(feature, 1))) % 3 <> 0),
  n AS (SELECT feature, count(*) AS n FROM s GROUP BY 1), e AS (SELECT * FROM (VALUES ('ndvi_1'), ('ndvi_2'), ('temp_1'), ('temp_2')) AS f(feature) LEFT JOIN n USING (feature))
  SELECT left(feature, length(feature) - 2) AS base, round(max(coalesce(n, 0) / (SELECT count(*) FROM k)) FILTER (right(feature, 1) = '1'), 6) AS "1", round(max(coalesce(n, 0) / (SELECT count(*) FROM k)) FILTER (right(feature, 1) = '2'), 6) AS "2" FROM e GROUP BY 1"""))
def o76(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = folds.loyo_folds(fx.yield_fact(spark, sf_dir), "country")
    chosen = every.withColumn("feature", F.explode(F.array(F.lit("ndvi_1"), F.lit("ndvi_2"), F.lit("temp_1"))))
    chosen = chosen.where((F.col("year_out") + F.length("split") + F.length("feature") + F.ascii(F.right("feature", F.lit(1)))) % 3 != 0)
    return rounded(selection.selection_frequency(chosen, every, ["ndvi_1", "ndvi_2", "temp_1", "temp_2"], 2), "1", "2")


@query("o77_fold_model_ridge")
def o77(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = models.log_uniform_grid({"alpha": (1e-3, 10.0)}, 6)
    return rounded(models.fold_model(_learning_rows(spark, sf_dir), "country", FEATURES, model="ridge", grid=grid, upper=2.0), "y_pred", "train_mse")


_RIDGE = sql("yf pred", "+" + _ROWS + """, p AS (SELECT a.country, a.adm, a.harv_year, a.before AS b0, a.size AS s0, b.before AS b, b.size AS s, b.yield AS y FROM wide a JOIN wide b ON a.country = b.country AND a.harv_year <> b.harv_year),
  m AS (SELECT country, adm, harv_year, any_value(b0) AS b0, any_value(s0) AS s0, avg(b) AS mb, avg(s) AS ms, avg(y) AS my, stddev_pop(b) AS db, stddev_pop(s) AS ds, covar_pop(b, s) / (stddev_pop(b) * stddev_pop(s)) AS r,
    covar_pop(b, y) / stddev_pop(b) AS cb, covar_pop(s, y) / stddev_pop(s) AS cs FROM p GROUP BY ALL)
  SELECT country AS split, harv_year AS year_out, adm, round(my + (b0 - mb) / db * (cb * 1.5 - cs * r) / (2.25 - r * r) + (s0 - ms) / ds * (cs * 1.5 - cb * r) / (2.25 - r * r), 6) AS y_pred FROM m""")


@query("o77_ridge_two_features", _RIDGE)
def o77_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One given penalty and no pruning, so that the folds' fits can be written down."""
    out = models.fold_model(_learning_rows(spark, sf_dir), "country", ["before", "size"], grid=[{"alpha": 0.5}], upper=1e9, keep=[])
    return rounded(out.select("split", "year_out", "adm", "y_pred"), "y_pred")


@query("o66_resumed_run", _RIDGE)
def o66_resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ridge of ``o77_ridge_two_features`` in a run that was stopped after one of three steps and taken up again."""
    fit = lambda rows: models.fold_model(rows, "country", ["before", "size"], grid=[{"alpha": 0.5}], upper=1e9, keep=[])
    path = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    rows = _learning_rows(spark, sf_dir)
    runs.run_folds(rows, "country", fit, path, steps=3, only=[1])
    return rounded(runs.run_folds(rows, "country", fit, path, steps=3).select("split", "year_out", "adm", "y_pred"), "y_pred")


@query("o77_fold_model_selected_lasso")
def o77_lasso(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _learning_rows(spark, sf_dir)
    chosen = selection.selected_columns(selection.mi_vif_selection(rows, "country", FEATURES, "yield"))
    grid = models.log_uniform_grid({"alpha": (1e-4, 0.1)}, 4)
    return rounded(models.fold_model(rows, "country", FEATURES, model="lasso", grid=grid, upper=2.0, selection=chosen), "y_pred", "train_mse")


@query("o77_distributed_forest")
def o77_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every held-out year, all splits together."""
    out = models.distributed_predictions(_learning_rows(spark, sf_dir), None, FEATURES, "yield", "rf", numTrees=10, maxDepth=4)
    return rounded(out.select("adm", "harv_year", "y_pred"), "y_pred")


TREE_GRIDS = {"rf": [{"trees": 8, "depth": 3}, {"trees": 8, "depth": 2, "min_leaf": 3}], "gbt": [{"trees": 5, "depth": 2, "rate": 0.3}, {"trees": 5, "depth": 1, "rate": 0.5}]}


@query("o77_fold_forest")
def o77_fold_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest for every held-out year of every split, with tuned parameters."""
    return rounded(models.fold_model(_learning_rows(spark, sf_dir), "country", FEATURES, model="rf", grid=TREE_GRIDS["rf"], upper=2.0), "y_pred", "train_mse")


@query("o77_fold_boosted")
def o77_fold_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees for every held-out year of every split, with tuned parameters."""
    return rounded(models.fold_model(_learning_rows(spark, sf_dir), "country", FEATURES, model="gbt", grid=TREE_GRIDS["gbt"], upper=2.0), "y_pred", "train_mse")


#: Cut points of the one-cut trees.
STUMP_CUTS = {"before": [1.8, 1.9, 2.0, 2.1, 2.2, 2.3, 2.4], "size": [6.6, 6.9, 7.2, 7.5, 7.8]}
_STUMP = "+" + _ROWS + f""", cuts AS (SELECT 0 AS f, unnest({STUMP_CUTS["before"]}) AS cut UNION ALL SELECT 1, unnest({STUMP_CUTS["size"]})),
  fold AS (SELECT DISTINCT country AS split, harv_year AS year_out FROM wide),
  train AS (SELECT split, year_out, adm, harv_year, yield AS y, before, size FROM fold JOIN wide ON country = split AND harv_year <> year_out),
  means AS (SELECT split, year_out, avg(y) AS m FROM train GROUP BY ALL HAVING count(DISTINCT harv_year) > 1),
  sides AS (SELECT split, year_out, f, cut, any_value(m) AS m, count(*) FILTER (v <= cut) AS nl, count(*) FILTER (v > cut) AS nr, coalesce(sum(y - m) FILTER (v <= cut), 0) AS sl, coalesce(sum(y - m) FILTER (v > cut), 0) AS sr
    FROM (SELECT t.*, f, cut, m, CASE f WHEN 0 THEN before ELSE size END AS v FROM train t JOIN means USING (split, year_out), cuts) GROUP BY ALL),
  gains AS (SELECT *, sl * sl / nl + sr * sr / nr AS gain FROM sides WHERE nl > 0 AND nr > 0),
  near AS (SELECT *, row_number() OVER (PARTITION BY split, year_out ORDER BY f, cut) AS place
    FROM (SELECT *, max(gain) OVER (PARTITION BY split, year_out) AS top FROM gains) WHERE gain > 1e-12::DOUBLE AND gain >= top * (1 - 1e-9::DOUBLE)),
  best AS (SELECT split, year_out, means.m AS m, f, cut, nl, nr, sl, sr FROM means LEFT JOIN (SELECT * EXCLUDE (m) FROM near WHERE place = 1) USING (split, year_out))"""


@query("o77_stump", sql("yf pred", _STUMP + """
  SELECT country AS split, harv_year AS year_out, adm, round(coalesce(m + CASE WHEN f IS NULL THEN 0 WHEN CASE f WHEN 0 THEN before ELSE size END <= cut THEN sl / nl ELSE sr / nr END, avg(yield) OVER (PARTITION BY adm)), 6) AS y_pred
  FROM wide LEFT JOIN best ON country = split AND harv_year = year_out"""))
def o77_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One boosted tree of one cut at given points, so that the folds' fits can be written down.

    Of cuts with the largest gain, to nine digits, the first by feature and point is taken; where none gains, the training rows' mean is the prediction,
    and with fewer than two training years the benchmark.
    """
    out = models.tree_models(_learning_rows(spark, sf_dir), "country", ["before", "size"], model="gbt", grid=[{"trees": 1, "depth": 1, "rate": 1.0}], upper=1e9, keep=[], cuts=STUMP_CUTS)[0]
    return rounded(out.select("split", "year_out", "adm", "y_pred"), "y_pred")


@query("o79_fold_importance", sql("yf pred", _STUMP + """
  SELECT split, year_out, feature, CASE WHEN f = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS importance FROM best, (VALUES (0, 'before'), (1, 'size')) AS names(i, feature)"""))
def o79_fold_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The importances of ``o77_stump``: the cut's feature has all of the gain, none has any where there is no cut."""
    return models.tree_models(_learning_rows(spark, sf_dir), "country", ["before", "size"], model="gbt", grid=[{"trees": 1, "depth": 1, "rate": 1.0}], upper=1e9, keep=[], cuts=STUMP_CUTS)[1]


@query("o79_forest_importance")
def o79_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain importances of the forest of every held-out year of every split."""
    return rounded(models.tree_models(_learning_rows(spark, sf_dir), "country", FEATURES, model="rf", grid=TREE_GRIDS["rf"], upper=2.0)[1], "importance")


@query("o78_gaussian_process")
def o78(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = [{"sigma": 1.0, "l_s": 2.0, "l_t": 1.0, "noise": 0.1}]
    return rounded(models.fold_model(_learning_rows(spark, sf_dir), "country", ["before", "size"], model="gp", grid=grid, n_folds=3, upper=9.0), "y_pred", "train_mse")


@query("o79_feature_importance")
def o79(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every held-out year, all splits together."""
    return rounded(models.feature_importance(_learning_rows(spark, sf_dir), FEATURES, "yield", None, numTrees=10, maxDepth=4), "importance")


@query("o80_attach_transfer_features", sql("yf", """+ d AS (SELECT country AS source, harv_year AS year_out, adm, harv_year, yield FROM yk), t AS (SELECT source, year_out, adm, harv_year, round(yield * 2, 6) AS transfer_feature_1 FROM d WHERE (year_out + length(source)) % 3 <> 0),
  k AS (SELECT DISTINCT source, year_out FROM t)
  SELECT d.source, d.year_out, d.adm, d.harv_year, transfer_feature_1, CASE WHEN k.source IS NULL THEN 0.0::DOUBLE END AS y_pred, CASE WHEN k.source IS NULL THEN 'no-source-model' END AS tag
  FROM d LEFT JOIN t USING (source, year_out, adm, harv_year) LEFT JOIN k ON d.source = k.source AND d.year_out = k.year_out"""))
def o80(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.keyed_fact(spark, sf_dir).select(F.col("country").alias("source"), F.col("harv_year").alias("year_out"), "adm", "harv_year", "yield")
    given = rows.where((F.col("year_out") + F.length("source")) % 3 != 0).withColumn("transfer_feature_1", rnd(F.col("yield") * 2, 6)).drop("yield")
    return models.attach_transfer_features(rows.drop("yield"), given)


_E = "(yield - y_pred) * (yield - y_pred)"
_LOO = "+ l AS (SELECT *, (sum(yield) OVER w - yield) / nullif(count(*) OVER w - 1, 0) AS m FROM pred WINDOW w AS (PARTITION BY run_id, adm))"


@query("o81_errors", sql("yf pred", f"SELECT run_id, country, count(*) AS n, round(avg({_E}), 6) AS mse, round(sqrt(avg({_E})), 6) AS rmse FROM pred GROUP BY ALL"))
def o81(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.errors(fx.predictions(spark, sf_dir), ["run_id", "country"]), "mse", "rmse")


@query("o82_loo_mean", sql("yf pred", _LOO + " SELECT run_id, adm, harv_year, round(m, 6) AS loo_mean FROM l"))
def o82(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.loo_mean(fx.predictions(spark, sf_dir), ["run_id", "adm"]).select("run_id", "adm", "harv_year", "loo_mean"), "loo_mean")


@query("o83_r2_loo", sql("yf pred", _LOO + f" SELECT run_id, adm, round(1 - sum({_E}) / sum((yield - m) * (yield - m)), 5) AS r2 FROM l GROUP BY ALL"))
def o83(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.r2_loo(fx.predictions(spark, sf_dir), ["run_id", "adm"]), "r2", digits=5)


@query("o84_brr2", sql("yf pred", f"SELECT run_id, country, round(1 - sum({_E}) / sum((yield - y_bench) * (yield - y_bench)), 5) AS brr2 FROM pred GROUP BY ALL"))
def o84(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.brr2(fx.predictions(spark, sf_dir), ["run_id", "country"]), "brr2", digits=5)


@query("o85_nse", sql("yf pred", f"SELECT run_id, adm, round(avg({_E}), 6) AS mse, round(1 - avg({_E}) / var_pop(yield), 5) AS nse FROM pred GROUP BY ALL"))
def o85(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(metrics.nse(fx.predictions(spark, sf_dir), ["run_id", "adm"]), "mse"), "nse", digits=5)


@query("o86_region_performance", sql("yf pred", _LOO + f""" SELECT country, adm, count(*) AS n, round(sqrt(avg({_E})), 6) AS rmse, round(1 - sum({_E}) / sum((yield - m) * (yield - m)), 5) AS r2,
  round(1 - sum({_E}) / sum((yield - y_bench) * (yield - y_bench)), 5) AS brr2 FROM l WHERE run_id = 'run1' GROUP BY ALL HAVING count(*) >= 3"""))
def o86(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.predictions(spark, sf_dir).where("run_id = 'run1'")
    return rounded(rounded(metrics.region_performance(rows), "rmse"), "r2", "brr2", digits=5)


@query("o86_run_performance", sql("yf pred", f"SELECT country, adm1, adm2, avg(n_opt_trials) AS avg_opt_trials, round(avg(train_mse), 6) AS avg_train_mse, round(avg({_E}), 6) AS mse, round(1 - avg({_E}) / var_pop(yield), 5) AS nse FROM pred WHERE run_id = 'run2' GROUP BY ALL"))
def o86_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(metrics.run_performance(fx.predictions(spark, sf_dir).where("run_id = 'run2'")), "avg_train_mse", "mse"), "nse", digits=5)


@query("o87_compare_runs", sql("yf pred", _LOO + f""" SELECT run_id, count(y_pred) AS n, round(sqrt(avg({_E})), 4) AS rmse, round(1 - sum({_E}) / sum((yield - m) * (yield - m)), 4) AS r2, round(1 - sum({_E}) / sum((yield - y_bench) * (yield - y_bench)), 4) AS brr2
  FROM l GROUP BY 1 HAVING count(y_pred) = (SELECT count(*) FROM yf)"""))
def o87(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.predictions(spark, sf_dir)
    return rounded(metrics.compare_runs(rows, fx.yield_fact(spark, sf_dir).count(), digits=12), "rmse", "r2", "brr2", digits=4)


@query("o87_regions_above", sql("yf pred", _LOO + f""", g AS (SELECT run_id, adm, 1 - sum({_E}) / sum((yield - m) * (yield - m)) AS r2 FROM l GROUP BY ALL)
  SELECT run_id, round(avg(r2), 5) AS avg_r2, count(*) FILTER (r2 > 0) AS above_0_0, count(*) FILTER (r2 > 0.3) AS above_0_3 FROM g GROUP BY 1"""))
def o87_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.regions_above(fx.predictions(spark, sf_dir)), "avg_r2", digits=5)


_TRIALS = """WITH t AS (SELECT 'run' || user_id % 3 AS run_id, user_id::VARCHAR AS study, user_id % 2 = 0 AS sequential, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS trial, epoch_us(ts) AS a, epoch_us(ts) + round(value * 100)::BIGINT * 10000 AS b FROM events),
g AS (SELECT run_id, study, CASE WHEN any_value(sequential) THEN sum((b - a) / 1e6) ELSE (arg_max(b, trial) - arg_min(a, trial)) / 1e6 END AS seconds, count(*) AS trials FROM t GROUP BY ALL)"""


@query("o88_study_runtime", _TRIALS + " SELECT run_id, study, round(seconds, 4) AS seconds, trials FROM g UNION ALL SELECT 'run9', 'none', 0.0::DOUBLE, 0")
def o88(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fx.trials(spark, sf_dir)
    studies = log.select("run_id", "study").distinct().unionByName(log.limit(1).select(F.lit("run9").alias("run_id"), F.lit("none").alias("study")))
    return rounded(metrics.study_runtime(log, studies), "seconds", digits=4)


@query("o88_run_runtime", _TRIALS + " SELECT run_id, round(sum(seconds) / 3600, 6) AS hours, round(avg(trials), 6) AS avg_trials FROM g GROUP BY 1")
def o88_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.run_runtime(metrics.study_runtime(fx.trials(spark, sf_dir))), "hours", "avg_trials")


@query("o89_squared_error_summary", sql("yf pred", f"""+ e AS (SELECT run_id, {_E} AS e FROM pred), s AS (SELECT run_id, count(*) AS n, avg(e) AS mean, quantile_cont(e, 0.25) AS q1, quantile_cont(e, 0.5) AS median, quantile_cont(e, 0.75) AS q3 FROM e GROUP BY 1)
  SELECT s.run_id, n, round(mean, 6) AS mean, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(min(e), 6) AS low, round(max(e), 6) AS high
  FROM s JOIN e ON s.run_id = e.run_id AND e BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY s.run_id, n, mean, q1, median, q3"""))
def o89(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.squared_error_summary(fx.predictions(spark, sf_dir)), "mean", "q1", "median", "q3", "low", "high")


@query("o90_error_by_year", sql("yf pred", f"SELECT harv_year, round(avg({_E}), 6) AS mse, round(avg((yield - y_bench) * (yield - y_bench)), 6) AS bench_mse FROM pred WHERE country = 'ASIA' AND run_id = 'run1' GROUP BY 1"))
def o90(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.error_by_year(fx.predictions(spark, sf_dir).where("run_id = 'run1'"), "ASIA"), "mse", "bench_mse")


@query("o91_shortfall", sql("yf pred", """+ s AS (SELECT adm, avg(yield) FILTER (harv_year = 2000) / avg(yield) FILTER (harv_year IN (1996, 1997, 1998)) AS actual, avg(y_pred) FILTER (harv_year = 2000) / avg(y_pred) FILTER (harv_year IN (1996, 1997, 1998)) AS predicted FROM pred WHERE run_id = 'run1' GROUP BY adm)
  SELECT adm, round(actual, 6) AS actual, round(predicted, 6) AS predicted, actual < 1 AND predicted < 1 AS both_short FROM s"""))
def o91(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.shortfall(fx.predictions(spark, sf_dir).where("run_id = 'run1'"), [1996, 1997, 1998], 2000), "actual", "predicted")


@query("o100_fold_metrics", sql("yf pred", f"""+ f AS (SELECT DISTINCT country AS split, harv_year AS year_out FROM pred),
  r AS (SELECT f.*, CASE WHEN harv_year = year_out THEN 'test' ELSE 'train' END AS role, pred.* FROM f JOIN pred ON country = split),
  l AS (SELECT *, (sum(yield) OVER w - yield) / nullif(count(*) OVER w - 1, 0) AS m FROM r WINDOW w AS (PARTITION BY run_id, split, year_out, role))
  SELECT run_id, split, year_out, round(avg({_E}) FILTER (role = 'train'), 6) AS train_mse, round(1 - sum({_E}) FILTER (role = 'train') / sum((yield - m) * (yield - m)) FILTER (role = 'train'), 5) AS train_r2,
  round(avg({_E}) FILTER (role = 'test'), 6) AS test_mse, round(CASE WHEN count(*) FILTER (role = 'test') > 3 THEN 1 - sum({_E}) FILTER (role = 'test') / sum((yield - m) * (yield - m)) FILTER (role = 'test') END, 5) AS test_r2, max(n_opt_trials)::INT AS n_opt_trials FROM l GROUP BY 1, 2, 3"""))
def o100(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = folds.with_roles(fx.predictions(spark, sf_dir), "country")
    return rounded(rounded(metrics.fold_metrics(rows, ("run_id", "split", "year_out")), "train_mse", "test_mse"), "train_r2", "test_r2", digits=5)


@query("o93_pairwise_region_correlation", sql("yf", """+ p AS (SELECT adm, harv_year, yield FROM yk)
  SELECT a.adm AS a, b.adm AS b, count(*) AS n, round(corr(a.yield, b.yield), 6) AS r FROM p a JOIN p b ON a.harv_year = b.harv_year AND a.adm <= b.adm GROUP BY ALL HAVING count(*) >= 5"""))
def o93(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cluster.pairwise_region_correlation(fx.keyed_fact(spark, sf_dir), blocks=4), "r")


@query("o94_within_group_correlation", sql("yf", """+ p AS (SELECT adm, country, harv_year, yield FROM yk),
  c AS (SELECT a.adm AS a, b.adm AS b, any_value(a.country) AS ca, any_value(b.country) AS cb, corr(a.yield, b.yield) AS r FROM p a JOIN p b ON a.harv_year = b.harv_year GROUP BY ALL HAVING count(*) >= 5),
  o AS (SELECT ca AS cluster, avg(r) AS m FROM c WHERE ca = cb GROUP BY 1)
  SELECT cluster, round(m, 6) AS mean_r FROM o UNION ALL SELECT 'all', round(avg(r), 6) FROM c UNION ALL SELECT 'within', round(avg(m), 6) FROM o"""))
def o94(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.keyed_fact(spark, sf_dir)
    groups = rows.select("adm", F.col("country").alias("cluster")).distinct()
    return rounded(cluster.within_group_correlation(cluster.pairwise_region_correlation(rows, blocks=4), groups), "mean_r")


def _feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.keyed_fact(spark, sf_dir).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(3))))
    parts = {"area": F.col("area") * F.col("step"), "cash": F.col("production") + (F.col("step") * F.col("harv_year")) % 7, "wave": (F.col("harv_year") * F.col("step") * 31) % 11 + F.col("yield")}
    return rows.select("adm", "harv_year", "step", *[v.cast("double").alias(k) for k, v in parts.items()]).unpivot(["adm", "harv_year", "step"], list(parts), "feature", "value")


_FEATURES = """+ st AS (SELECT * FROM yk, (VALUES (1), (2), (3)) AS s(step)), ft AS (SELECT adm, harv_year, step, 'area' AS feature, area * step AS value FROM st UNION ALL SELECT adm, harv_year, step, 'cash', production + (step * harv_year) % 7 FROM st
  UNION ALL SELECT adm, harv_year, step, 'wave', (harv_year * step * 31) % 11 + yield FROM st)"""


@query("o95_between_feature_correlation", sql("yf", _FEATURES + """, m AS (SELECT feature, adm, harv_year, avg(value) AS v FROM ft GROUP BY ALL), c AS (SELECT a.feature AS f, b.feature AS g, a.adm, corr(a.v, b.v) AS r FROM m a JOIN m b ON a.adm = b.adm AND a.harv_year = b.harv_year AND a.feature < b.feature GROUP BY ALL)
  SELECT f, g, round(avg(r), 6) AS r FROM c WHERE NOT isnan(r) GROUP BY ALL"""))
def o95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cluster.between_feature_correlation(_feature_rows(spark, sf_dir)), "r")


@query("o95_between_feature_steps", sql("yf", _FEATURES + """, c AS (SELECT a.feature AS f, b.feature AS g, a.adm, a.harv_year, corr(a.value, b.value) AS r FROM ft a JOIN ft b ON a.adm = b.adm AND a.harv_year = b.harv_year AND a.step = b.step AND a.feature < b.feature GROUP BY ALL)
  SELECT f, g, round(avg(r), 5) AS r FROM c WHERE NOT isnan(r) GROUP BY ALL"""))
def o95_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cluster.between_feature_correlation(_feature_rows(spark, sf_dir), "step"), "r", digits=5)


def _with_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feature_rows(spark, sf_dir).where("step = 1").join(fx.keyed_fact(spark, sf_dir).select("adm", "harv_year", "yield"), ["adm", "harv_year"])


@query("o96_feature_target_correlation", sql("yf", _FEATURES + """, c AS (SELECT adm, feature, corr(value, yield) AS r FROM ft JOIN yk USING (adm, harv_year) WHERE step = 1 GROUP BY ALL) SELECT feature, round(avg(r), 6) AS r FROM c WHERE NOT isnan(r) GROUP BY 1"""))
def o96(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cluster.feature_target_correlation(_with_target(spark, sf_dir)), "r")


@query("o96_kendall", recursive(sql("yf", _FEATURES + """, t AS (SELECT adm, feature, harv_year, value, yield FROM ft JOIN yk USING (adm, harv_year) WHERE step = 1),
  p AS (SELECT a.adm, a.feature, sign(b.value - a.value) AS x, sign(b.yield - a.yield) AS y FROM t a JOIN t b ON a.adm = b.adm AND a.feature = b.feature AND a.harv_year < b.harv_year),
  c AS (SELECT adm, feature, sum(x * y) AS s, count(*) FILTER (x * y < 0) AS against, sum(x * y) / nullif(sqrt(sum(abs(x)) * sum(abs(y))), 0) AS r FROM p GROUP BY ALL),
  u AS (SELECT adm, feature, count(*) OVER (PARTITION BY adm, feature, value)::DOUBLE AS tx, count(*) OVER (PARTITION BY adm, feature, yield)::DOUBLE AS ty FROM t),
  v AS (SELECT adm, feature, count(*)::DOUBLE AS n, sum(tx - 1) / 2 AS bx, sum(ty - 1) / 2 AS b_y, sum((tx - 1) * (tx - 2)) AS cx, sum((ty - 1) * (ty - 2)) AS cy, sum((tx - 1) * (2 * tx + 5)) AS fx, sum((ty - 1) * (2 * ty + 5)) AS fy FROM u GROUP BY ALL),
  inv AS (SELECT 1 AS n, [1.0::DOUBLE] AS k UNION ALL SELECT n + 1, list_transform(range(0, n * (n + 1) // 2 + 1), lambda i: list_sum(k[greatest(i - n, 0) + 1:least(i + 1, len(k))])) FROM inv WHERE n < 33),
  q AS (SELECT c.*, v.* EXCLUDE (adm, feature), least(against, n * (n - 1) / 2 - against)::INT AS few,
    (n * (n - 1) * (2 * n + 5) - fx - fy) / 18 + 2 * bx * b_y / (n * (n - 1)) + CASE WHEN n > 2 THEN cx * cy / (9 * n * (n - 1) * (n - 2)) ELSE 0 END AS spread FROM c JOIN v USING (adm, feature)),
  w AS (SELECT q.*, CASE WHEN bx = 0 AND b_y = 0 AND q.n <= 33 THEN 2 * list_sum(inv.k[1:few + 1]) / list_sum(inv.k) <= 0.1 ELSE spread > 0 AND abs(s) / sqrt(spread) >= 1.6448536269514722 END AS clear FROM q LEFT JOIN inv ON inv.n = q.n)
  SELECT feature, round(avg(r), 6) AS r FROM w WHERE r IS NOT NULL AND clear GROUP BY 1""")))
def o96_kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cluster.feature_target_correlation(_with_target(spark, sf_dir), method="kendall"), "r")


@query("o97_kmeans_regions")
def o97(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.kmeans_regions(table(spark, sf_dir, "embeddings"), 7, "embedding").select("vec_id", "cluster")


@query("o97_kmeans_settled", "SELECT count(*) AS points, 7::BIGINT AS clusters, 0::BIGINT AS misplaced FROM embeddings")
def o97_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Once settled, every point is nearest to the mean of its own cluster: those of which that is not so are counted."""
    found = cluster.kmeans_regions(table(spark, sf_dir, "embeddings"), 7, "embedding", max_iter=500, tol=0.0)
    return cluster.misplaced(found, "embedding")


@query("o98_kmeans_elbow")
def o98(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cluster.kmeans_elbow(table(spark, sf_dir, "embeddings"), 4, "embedding"), "wcss", "silhouette")


@query("o99_lagged_event_join", sql("yf", """+ e AS (SELECT 1990 + day(ts) AS year, count(*) AS n FROM events GROUP BY ALL)
  SELECT (e.year + 1)::INT AS year, round(m, 6) AS mean_yield, n::BIGINT AS events FROM e JOIN (SELECT harv_year, avg(yield) AS m FROM yf GROUP BY 1) ON harv_year = e.year + 1"""))
def o99(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").groupBy((1990 + F.dayofmonth("ts")).alias("year"), "event_type").agg(F.count("*").alias("fatalities"))
    return rounded(cluster.lagged_event_join(fx.yield_fact(spark, sf_dir), events), "mean_yield")


REGISTRY.sql.update({name: steady(text) for name, text in REGISTRY.sql.items()})
