from itertools import combinations, permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldloom.functions.numeric import digamma, knn_information, tau_p_value
from fieldloom.operators import cluster, folds, metrics, models, selection, soil


def learning_rows(spark, n=120, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = 2 * x[:, 0] - x[:, 1] + 0.05 * rng.normal(size=n)
    rows = [("s", f"r{i % 12}", 2000 + i // 12, *map(float, x[i]), float(x[i, 0] + 0.001 * x[i, 2]), float(y[i]), 0.0) for i in range(n)]
    return spark.createDataFrame(rows, "split string, adm string, harv_year int, a double, b double, noise double, again double, yield double, y_bench double")


def test_make_x_and_columns(spark):
    df = spark.createDataFrame([(i, float(i), float(10 * i), 5.0) for i in range(6)], "k int, a double, b double, c double")
    out = folds.make_x(df, [["a", "b"], ["c"]])
    assert out.columns == ["k", "a", "b"]
    both = np.array([[r.a, r.b] for r in out.collect()])
    assert both.mean() == pytest.approx(0) and both.std() == pytest.approx(1)
    own = np.array([[r.a, r.b] for r in folds.make_x(df, [["a", "b"]], "column").collect()])
    np.testing.assert_allclose(own.mean(0), 0, atol=1e-9)
    z = folds.standardize_columns(df, ["a", "c"], only_if_max_gt=5).collect()
    assert [r.a for r in z] == [0, 1, 2, 3, 4, 5] and [r.c for r in z] == [5.0] * 6


def test_year_groups(spark):
    df = spark.createDataFrame([(y,) for y in range(2000, 2010)] * 2, "harv_year int")
    sizes = [r["count"] for r in folds.group_years(df, 4).groupBy("fold").count().collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1
    assert folds.group_years(df, 20).select("fold").distinct().count() == 10
    a, b = (sorted(map(tuple, folds.group_years(d, 4).collect())) for d in (df, df.orderBy(F.rand()).repartition(5)))
    assert a == b


def test_pca_against_numpy(spark):
    x = np.random.default_rng(1).normal(size=(40, 3)) @ np.diag([3, 2, 0.1])
    df = spark.createDataFrame([(f"r{i}", *map(float, v)) for i, v in enumerate(x)] + [("n", None, 1.0, 1.0)], "adm string, a double, b double, c double")
    got = {r.adm: (r.soil_1, r.soil_2) for r in soil.soil_pca(df, ["a", "b", "c"]).collect()}
    c = x - x.mean(0)
    parts = np.linalg.svd(c, full_matrices=False)[2][:2]
    parts = np.array([p if p[np.abs(p).argmax()] > 0 else -p for p in parts])
    np.testing.assert_allclose([got[f"r{i}"] for i in range(40)], c @ parts.T, atol=1e-8)
    assert got["n"] == (None, None)
    many = df.where("a IS NOT NULL").unionAll(df.where("a IS NOT NULL"))
    z = soil.soil_features(many.select("adm"), df, ["a", "b", "c"]).agg(F.avg("soil_1"), F.stddev_pop("soil_1")).head()
    assert z[0] == pytest.approx(0, abs=1e-9) and z[1] == pytest.approx(1)


def test_selection(spark):
    df = learning_rows(spark)
    names = ["a", "b", "noise", "again"]
    chosen = selection.mi_vif_selection(df, "split", names, "yield")
    sets = {}
    for r in chosen.collect():
        sets.setdefault(r.year_out, set()).add(r.feature)
    assert len(sets) == 10 and all(("a" in s) != ("again" in s) and "b" in s for s in sets.values())
    r = {x.year_out: np.array(x.r).reshape(4, 4) for x in selection.fold_correlations(df, "split", names).collect()}
    pdf = df.toPandas()
    np.testing.assert_allclose(r[2003], np.corrcoef(pdf[pdf.harv_year != 2003][names].to_numpy().T), atol=1e-9)
    few = df.limit(5).withColumn("year_out", F.lit(1))
    assert selection.mutual_information(few, ["a"], "yield", least=-1).head().mi == pytest.approx(abs(np.corrcoef(*few.toPandas()[["a", "yield"]].to_numpy().T)[0, 1]))


@pytest.mark.parametrize("model,grid", [("ridge", [{"alpha": 1e-4}, {"alpha": 100.0}]), ("lasso", [{"alpha": 1e-4}]), ("gp", [{"sigma": 5.0, "l_s": 3.0, "l_t": 5.0, "noise": 0.01}])])
def test_fold_models(spark, model, grid):
    df = learning_rows(spark)
    out = models.fold_model(df, "split", ["a", "b"], model=model, grid=grid, upper=50.0, keep=[]).toPandas().merge(df.toPandas(), on=["adm", "harv_year"])
    assert len(out) == 120 and np.mean((out.y_pred - out["yield"]) ** 2) < (0.01 if model != "gp" else 0.5)
    pruned = models.fold_model(df, "split", ["a", "b"], model=model, grid=grid, upper=1e-12, keep=[]).toPandas()
    assert (pruned.y_pred == 0).all() and pruned.train_mse.isna().all()


def direct(model, p, x, t, y, x_new, t_new):
    """Predictions straight from the rows."""
    m, s = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    a, b = (x - m) / s, (x_new - m) / s
    if model == "gp":
        span = (t.max() - t.min()) or 1.0
        u, v = (t - t.mean()) / span, (t_new - t.mean()) / span
        kernel = lambda c, e, d, f: p["sigma"] * np.exp(-((c[:, None] - d[None]) ** 2).sum(-1) / p["l_s"] ** 2 - (e[:, None] - f[None]) ** 2 / p["l_t"] ** 2)
        return kernel(b, v, a, u) @ np.linalg.inv(kernel(a, u, a, u) + p["noise"] * np.eye(len(a))) @ y
    if model == "ridge":
        w = np.linalg.solve(a.T @ a / len(a) + p["alpha"] * np.eye(a.shape[1]), a.T @ (y - y.mean()) / len(a))
    else:
        w = np.zeros(a.shape[1])
        for _ in range(3000):  # proximal gradient steps
            z = w - (a.T @ (a @ w - (y - y.mean())) / len(a)) / a.shape[1]
            w = np.sign(z) * np.maximum(np.abs(z) - p["alpha"] / a.shape[1], 0)
    return y.mean() + b @ w


@pytest.mark.parametrize("model,grid", [
    ("ridge", [{"alpha": 1.0}, {"alpha": 0.03}, {"alpha": 0.3}]), ("lasso", [{"alpha": 0.2}, {"alpha": 0.02}]),
    ("gp", [{"sigma": 1.0, "l_s": 2.0, "l_t": 1.0, "noise": 0.1}, {"sigma": 3.0, "l_s": 1.0, "l_t": 2.0, "noise": 0.3}]),
])
@pytest.mark.parametrize("upper", [1e9, 3.0])
def test_fold_models_against_rows(spark, model, grid, upper):
    """Every fold's prediction, error and pruning by plain numpy on the fold's own rows; folds have their own columns."""
    rng = np.random.default_rng(7)
    rows = [("p" if i % 3 else "q", f"r{i % 15}", 2000 + i // 15, *map(float, rng.normal(size=3) * [1, 5, 1] + [0, 100, 0]), 7.0) for i in range(90)]
    df = spark.createDataFrame([(*r, float(r[3] - 0.1 * r[4] + 0.3 * (r[2] - 2000) + rng.normal()), -1.0) for r in rows], "split string, adm string, harv_year int, a double, b double, c double, same double, yield double, y_bench double")
    chosen = [("p", 2001, ["a"]), ("p", 2002, ["c", "b"]), ("q", 2001, ["b", "a", "same"]), ("q", 2003, [])]
    sel = spark.createDataFrame(chosen, "split string, year_out int, features array<string>")
    out = models.fold_model(df, "split", ["a", "b", "c", "same"], model=model, grid=grid, upper=upper, selection=sel, n_folds=3)
    got = {(r.split, r.adm, r.harv_year): r for r in out.collect()}
    pdf = df.toPandas()
    assert len(got) == len(pdf)
    for (split, held), test in pdf.groupby(["split", "harv_year"]):
        names = ["harv_year", *dict((c[:2], c[2]) for c in chosen).get((split, held), [])]
        train = pdf[(pdf.split == split) & (pdf.harv_year != held)]
        place = models.inner_folds(train.harv_year.to_numpy(), 3, 42)
        fit = lambda p, a, b: direct(model, p, a[names].to_numpy(float), a.harv_year.to_numpy(float), a["yield"].to_numpy(), b[names].to_numpy(float), b.harv_year.to_numpy(float))
        scores = []
        for p in grid:
            errors = [np.mean((fit(p, train[place != f], train[place == f]) - train[place == f]["yield"]) ** 2) for f in range(place.max() + 1)]
            scores.append(np.inf if max(errors) > upper else np.mean(errors))
        best = int(np.argmin(scores))
        want = fit(grid[best], train, test) if np.isfinite(scores[best]) else np.full(len(test), -1.0)
        for (_, row), y in zip(test.iterrows(), want):
            r = got[split, row.adm, held]
            assert r.y_pred == pytest.approx(y, abs=1e-5) and r.n_trials == len(grid)
            assert (r.train_mse is None) if not np.isfinite(scores[best]) else r.train_mse == pytest.approx(scores[best], rel=1e-5)


def test_selected_features_per_fold(spark):
    df = learning_rows(spark)
    only = spark.createDataFrame([("s", y, ["a", "b"] if y != 2004 else ["noise"]) for y in range(2000, 2010)], "split string, year_out int, features array<string>")
    out = models.fold_model(df, "split", ["a", "b", "noise"], grid=[{"alpha": 1e-6}], upper=50.0, selection=only, keep=[]).toPandas().merge(df.toPandas(), on=["adm", "harv_year"])
    error = ((out.y_pred - out["yield"]) ** 2).groupby(out.harv_year).mean()
    assert error[2004] > 0.5 and error.drop(2004).max() < 0.02


def test_large_split_models(spark):
    df = learning_rows(spark)
    for model, most in (("rf", 3.0), ("gbt", 3.0), ("lasso", 0.01)):
        out = models.distributed_predictions(df, 2005, ["a", "b"], "yield", model).toPandas()
        assert len(out) == 12 and np.mean((out.y_pred - out["yield"]) ** 2) < most
    one = models.feature_importance(df, ["a", "b", "noise"], "yield", [2005], "gbt", maxDepth=1, maxIter=1).collect()
    pdf = df.toPandas()
    pdf = pdf[pdf.harv_year != 2005]

    def gained(c):  # the largest fall in squared error of any single cut
        y = pdf.sort_values(c)["yield"].to_numpy()
        return max(y.var() * len(y) - y[:i].var() * i - y[i:].var() * (len(y) - i) for i in range(1, len(y)))

    assert {r.feature: r.importance for r in one} == {c: float(c == max(("a", "b", "noise"), key=gained)) for c in ("a", "b", "noise")}
    gain = {r.feature: r.importance for r in models.feature_importance(df, ["a", "noise"], "yield", [2005], numTrees=10).collect()}
    assert gain["a"] > gain["noise"] and sum(gain.values()) == pytest.approx(1)


def test_transfer_features(spark):
    df = spark.createDataFrame([("x", 2000, "C", "r", 2000, 0.5), ("x", 2001, "C", "r", 2001, 0.5), ("y", 2000, "C", "q", 2000, 0.5)], "source string, year_out int, country_out string, adm string, harv_year int, y_bench double")
    given = spark.createDataFrame([("x", 2000, "C", "r", 2000, 1.5)], "source string, year_out int, country_out string, adm string, harv_year int, transfer_feature_1 double")
    got = {(r.source, r.year_out): (r.transfer_feature_1, r.y_pred, r.tag) for r in models.attach_transfer_features(df, given.drop("country_out")).collect()}
    assert got == {("x", 2000): (1.5, None, None), ("x", 2001): (None, 0.0, "no-source-model"), ("y", 2000): (None, 0.0, "no-source-model")}
    other = models.attach_transfer_features(df, given.withColumn("country_out", F.lit("D")), "external", "benchmark").collect()
    assert {r.y_pred for r in other} == {0.5}


def predictions(spark):
    rng = np.random.default_rng(3)
    rows = [("c", f"r{i % 4}", f"r{i % 4}", "None", 2000 + i // 4, float(v), float(v + e), float(b), f"m{k}", 1, 0.1) for k in (1, 2) for i, (v, e, b) in enumerate(rng.normal(size=(40, 3)))]
    rows.append(("c", "one", "one", "None", 2000, 1.0, 1.0, 1.0, "m1", 1, 0.1))
    return spark.createDataFrame(rows, "country string, adm string, adm1 string, adm2 string, harv_year int, yield double, y_pred double, y_bench double, run_id string, n_opt_trials int, train_mse double")


def test_scores_against_numpy(spark):
    df = predictions(spark)
    one = df.where("run_id = 'm1'")
    pdf = one.toPandas()
    rows = {r.adm: r for r in metrics.region_performance(one).collect()}
    assert set(rows) == {f"r{i}" for i in range(4)}
    for adm, g in pdf[pdf.adm != "one"].groupby("adm"):
        y, p, b = (g[c].to_numpy() for c in ("yield", "y_pred", "y_bench"))
        loo = (y.sum() - y) / (len(y) - 1)
        assert rows[adm].rmse == pytest.approx(np.sqrt(np.mean((y - p) ** 2)))
        assert rows[adm].r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - loo) ** 2).sum())
        assert rows[adm].brr2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - b) ** 2).sum())
    means = metrics.loo_mean(one, ["adm"]).toPandas()
    assert means[means.adm == "one"].loo_mean.isna().all()
    assert [r.run_id for r in metrics.compare_runs(df, 40).collect()] == ["m2"]
    folds_ = one.withColumns({"split": F.lit("s"), "year_out": F.lit(2000), "role": F.when(F.col("harv_year") == 2000, "test").otherwise("train")})
    assert metrics.fold_metrics(folds_).head().test_r2 is not None
    assert metrics.fold_metrics(folds_.where("role = 'train' OR adm IN ('r0', 'r1', 'r2')")).head().test_r2 is None
    assert metrics.with_fold_metrics(folds_).count() == 5


def test_runtimes(spark):
    rows = [("r", "s", 1, True, "2020-01-01 00:00:00", "2020-01-01 00:01:00"), ("r", "s", 2, True, "2020-01-01 01:00:00", "2020-01-01 01:00:30"), ("r", "t", 1, False, "2020-01-01 00:00:00", "2020-01-01 00:01:00"), ("r", "t", 2, False, "2020-01-01 00:00:10", "2020-01-01 02:00:00")]
    log = spark.createDataFrame(rows, "run_id string, study string, trial int, sequential boolean, a string, b string").select("run_id", "study", "trial", "sequential", F.col("a").cast("timestamp").alias("t_start"), F.col("b").cast("timestamp").alias("t_complete"))
    studies = spark.createDataFrame([("r", "s"), ("r", "t"), ("r", "empty")], "run_id string, study string")
    per = {r.study: (r.seconds, r.trials) for r in metrics.study_runtime(log, studies).collect()}
    assert per == {"s": (90.0, 2), "t": (7200.0, 2), "empty": (0.0, 0)}
    run = metrics.run_runtime(metrics.study_runtime(log, studies)).head()
    assert run.hours == pytest.approx(7290 / 3600) and run.avg_trials == pytest.approx(4 / 3)


@pytest.mark.parametrize("blocks", [1, 3, 16])
def test_region_pairs(spark, blocks):
    df = predictions(spark).where("run_id = 'm1'")
    got = {(r.a, r.b): r.r for r in cluster.pairwise_region_correlation(df, blocks=blocks).collect()}
    wide = df.where("adm <> 'one'").toPandas().pivot(index="harv_year", columns="adm", values="yield").corr()
    assert len(got) == 10 and all(got[a, b] == pytest.approx(wide.loc[a, b]) for a, b in got)
    groups = spark.createDataFrame([("r0", 1), ("r1", 1), ("r2", 2), ("r3", 2)], "adm string, cluster int")
    within = {r.cluster: r.mean_r for r in cluster.within_group_correlation(cluster.pairwise_region_correlation(df), groups).collect()}
    assert within["all"] == pytest.approx(wide.to_numpy().mean()) and within["1"] == pytest.approx(wide.iloc[:2, :2].to_numpy().mean())
    assert within["within"] == pytest.approx((within["1"] + within["2"]) / 2)


def test_correlation_of_constants_is_null(spark):
    df = spark.createDataFrame([("a", "f", i, 1.0, float(i)) for i in range(4)] + [("b", "f", i, float(i), float(-i)) for i in range(4)], "adm string, feature string, harv_year int, value double, yield double")
    assert cluster.feature_target_correlation(df).head().r == pytest.approx(-1)
    kendall = lambda n: cluster.feature_target_correlation(df.where(f"harv_year < {n}"), method="kendall").collect()
    assert [r.r for r in kendall(4)] == [pytest.approx(-1)] and kendall(3) == []  # p-values 1/12 and 1/3


def test_tau_p_values():
    """Exact ones by all orders, approximate ones by their agreement with exact ones where there are many values."""
    orders = list(permutations(range(5)))
    wrong = [sum(a > b for a, b in combinations(o, 2)) for o in orders]
    for against in range(11):
        few = min(against, 10 - against)
        want = min(1.0, sum(w <= few or w >= 10 - few for w in wrong) / len(orders))
        assert tau_p_value(10 - 2 * against, against, 5, 0, 0, 0, 0, 0, 0) == pytest.approx(want)
    exact = tau_p_value(100, 214, 33, 0, 0, 0, 0, 0, 0)
    assert tau_p_value(100, 214, 33, 1e-12, 0, 0, 0, 0, 0) == pytest.approx(exact, rel=0.05)


def test_clusters_and_events(spark):
    x = [(i, [float(i % 2 * 10), float(i % 3) / 10]) for i in range(30)]
    df = spark.createDataFrame(x, "k int, features array<double>")
    out = {r.k: r.cluster for r in cluster.kmeans_regions(df, 2).collect()}
    assert len({out[i] for i in range(0, 30, 2)}) == 1 and out[0] != out[1]
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(size=(40, 3)) + c for c in ([0, 0, 0], [6, 0, 0], [0, 7, 0], [3, 3, 9])])
    many = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "k int, features array<double>")
    within = {}
    for k in (2, 4):
        own = np.array([r.cluster for r in cluster.kmeans_regions(many, k).orderBy("k").collect()])
        distances = ((points[:, None] - np.array([points[own == c].mean(0) for c in range(k)])) ** 2).sum(-1)
        assert (distances.argmin(1) == own).all()  # each point is nearest to the mean of its own cluster
        within[k] = distances.min(1).sum()
    found = {r.k: (r.wcss, r.silhouette) for r in cluster.kmeans_elbow(many, 4).collect()}
    assert found[4][0] == pytest.approx(within[4] / within[2]) and max(found, key=lambda k: found[k][1]) == 4
    between = np.array([[((p - points[own == c]) ** 2).sum(-1).sum() / (np.sum(own == c) - (own[i] == c)) for c in range(4)] for i, p in enumerate(points)])
    inner = between[np.arange(160), own]
    other = np.where(np.arange(4) == own[:, None], np.inf, between).min(1)
    assert found[4][1] == pytest.approx(((other - inner) / np.maximum(inner, other)).mean())
    elbow = [(r.k, r.wcss) for r in cluster.kmeans_elbow(df, 3).orderBy("k").collect()]
    assert elbow[0] == (2, 1.0) and elbow[1][1] < 1
    events = spark.createDataFrame([(2000, 3), (2000, 4), (2005, 1)], "year int, fatalities int")
    yields = spark.createDataFrame([(2001, 1.0), (2001, 3.0), (2002, 9.0)], "harv_year int, yield double")
    assert list(map(tuple, cluster.lagged_event_join(yields, events).collect())) == [(2001, 2.0, 7)]


def test_information_takes_all_rows(spark):
    """By brute force on values with and without ties; and a fold of more than 20,000 rows is not thinned out."""
    rng = np.random.default_rng(4)
    for n, digits in ((300, 1), (300, 9), (900, 0)):
        x = rng.normal(size=n).round(digits)
        y = (x + rng.normal(size=n)).round(digits)
        a, b = ((v - v.mean()) / v.std() for v in (x, y))
        dx, dy = np.abs(a[:, None] - a), np.abs(b[:, None] - b)
        reach = np.sort(np.maximum(dx, dy), axis=1)[:, 3:4]
        counts = [np.maximum((d < reach - 1e-9).sum(1) - (reach[:, 0] > 1e-9), 0) for d in (dx, dy)]
        want = digamma(np.array([3.0]))[0] + digamma(np.array([float(n)]))[0] - sum(digamma(c + 1).mean() for c in counts)
        assert knn_information(x, y) == pytest.approx(max(0.0, want), abs=1e-9)
    x = rng.normal(size=25_000)
    y = x + rng.normal(size=25_000)
    df = spark.createDataFrame(pd.DataFrame({"split": "s", "year_out": 1, "a": x, "yield": y}))
    assert selection.mutual_information(df, ["a"], "yield").head().mi == pytest.approx(knn_information(x, y), abs=1e-9)


def test_wide_ridge_is_planned_and_fitted_in_seconds(spark):
    """300 features: the plan does not grow with their square; one fold against numpy."""
    import time

    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 300))
    y = x[:, 0] - 2 * x[:, 299] + 0.1 * rng.normal(size=240)
    names = [f"f{i}" for i in range(300)]
    rows = [("s", f"r{i % 40}", 2000 + i // 40, float(y[i]), 0.0, x[i].tolist()) for i in range(240)]
    df = spark.createDataFrame(rows, "split string, adm string, harv_year int, yield double, y_bench double, x array<double>")
    df = df.select("split", "adm", "harv_year", "yield", "y_bench", *[F.col("x")[i].alias(n) for i, n in enumerate(names)])
    start = time.perf_counter()
    out = models.fold_model(df, "split", names, grid=[{"alpha": 1.0}], upper=1e9, keep=[], n_folds=2)
    assert time.perf_counter() - start < 20
    got = {(r.adm, r.year_out): r.y_pred for r in out.collect()}
    train, test = np.arange(240) >= 40, np.arange(240) < 40
    m, s = x[train].mean(0), x[train].std(0)
    z = (x[train] - m) / s
    w = np.linalg.solve(z.T @ z / 200 + np.eye(300), z.T @ (y[train] - y[train].mean()) / 200)
    want = (x[test] - m) / s @ w + y[train].mean()
    assert [got[f"r{i}", 2000] for i in range(40)] == pytest.approx(want.tolist(), abs=1e-8)


def test_gram_sums(spark):
    from fieldloom.functions.gram import gram_sums, unpacked

    rng = np.random.default_rng(6)
    z = rng.normal(size=(50, 17))
    rows = [(["a", "b", None][i % 3], i % 2, z[i].tolist()) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, j int, z array<double>").repartition(4)
    got = {(r.k, r.j): unpacked(np.array(r.v), 17) for r in gram_sums(df, ["k", "j"], "z", 17).collect()}
    assert len(got) == 6
    for (k, j), m in got.items():
        own = z[[i for i, r in enumerate(rows) if r[:2] == (k, j)]]
        assert np.allclose(m, own.T @ own) and (m == m.T).all()
    assert gram_sums(df.limit(0), ["k"], "z", 17).count() == 0


@pytest.mark.parametrize("scope", ["block", "column"])
def test_region_codes_equal_indicator_columns(spark, scope):
    """50 regions as one column against 50 scaled columns; 10,000 regions stay one column."""
    rows = [(f"r{i * i % 50:02d}", i) for i in range(400)] + [(f"r{i:02d}", 1000 + i) for i in range(50)]
    df = spark.createDataFrame(rows, "adm string, i int").repartition(3)
    names = sorted({r for r, _ in rows})
    dense = folds.make_x(folds.one_hot_regions(df, names), [[f"adm_{n}" for n in names]], scope=scope)
    want = {r.i: [r[f"adm_{n}"] for n in names] for r in dense.collect()}
    codes = folds.region_codes(df, scope=scope)
    table = {r.adm: r for r in codes.collect()}
    assert [table[n].place for n in names] == list(range(50))
    coded = folds.coded_regions(df, codes)
    assert coded.columns == ["adm", "i", "adm_code"]
    for r in coded.collect():
        got = [table[n].low for n in names]
        got[r.adm_code.place] = r.adm_code.high
        assert got == pytest.approx(want[r.i])
    many = spark.range(20_000).select(F.concat(F.lit("r"), (F.col("id") % 10_000).cast("string")).alias("adm"))
    wide = folds.coded_regions(many, folds.region_codes(many, scope=scope))
    assert len(wide.columns) == 2 and wide.agg(F.countDistinct("adm_code.place")).first()[0] == 10_000
    odd = spark.createDataFrame([(None,), ("x",), ("x",)], "adm string")
    assert {r.adm: r.adm_code is None for r in folds.coded_regions(odd, folds.region_codes(odd, scope=scope)).collect()} == {None: True, "x": False}
    assert folds.region_codes(df.limit(0)).count() == 0


def test_misplaced_points_are_counted(spark):
    """Against numpy, on clusters that are not settled; empty rows give zeros, and settled k-means has none."""
    x = np.random.default_rng(7).normal(size=(400, 3))
    given = np.arange(400) % 4
    rows = spark.createDataFrame([(int(c), v.tolist()) for c, v in zip(given, x)], "cluster int, v array<double>")
    means = np.array([x[given == c].mean(0) for c in range(4)])
    gaps = ((x[:, None] - means) ** 2).sum(2)
    want = (gaps[np.arange(400), given] > gaps.min(1) + 1e-9).sum()
    assert tuple(cluster.misplaced(rows, "v").head()) == (400, 4, want) and want > 100
    assert tuple(cluster.misplaced(cluster.kmeans_regions(rows.drop("cluster"), 4, "v", max_iter=500, tol=0.0), "v").head()) == (400, 4, 0)
    assert tuple(cluster.misplaced(rows.limit(0), "v").head()) == (0, 0, 0)
