import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import numeric as N


def test_t_tail_against_table():
    for t, dof, p in ((2.228, 10, 0.05), (3.169, 10, 0.01), (12.706, 1, 0.05), (1.96, 1e6, 0.05), (0.0, 5, 1.0)):
        assert N.t_two_sided_p(t, dof) == pytest.approx(p, abs=2e-5)
    assert N.t_two_sided_p(math.inf, 3) == 0.0


def test_gamma_against_integration():
    for a in (0.3, 1.0, 2.5, 40.0):
        for x in (0.1, 1.0, 3.0, 50.0):
            u = np.linspace(0, x ** (a if a < 1 else 1), 200_001)[1:]
            if a < 1:  # substitute t = u^(1/a), which takes the pole away
                f = np.exp(-(u ** (1 / a))) / a
            else:
                f = u ** (a - 1) * np.exp(-u)
            area = np.trapezoid(np.r_[1 / a if a < 1 else (1.0 if a == 1 else 0.0), f], np.r_[0.0, u])
            assert float(N.gamma_p(a, x)) == pytest.approx(area / math.gamma(a), rel=1e-4, abs=1e-9)
    assert float(N.gamma_p(2.0, 0.0)) == 0.0


def test_digamma_trigamma_and_fit():
    assert N.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649, abs=1e-9)
    assert N.trigamma(np.array([1.0]))[0] == pytest.approx(math.pi**2 / 6, abs=1e-8)
    x = np.random.default_rng(0).gamma(3.0, 2.0, 200_000)
    a, scale = N.gamma_mle(np.array([x.mean()]), np.array([np.log(x).mean()]))
    assert a[0] == pytest.approx(3.0, rel=0.02) and scale[0] == pytest.approx(2.0, rel=0.02)


@pytest.mark.parametrize("window", [1, 4, 5, 30])
def test_gaussian_smooth_against_loop(window):
    v = np.random.default_rng(1).normal(size=50)
    v[[0, 7, 8, 9, 49]] = np.nan
    std, out = window / 3, []
    for i in range(len(v)):
        s = w = 0.0
        for lag in range(-(window // 2), (window + 1) // 2):
            if 0 <= i + lag < len(v) and not np.isnan(v[i + lag]):
                g = math.exp(-0.5 * ((lag + (0.5 if window % 2 == 0 else 0)) / std) ** 2)
                s, w = s + g * v[i + lag], w + g
        out.append(s / w if w else np.nan)
    np.testing.assert_allclose(N.gaussian_smooth(v, window, std), out, rtol=1e-9)


def test_rings_with_a_hole_and_a_part():
    square = lambda x, y, n: np.array([(x, y), (x + n, y), (x + n, y + n), (x, y + n)], float)
    rings = [square(0, 0, 10), square(3, 3, 2), square(20, 20, 1)]
    got = N.points_in_rings(np.array([1.0, 4.0, 20.5, 15.0]), np.array([1.0, 4.0, 20.5, 5.0]), rings)
    assert got.tolist() == [True, False, True, False]


def test_information_grows_with_dependence():
    rng = np.random.default_rng(2)
    x = rng.normal(size=600)
    free, tied = N.knn_information(x, rng.normal(size=600)), N.knn_information(x, x + 0.1 * rng.normal(size=600))
    assert free < 0.1 and tied > 1.2
    r = 0.8
    y = r * x + math.sqrt(1 - r * r) * rng.normal(size=600)
    assert N.knn_information(x, y) == pytest.approx(-0.5 * math.log(1 - r * r), abs=0.12)
    assert N.knn_information(np.ones(50), np.ones(50)) >= 0


def test_vif_lasso_and_process():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    x = np.c_[x, x[:, 0] + 0.01 * rng.normal(size=300)]
    corr = np.corrcoef(x.T)
    assert N.greedy_vif(corr, [0, 3, 1, 2]) == [0, 1, 2]
    assert N.greedy_vif(np.ones((2, 2)), [0, 1]) == [0]
    gram, cross = x[:, :3].T @ x[:, :3] / 300, x[:, :3].T @ (2 * x[:, 0]) / 300
    assert N.lasso_weights(gram, cross, 0.0) == pytest.approx([2, 0, 0], abs=1e-6)
    w = N.lasso_weights(gram, cross, 0.5)
    assert 0 < w[0] < 2 and abs(w[1]) < 1e-9
    t = np.linspace(0, 1, 40)
    y = np.sin(6 * t)
    out = N.gp_predict(t[:, None], t, y, t[::7, None], t[::7], 1.0, 0.3, 1.0, 1e-4)
    np.testing.assert_allclose(out, y[::7], atol=0.02)


@pytest.mark.parametrize("array,parts", [(4096, 256), (8, 4), (1, 2)])
def test_grouped_quantiles_are_exact(spark, monkeypatch, array, parts):
    """Against numpy, and against what one buffer a group gives: ties, outliers, infinities, nulls, single values and a large group."""
    from fieldloom.functions import quantiles

    monkeypatch.setattr(quantiles, "ARRAY", array)
    monkeypatch.setattr(quantiles, "PARTS", parts)
    rng = np.random.default_rng(2)
    groups = {"many": rng.normal(size=700), "ties": rng.integers(0, 3, 300).astype(float), "one": np.array([4.0]), "far": np.array([1e-300, 2.0, 3.0, -1.7e308, 1.7e308] * 9), None: np.array([1.0, 2.0]), "same": np.full(50, 7.5)}
    rows = [(k, float(x)) for k, values in groups.items() for x in values] + [("many", None), ("nothing", None), ("nothing", float("nan"))]
    df = spark.createDataFrame(rows, "k string, x double").repartition(3)
    wanted = [0.0, 0.025, 0.3, 0.5, 0.975, 1.0]
    got = {r.k: r.quantiles for r in quantiles.grouped_quantiles(df, ["k"], "x", wanted).collect()}
    one = {r.k: r.q for r in df.where("NOT isnan(x)").groupBy("k").agg(F.percentile("x", F.array(*map(F.lit, wanted))).alias("q")).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert got[k] == pytest.approx(np.quantile(values, wanted).tolist() if k != "far" else one[k], rel=1e-12)
        assert got[k] == pytest.approx(one[k], rel=1e-12)
    assert quantiles.grouped_quantiles(df.limit(0), ["k"], "x", wanted).count() == 0


def test_gamma_columns(spark):
    """Shapes, probabilities and quantiles as columns equal the numpy ones; the far tails and large shapes too."""
    from statistics import NormalDist

    from fieldloom.functions import gamma as G

    rng = np.random.default_rng(5)
    rows = []
    for a in (0.05, 0.4, 1.0, 3.3, 40.0, 900.0, 3e4):
        x = rng.gamma(a, 1 / a, 500)
        rows += [(float(x.mean()), float(np.log(np.maximum(x, 1e-300)).mean()), a, float(r)) for r in (1e-3, 0.3, 0.97, 1.0, 1.02, 1.8, 3.0) if abs(math.log(r)) * math.sqrt(a) < 5]
    df = spark.createDataFrame(rows, "mean double, log double, a double, r double")
    got = df.select("*", G.gamma_shape(F.col("mean"), F.col("log")).alias("shape"), G.gamma_probability(F.col("a"), F.col("r")).alias("p"), G.digamma(F.col("a")).alias("d"), G.trigamma(F.col("a")).alias("t")).collect()
    for g in got:
        assert g.shape == pytest.approx(float(N.gamma_mle(np.array([g.mean]), np.array([g.log]))[0][0]), rel=1e-8)
        assert g.p == pytest.approx(float(N.gamma_p(g.a, g.a * g.r)), rel=1e-8, abs=1e-12)
        assert g.d == pytest.approx(float(N.digamma(np.array([g.a]))[0]), rel=1e-9) and g.t == pytest.approx(float(N.trigamma(np.array([g.a]))[0]), rel=1e-8)
    ps = [1e-300, 1e-20, 1e-9, 0.01, 0.075, 0.2, 0.5, 0.925, 0.93, 1 - 1e-12]
    q = spark.createDataFrame([(p,) for p in ps], "p double").select(G.normal_quantile(F.col("p")).alias("q")).collect()
    assert [r.q for r in q] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-12, abs=1e-15)
    ends = spark.createDataFrame([(2.0, 0.0), (2.0, -1.0), (5e11, 1.0), (1e5, 1.003), (99999.0, 1.003)], "a double, r double").select(G.gamma_score(F.col("a"), F.col("r")).alias("z")).collect()
    assert ends[0].z == ends[1].z == -math.inf and ends[2].z == pytest.approx(0, abs=1e-6) and ends[3].z == pytest.approx(ends[4].z, abs=1e-4)
