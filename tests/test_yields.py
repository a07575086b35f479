import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import cleaning as C
from fieldloom.operators.benchmark import benchmark_predictions
from fieldloom.operators.trends import linear_trend, standardized_yield

GROUP = ["adm"]


def series(spark, values, adm="a", start=2001):
    return spark.createDataFrame([(adm, start + i, None if v is None else float(v)) for i, v in enumerate(values)], "adm string, harv_year int, yield double")


def test_conflicting_duplicates(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), ("c", None), ("c", None)], "k string, v int")
    assert sorted((r.k, r.v) for r in C.drop_conflicting_duplicates(df, ["k"]).collect()) == [("a", 1), ("c", None)]


def test_consistency_keeps_what_cannot_be_told(spark):
    df = spark.createDataFrame([(100.0, 200.0, 2.01), (100.0, 200.0, 2.06), (0.0, 5.0, 1.0), (None, 5.0, 1.0)], "area double, production double, yield double")
    got = C.consistency_filter(df).collect()
    assert sorted((str(r.area), r["yield"]) for r in got) == [("0.0", None), ("100.0", 2.0), ("None", None)]


@pytest.mark.parametrize("degree", [1, 2])
@pytest.mark.parametrize("partitions", [1, 7])
def test_polynomial_residuals_against_numpy(spark, degree, partitions):
    rng = np.random.default_rng(degree)
    frames = {a: rng.normal(size=n).cumsum() for a, n in (("a", 25), ("b", 6), ("few", 4))}
    df = None
    for a, v in frames.items():
        part = series(spark, v, a)
        df = part if df is None else df.unionAll(part)
    df = df.unionAll(series(spark, [3.0] * 8, "flat")).repartition(partitions)
    got = {(r.adm, r.harv_year): r.z for r in C.polyfit_z(df, GROUP, "yield", degree).collect()}
    for a in ("a", "b"):
        x, y = np.arange(len(frames[a])), frames[a]
        r = y - np.polyval(np.polyfit(x, y, degree), x)
        np.testing.assert_allclose([got[a, 2001 + i] for i in x], r / r.std(), atol=1e-6)
    assert all(got["few", 2001 + i] is None for i in range(4)) and all(got["flat", 2001 + i] is None for i in range(8))


def test_outlier_sides_and_repeats(spark):
    values = [1.0, 1.1, 0.9] * 10
    low = C.polyfit_outliers(series(spark, [*values, -9.0, *values]), GROUP, "yield", side="high")
    both = C.polyfit_outliers(series(spark, [*values, -9.0, *values]), GROUP, "yield")
    assert low.where("outlier").count() == 0 and [r["yield"] for r in both.where("outlier").collect()] == [-9.0]
    marked = C.suspicious_repeats(series(spark, [1, 1, 2, None, 3, 3.5]), GROUP).orderBy("harv_year")
    assert [r.suspicious for r in marked.collect()] == [True, True, False, False, False, False]


def test_merges(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 0.0), (4, 5.0)], "k int, yield double")
    b = spark.createDataFrame([(1, 1.005), (2, 2.0), (3, 0.0), (9, 7.0)], "k int, yield double")
    assert sorted(map(tuple, C.tolerant_merge(a, b, ["k"]).collect())) == [(1, 1.0, "both"), (3, 0.0, "both"), (4, 5.0, "first"), (9, 7.0, "second")]
    assert dict(map(tuple, C.merge_report(a, b, ["k"]).collect())) == {"both": 2, "first": 1, "second": 1, "inconsistent": 1}
    assert sorted(map(tuple, C.coalesce_sources(a, b, ["k"]).collect())) == [(1, 1.005), (3, 0.0), (4, 5.0), (9, 7.0)]


def test_trend_and_standardised(spark):
    v = np.array([1.0, 2.1, 2.9, 4.2, 5.0, 5.9])
    fit = linear_trend(series(spark, v), GROUP).head()
    slope, intercept = np.polyfit(np.arange(2001, 2007), v, 1)
    r = v - (slope * np.arange(2001, 2007) + intercept)
    assert (fit.slope, fit.n) == (pytest.approx(slope), 6) and fit.p_value < 1e-4
    got = [x.standardized_yield for x in standardized_yield(series(spark, v), GROUP).orderBy("harv_year").collect()]
    np.testing.assert_allclose(got, r / r.std(), atol=1e-6)
    assert linear_trend(series(spark, [1.0]), GROUP).head().p_value is None


@pytest.mark.parametrize("model", ["linear", "quadratic", "knn"])
def test_benchmark_against_refits(spark, model):
    v = np.random.default_rng(7).normal(size=9)
    got = [r.y_bench for r in benchmark_predictions(series(spark, v), model).orderBy("harv_year").collect()]
    x = np.arange(9.0)
    for i in range(9):
        a, b = np.delete(x, i), np.delete(v, i)
        if model == "knn":
            want = b[np.lexsort((a, np.abs(a - x[i])))[:4]].mean()
        else:
            want = np.polyval(np.polyfit(a, b, 1 if model == "linear" else 2), x[i])
        assert got[i] == pytest.approx(want, abs=1e-7)
    assert benchmark_predictions(series(spark, [2.0]), model).head().y_bench is None
    two = benchmark_predictions(series(spark, [2.0, 4.0]), model).orderBy("harv_year").collect()
    assert [r.y_bench for r in two] == [4.0, 2.0]


def test_clean_yield_order_does_not_matter(spark):
    rng = np.random.default_rng(5)
    rows = [("c", f"r{i % 9}", "None", "S", 1990 + i // 9, float(rng.integers(800, 3000)), 0.0, float(rng.uniform(1, 4))) for i in range(270)]
    df = spark.createDataFrame(rows, "country string, adm1 string, adm2 string, season string, harv_year int, area double, production double, yield double")
    df = df.withColumn("production", F.col("area") * F.col("yield"))
    one = sorted(map(tuple, C.clean_yield(df.coalesce(1)).collect()))
    assert one == sorted(map(tuple, C.clean_yield(df.orderBy(F.rand(1)).repartition(9)).collect())) and 0 < len(one) < 270
