import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions.numeric import points_in_rings
from fieldloom.operators import indices, profiles, season, zonal
from fieldloom.streaming.zonal import write_stream, zonal_means


def cells(spark, grid):
    rows = [(i, j, None if v is None else float(v)) for i, line in enumerate(grid) for j, v in enumerate(line)]
    return spark.createDataFrame(rows, "row int, col int, value double")


def by_cell(df):
    return {(r.row, r.col): r.value for r in df.collect()}


def test_regrid_and_fill(spark):
    grid = cells(spark, [[1, 2, 3, None], [3, 4, None, None], [5, 5, 7, 7], [5, 5, 7, 9]])
    assert by_cell(zonal.regrid_average(grid, 2, 2)) == {(0, 0): 2.5, (0, 1): 3.0, (1, 0): 5.0, (1, 1): 7.5}
    filled = by_cell(zonal.fill_null_from_neighbors(grid))
    assert filled[0, 3] == 3.0 and filled[1, 3] == pytest.approx((3 + 7 + 7) / 3) and filled[1, 2] == pytest.approx((2 + 3 + 4 + 5 + 7 + 7) / 6)
    alone = cells(spark, [[None, None, None, 1]])
    assert by_cell(zonal.fill_null_from_neighbors(alone))[0, 0] is None and by_cell(zonal.fill_null_from_neighbors(alone, 3))[0, 0] == 1.0
    target = spark.createDataFrame([(1, 1), (0, 3)], "row int, col int")
    half = by_cell(zonal.regrid_bilinear(grid, target, 0.5, 0.5))
    assert half[1, 1] == pytest.approx((1 + 2 + 3 + 4) / 4) and half[0, 3] == pytest.approx((2 + 3) / 2)


def test_zonal_statistics(spark):
    mask = spark.createDataFrame([("a", 0, 0, 1), ("a", 0, 1, 3), ("a", 0, 2, 0), ("b", 0, 1, 2), ("c", 9, 9, 1)], "adm string, row int, col int, weight int")
    pixels = spark.createDataFrame([(1, 0, 0, 10.0), (1, 0, 1, 20.0), (1, 0, 2, float("nan")), (2, 0, 0, 0.0), (2, 0, 1, None), (1, 5, 5, 99.0)], "date int, row int, col int, value double")
    mean = {(r.adm, r.date): r.mean for r in zonal.zonal_mean(pixels, mask).collect()}
    assert mean == {("a", 1): 15.0, ("b", 1): 20.0, ("a", 2): 0.0, ("b", 2): None}
    quality = {(r.adm, r.date): (r.quality, r.mean) for r in zonal.zonal_mean_quality(pixels, mask, min_quality=0.5).collect()}
    assert quality["a", 1] == (pytest.approx(2 / 3), pytest.approx(0.15)) and quality["a", 2] == (0.0, None)
    weighted = {(r.adm, r.date): r.mean for r in zonal.zonal_weighted_mean(pixels, mask).collect()}
    assert weighted["a", 1] == pytest.approx((10 + 60) / 4) and weighted["b", 2] is None
    hist = {(r.adm, r.date): r.histogram for r in zonal.zonal_histogram(pixels, mask, 0, 20, 4).collect()}
    assert hist["a", 1] == [0, 0, 50, 50] and hist["a", 2] == [100, 0, 0, 0] and hist["b", 2] is None
    assert all(h is None or sum(h) == pytest.approx(100) for h in hist.values())


def test_regions(spark):
    ring = lambda *p: [tuple(map(float, x)) for x in p]
    shapes = spark.createDataFrame([("a", [ring((0, 0), (2, 0), (2, 2), (0, 2))]), ("b", [ring((1, 0), (3, 0), (3, 1), (1, 1))])], "adm string, rings array<array<struct<lon:double,lat:double>>>")
    grid = spark.range(9).select((F.col("id") % 3).cast("int").alias("col"), F.expr("cast(id div 3 as int)").alias("row")).withColumns({"lon": F.col("col") + 0.5, "lat": F.col("row") + 0.5})
    for tile in (None, 0.4, 1.0, 7.0):
        got = sorted(map(tuple, zonal.region_pixels(grid, shapes, tile).collect()))
        assert got == [("a", 0, 0), ("a", 0, 1), ("a", 1, 0), ("a", 1, 1), ("b", 0, 1), ("b", 0, 2)]
    merged = zonal.merge_regions(zonal.region_pixels(grid, shapes), [(["a"], "x"), (["x", "b"], "y")])
    assert merged.count() == 5 and {r.adm for r in merged.collect()} == {"y"}
    empty = spark.createDataFrame([("n", []), ("m", None)], shapes.schema)
    assert zonal.region_pixels(grid, empty).count() == 0 and zonal.region_pixels(grid, shapes.unionAll(empty)).count() == 6
    rows = spark.createDataFrame([("a", 1, "p"), ("b", 2, "q")], "adm string, ord int, kind string")
    assert zonal.merge_regions(rows, [(["a", "b"], "n")], attributes=["kind"], order="ord").head().kind == "q"
    with pytest.raises(Exception, match="no size"):
        zonal.zonal_static(spark.createDataFrame([("size", 0, 0, None)], "property string, row int, col int, value double"), spark.createDataFrame([("a", 0, 0)], "adm string, row int, col int"), ["size"]).collect()


def test_nearest_donors_against_brute_force(spark):
    """Scattered and crowded centroids, far ones, and ties, which go by name."""
    rng = np.random.default_rng(8)
    spots = [*rng.uniform(0, 10, (60, 2)), *rng.normal(5, 0.01, (40, 2)), [500.0, -300.0], [20.0, 20.0], [5.0, 5.0], [5.0, 5.0]]
    names = [f"r{i:03d}" for i in range(len(spots))]
    centroids = spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in zip(names, spots)], "adm string, lon double, lat double")
    for known in (set(names[::2]), set(names[:1]), set(names) - {"r100"}):
        calendar = spark.createDataFrame([(n, i) for i, n in enumerate(names) if n in known], "adm string, sos int")
        got = dict(map(tuple, profiles.fill_from_nearest(calendar, centroids, ["sos"]).collect()))
        for i, n in enumerate(names):
            near = min(known, key=lambda k: (((spots[i] - np.array(spots[names.index(k)])) ** 2).sum(), k)) if n not in known else n
            assert got[n] == names.index(near)
    assert profiles.fill_from_nearest(calendar.limit(0), centroids, ["sos"]).count() == 0


def daily(spark, values, adm="a", start=dt.date(2001, 1, 1)):
    return spark.createDataFrame([(adm, start + dt.timedelta(i), None if v is None or np.isnan(v) else float(v)) for i, v in enumerate(values)], "adm string, date date, value double")


def values(df):
    return [r.value for r in df.orderBy("date").collect()]


def test_profiles_against_numpy(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=800) + 5 * np.sin(np.arange(800) / 60)
    v[[3, 4, 5, 700]] = np.nan
    days = np.array([(dt.date(2001, 1, 1) + dt.timedelta(i)).timetuple().tm_yday for i in range(800)])
    basis = lambda d: np.c_[np.full(len(d), 0.5), *[f(2 * np.pi * k * d / 365) for k in range(1, 6) for f in (np.cos, np.sin)]]
    ok = ~np.isnan(v)
    beta = np.linalg.lstsq(basis(days[ok]), v[ok], rcond=None)[0]
    got = [r.value for r in profiles.fourier_profile(daily(spark, v)).orderBy("doy").collect()]
    np.testing.assert_allclose(got, basis(np.arange(1, 366)) @ beta, atol=1e-7)
    filled = values(profiles.fill_gaps_fourier(daily(spark, v)))
    np.testing.assert_allclose(filled, np.where(ok, v, basis(days) @ beta), atol=1e-7)
    scaled = lambda d: np.stack([((d - 183) / 182.0) ** k for k in range(4)], 1)
    poly = [r.value for r in profiles.polynomial_profile(daily(spark, v), 3).orderBy("doy").collect()]
    np.testing.assert_allclose(poly, scaled(np.arange(1, 366)) @ np.linalg.lstsq(scaled(days[ok]), v[ok], rcond=None)[0], atol=1e-6)


@pytest.mark.parametrize("window", [5, 6, 30])
def test_gaussian_window_in_plan_equals_helper(spark, window):
    from fieldloom.functions.numeric import gaussian_smooth

    v = np.random.default_rng(1).normal(size=60)
    v[[0, 10, 11, 12, 13, 14, 15, 16, 59]] = np.nan
    got = np.array(values(profiles.rolling_gaussian(daily(spark, v), window)), dtype=float)
    np.testing.assert_allclose(got, gaussian_smooth(v, window, window / 3), rtol=1e-9)


def test_interpolation(spark):
    got = values(profiles.interpolate_linear(daily(spark, [np.nan, 1, np.nan, np.nan, 4, np.nan])))
    assert got == [1, 1, 2, 3, 4, 4]
    assert values(profiles.interpolate_linear(daily(spark, [np.nan, np.nan]))) == [None, None]


def walk(v, threshold):
    """The season's days by walking round the year."""
    level, n = min(v) + threshold * (max(v) - min(v)), len(v)
    if max(v) == min(v):
        return None, None
    at = v.index(min(v))
    forward = next(i % n + 1 for i in range(at + 1, at + n) if v[i % n] > level)
    backward = next(i % n + 1 for i in range(at - 1, at - n, -1) if v[i % n] > level)
    return forward, backward + 1


@pytest.mark.parametrize("shift", [0, 1, 100, 364])
def test_season_by_walking(spark, shift):
    v = [float(round(100 + 50 * np.cos(2 * np.pi * (i - shift) / 365), 6)) for i in range(365)]
    flat = [("flat", d + 1, 1.0) for d in range(365)]
    df = spark.createDataFrame([("a", d + 1, x) for d, x in enumerate(v)] + flat, "adm string, doy int, value double")
    got = {r.adm: (r.sos, r.eos) for r in profiles.detect_season(df, 0.5).collect()}
    assert got == {"a": walk(v, 0.5), "flat": (None, None)}


def test_donors_of_donors(spark):
    cal = spark.createDataFrame([("p", "s1", 1), ("p", "s2", 2), ("q", "s1", 9)], "adm1 string, season string, sos int")
    got = sorted(map(tuple, profiles.fill_from_donor(cal, [("q", "p"), ("r", "q")], ["sos"]).collect()))
    assert got == [("p", "s1", 1), ("p", "s2", 2), ("q", "s1", 1), ("q", "s2", 2), ("r", "s1", 1), ("r", "s2", 2)]


def test_indices(spark):
    rng = np.random.default_rng(2)
    start, v = dt.date(2001, 1, 1), rng.gamma(2, 3, 365 * 8)
    v[100] = 0.0
    df = daily(spark, v, start=start)
    z = values(indices.standardized_index(df, detrend=False))
    days = np.array([min(365, (start + dt.timedelta(i)).timetuple().tm_yday) for i in range(len(v))])
    same = v[days == 50]
    np.testing.assert_allclose(np.array(z)[days == 50], (same - same.mean()) / same.std(), atol=1e-9)
    assert set(np.array(z)[days == 101]) == {0.0}
    g = np.array(values(indices.standardized_index(df, dist="gamma", detrend=False)), float)
    assert set(g[days == 101]) == {0.0} and abs(g.mean()) < 0.05 and g.std() == pytest.approx(1, abs=0.1)
    assert (np.argsort(g[days == 50]) == np.argsort(same)).all()
    rising = values(indices.standardized_index(daily(spark, v + np.arange(len(v)) * 0.05)))
    assert abs(np.corrcoef(np.array(rising, float), np.arange(len(v)))[0, 1]) < 0.1
    report = indices.trend_report(daily(spark, v + np.arange(len(v)) * 0.05)).head()
    assert (report.series, report.significant_share, report.rising_share) == (1, 1.0, 1.0)
    assert values(indices.fill_small_gaps(daily(spark, [1, np.nan, 3, np.nan, np.nan, 0]))) == [1, 2, 3, 3, 0, 0]


def one_season(spark, v):
    return daily(spark, v).withColumn("harv_year", F.lit(2001))


def test_segments_and_empty_ones(spark):
    got = {(r.func, r.step): r.value for r in season.segment_aggregate(one_season(spark, range(10)), 9, ["mean", "max-cdd"]).collect()}
    assert [got["mean", i] for i in range(1, 10)] == [0.5, 2.5, 4.5, 6.5, 8.5, None, None, None, 9.0]
    assert got["max-cdd", 1] == 1.0 and got["max-cdd", 9] == 0.0
    dry = season.max_consecutive_dry_days(one_season(spark, [0, 0, 5, 0, 0, 0]), ["adm"])
    assert dry.head().max_cdd == 3 and season.max_consecutive_dry_days(one_season(spark, [2, 3]), ["adm"]).head().max_cdd == 0


def test_rescale(spark):
    v = list(np.random.default_rng(3).normal(size=20))
    take = lambda n: season.rescale_series(one_season(spark, v), n).head()["values"]
    assert take(20) == v
    np.testing.assert_allclose(take(32), np.interp(np.linspace(0, 19, 32), np.arange(20), v))
    np.testing.assert_allclose(take(12), np.interp(np.linspace(0, 19, 12), np.arange(20), v))
    np.testing.assert_allclose(take(5), np.array(v).reshape(5, 4).mean(1))


def test_season_windows_overlap_and_second_path(spark, monkeypatch):
    yields = spark.createDataFrame([("a", 2002), ("a", 2003), ("z", 2002)], "adm string, harv_year int")
    cal = spark.createDataFrame([("a", 300, 330), ("z", 1, 2)], "adm string, sos int, eos int")
    series = daily(spark, range(1200), start=dt.date(2000, 6, 1))
    first = sorted(map(tuple, season.season_window_join(yields, cal, series).collect()))
    monkeypatch.setattr(season, "BROADCAST_WINDOWS", 0)
    assert first == sorted(map(lambda r: (r.adm, r.date, r.value, r.harv_year), season.season_window_join(yields, cal, series).collect()))
    dates = [r[1] for r in first if r[3] == 2002]
    assert (min(dates), max(dates)) == (dt.date(2001, 1, 1) + dt.timedelta(239), dt.date(2002, 1, 1) + dt.timedelta(269))
    with pytest.raises(ValueError, match="no date"):
        season.season_window_join(yields, cal, series, strict=True)


def test_tensor_scaling(spark):
    yields = spark.createDataFrame([("a", 2002)], "adm string, harv_year int")
    cal = spark.createDataFrame([("a", 300, 330)], "adm string, sos int, eos int")
    base = daily(spark, np.random.default_rng(4).uniform(1, 9, 900), start=dt.date(2000, 6, 1))
    series = base.withColumn("feature", F.lit("ndvi")).unionByName(base.withColumn("feature", F.lit("preci")))
    tensor = np.array(season.timeseries_tensor(yields, cal, series, ["ndvi", "preci"]).head().tensor)
    assert tensor.shape == (32, 2) and tensor[:, 0].mean() == pytest.approx(0, abs=1e-9)
    assert tensor.std(0) == pytest.approx([1, 1]) and tensor[:, 1].min() > 0


def test_stream_of_pixels(spark, tmp_path):
    mask = spark.createDataFrame([("a", 0, 0), ("b", 0, 1)], "adm string, row int, col int")
    schema = "ts timestamp, row int, col int, value double"
    day = lambda d: dt.datetime(2020, 1, d)
    source = str(tmp_path / "in")
    spark.createDataFrame([(day(1), 0, 0, 2.0), (day(1), 0, 0, 4.0), (day(1), 0, 1, None), (day(2), 0, 1, 5.0)], schema).write.parquet(source)
    run = lambda: write_stream(zonal_means(spark.readStream.schema(schema).parquet(source), mask), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert run()
    spark.createDataFrame([(day(20), 0, 0, 9.0), (day(1), 0, 0, 100.0)], schema).write.mode("append").parquet(source)
    assert run()
    got = sorted((r.adm, r.start.day, r.n, r.mean) for r in spark.read.schema("adm string, start timestamp, n long, mean double").parquet(str(tmp_path / "out")).collect())
    assert ("b", 2, 1, 5.0) in got and got[0][:2] == ("a", 1) and not any(d == 20 for _, d, _, _ in got)


def test_touched_cells_against_plain_geometry(spark):
    """A cell is touched if a point of a fine sample of the region, edges included, lies in it or the cell's centre in the region."""
    cells = [(r, c, c * 0.7, r * 0.4) for r in range(12) for c in range(14)]
    shapes = {"triangle": [[(0.31, 0.22), (5.03, 1.13), (2.17, 3.91)]], "speck": [[(3.6, 2.11), (3.62, 2.11), (3.61, 2.13)]], "hole": [[(1.11, 0.53), (8.07, 0.61), (8.13, 4.02), (1.02, 3.9)], [(2.93, 1.22), (6.1, 1.19), (6.03, 3.31), (3.02, 3.37)]]}
    df = spark.createDataFrame(cells, "row int, col int, lon double, lat double")
    point = lambda p: {"lon": p[0], "lat": p[1]}
    polygons = spark.createDataFrame([(n, [[point(p) for p in ring] for ring in rings]) for n, rings in shapes.items()], "adm string, rings array<array<struct<lon:double,lat:double>>>")
    want = set()
    for name, rings in shapes.items():
        edge = np.concatenate([p + np.linspace(0, 1, 4001)[:, None] * (q - p) for ring in rings for p, q in zip(np.array(ring), np.roll(np.array(ring), -1, axis=0))])
        for r, c, lon, lat in cells:
            on_edge = ((np.abs(edge[:, 0] - lon) <= 0.35) & (np.abs(edge[:, 1] - lat) <= 0.2)).any()
            within = points_in_rings(np.array([lon]), np.array([lat]), [np.array(ring) for ring in rings])[0]
            if on_edge or within:
                want.add((name, r, c))
    for tile in (None, 1.0, 50.0):
        got = [tuple(x) for x in zonal.region_pixels(df, polygons, tile, touched=(0.7, 0.4)).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    centres = {tuple(x) for x in zonal.region_pixels(df, polygons).collect()}
    assert centres < want and not any(n == "speck" for n, *_ in centres) and sum(n == "speck" for n, *_ in want) == 1
    assert zonal.region_pixels(df.limit(0), polygons, touched=(1.0, 1.0)).count() == 0


@pytest.mark.parametrize("source,target", [((0, 1, 0, 1), (0, 2, 0, 3)), ((0.5, 0.25, -3, 0.7), (-1.1, 1.0, -2.9, 0.45)), ((0, 1, 0, 1), (0.4, 0.3, 0.1, 0.37))])
def test_overlap_weights(spark, source, target):
    """Against a fine sample of every axis; a constant stays itself; what the target covers adds up."""
    rng = np.random.default_rng(3)
    values = {(r, c): None if (r + c) % 5 == 0 else float(rng.normal()) for r in range(5) for c in range(6)}
    df = spark.createDataFrame([(r, c, v, "d") for (r, c), v in values.items()], "row int, col int, value double, date string")
    got = {(r.row, r.col): (r.value, r.covered) for r in zonal.regrid_overlap(df, zonal.Grid(*source), zonal.Grid(*target), by=["date"]).collect()}
    shared = lambda i, k, axis: max(0.0, min(source[axis] + (i + 1) * source[axis + 1], target[axis] + (k + 1) * target[axis + 1]) - max(source[axis] + i * source[axis + 1], target[axis] + k * target[axis + 1])) / target[axis + 1]
    want = {}
    for (r, c), v in values.items():
        for k in range(-30, 30):
            for m in range(-30, 30):
                w = shared(r, k, 0) * shared(c, m, 2)
                if v is not None and shared(r, k, 0) > 1e-9 and shared(c, m, 2) > 1e-9:
                    a, b = want.get((k, m), (0.0, 0.0))
                    want[k, m] = (a + w * v, b + w)
    assert set(got) == set(want)
    for k, (a, b) in want.items():
        assert got[k] == (pytest.approx(a / b), pytest.approx(b))
    area = sum(v is not None for v in values.values()) * source[1] * source[3]
    assert sum(b for _, b in got.values()) * target[1] * target[3] == pytest.approx(area)
