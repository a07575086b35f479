"""Registered queries on pixels, profiles, the calendar, indices and season features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.gamma import QUANTILE
from fieldloom.operators import indices, profiles, season, zonal
from fieldloom.plans import fixtures as fx
from fieldloom.plans.fixtures import least_squares, recursive, rnd, slope_p, sql, steady
from fieldloom.plans.registry import Registry, table
from fieldloom.plans.yields import rounded

REGISTRY = Registry()
query = REGISTRY.query


def dated(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.col("date").cast("string"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value of each cell over all dates; a quarter of them null."""
    mean = fx.pixels(spark, sf_dir).groupBy("row", "col").agg(F.avg("value").alias("value"))
    return mean.withColumn("value", F.when((F.col("row") * 3 + F.col("col")) % 4 != 0, F.col("value")))


_CELLS = "+ cells AS (SELECT row, col, CASE WHEN (row * 3 + col) % 4 <> 0 THEN avg(value) END AS value FROM pixels GROUP BY row, col)"


@query("o29_crop_to_bbox", sql("pixels", "SELECT row, col, count(*) AS n, round(avg(value), 6) AS value FROM pixels WHERE row BETWEEN 10 AND 19 AND col BETWEEN 5 AND 30 GROUP BY ALL"))
def o29(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = zonal.crop_to_bbox(fx.pixels(spark, sf_dir), 5, 10, 30, 19, "col", "row")
    return rounded(window.groupBy("row", "col").agg(F.count("*").alias("n"), F.avg("value").alias("value")), "value")


@query("o30_regrid_average", sql("pixels", _CELLS + " SELECT (row // 4)::INT AS row, (col // 8)::INT AS col, round(avg(value), 6) AS value FROM cells GROUP BY 1, 2"))
def o30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(zonal.regrid_average(_cells(spark, sf_dir), 4, 8), "value")


@query("o30_regrid_overlap", sql("pixels", _CELLS + """, w AS (SELECT value, r, c, (least(-1.0::DOUBLE + (row + 1) * 0.75::DOUBLE, 0.3::DOUBLE + (r + 1) * 2.0::DOUBLE) - greatest(-1.0::DOUBLE + row * 0.75::DOUBLE, 0.3::DOUBLE + r * 2.0::DOUBLE)) / 2.0::DOUBLE AS wr,
    (least((col + 1) * 1.0::DOUBLE, 0.25::DOUBLE + (c + 1) * 1.6::DOUBLE) - greatest(col * 1.0::DOUBLE, 0.25::DOUBLE + c * 1.6::DOUBLE)) / 1.6::DOUBLE AS wc FROM cells, range(-2, 50) AS a(r), range(-2, 50) AS b(c) WHERE value IS NOT NULL)
  SELECT r::INT AS row, c::INT AS col, round(sum(wr * wc * value) / sum(wr * wc), 6) AS value, round(sum(wr * wc), 6) AS covered FROM w WHERE wr > 1e-9 AND wc > 1e-9 GROUP BY 1, 2"""))
def o30_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target cells that are no whole multiples of the source's, and begin elsewhere."""
    out = zonal.regrid_overlap(_cells(spark, sf_dir), zonal.Grid(-1.0, 0.75, 0.0, 1.0), zonal.Grid(0.3, 2.0, 0.25, 1.6))
    return rounded(out, "value", "covered")


@query("o31_regrid_bilinear", sql("pixels", _CELLS + """, t AS (SELECT (range // 64)::INT AS row, (range % 64)::INT AS col FROM range(4096)),
  p AS (SELECT row, col, row * 3.1::DOUBLE AS y, col * 2.7::DOUBLE AS x FROM t),
  n AS (SELECT row AS tr, col AS tc, (floor(y) + a)::INT AS row, (floor(x) + b)::INT AS col,
    (CASE WHEN a = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN b = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM p, (VALUES (0), (1)) AS i(a), (VALUES (0), (1)) AS j(b))
  SELECT tr AS row, tc AS col, round(sum(w * value) / sum(w), 6) AS value FROM n JOIN cells USING (row, col) WHERE w > 0 AND value IS NOT NULL GROUP BY 1, 2"""))
def o31(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = fx.grid(spark)
    return rounded(zonal.regrid_bilinear(_cells(spark, sf_dir), targets, 3.1, 2.7), "value")


@query("o32_fill_null_from_neighbors", sql("pixels", _CELLS + """ SELECT a.row, a.col, round(coalesce(a.value, avg(b.value)), 6) AS value FROM cells a LEFT JOIN cells b
  ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY a.row, a.col, a.value"""))
def o32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(zonal.fill_null_from_neighbors(_cells(spark, sf_dir)), "value")


@query("o33_masks_and_codes", sql("pixels mask", """SELECT crop.row, crop.col, (weight > 50)::INT AS weight, round(sum(CASE WHEN value <= 40 AND (value::INT % 3) = 0 THEN value END), 4) AS value
  FROM crop JOIN pixels USING (row, col) GROUP BY ALL"""))
def o33(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = zonal.null_codes(zonal.quality_filter(fx.pixels(spark, sf_dir).withColumn("qa", F.col("value").cast("int") % 3)), 40)
    joined = zonal.binarize_mask(fx.crop_mask(spark)).join(valid, ["row", "col"])
    return joined.groupBy("row", "col", "weight").agg(rnd(F.sum("value"), 4).alias("value"))


@query("o34_region_pixels", """WITH c AS (SELECT DISTINCT (l_partkey % 64)::INT AS row, (l_suppkey % 64)::INT AS col FROM lineitem), n AS (SELECT n_name AS adm, n_nationkey % 5 * 12 AS x, n_nationkey // 5 * 12 AS y FROM nation)
  SELECT adm, row, col FROM n, c WHERE col + 0.5 > x AND col + 0.5 < x + 13 AND row + 0.5 > y AND row + 0.5 < y + 11""")
def o34(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zonal.region_pixels(_centres(spark, sf_dir), _rectangles(spark, sf_dir))


def _centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.pixels(spark, sf_dir).select("row", "col").distinct().withColumns({"lon": F.col("col") + 0.5, "lat": F.col("row") + 0.5})


def _rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region for each nation, 13 by 11 cells, which overlaps its neighbours."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("adm"), (F.col("n_nationkey") % 5 * 12).cast("double").alias("x"), F.expr("cast(n_nationkey div 5 * 12 as double)").alias("y"))
    point = lambda x, y: F.struct((F.col("x") + x).alias("lon"), (F.col("y") + y).alias("lat"))
    return n.select("adm", F.array(F.array(point(0, 0), point(13, 0), point(13, 11), point(0, 11))).alias("rings"))


@query("o34_touched_pixels", """WITH c AS (SELECT DISTINCT (l_partkey % 64)::INT AS row, (l_suppkey % 64)::INT AS col FROM lineitem), n AS (SELECT n_name AS adm, n_nationkey % 5 * 12 AS x, n_nationkey // 5 * 12 AS y FROM nation)
  SELECT adm, row, col FROM n, c WHERE col + 1 >= x AND col <= x + 13 AND row + 1 >= y AND row <= y + 11""")
def o34_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell that shares a point with a region."""
    return zonal.region_pixels(_centres(spark, sf_dir), _rectangles(spark, sf_dir), touched=(1.0, 1.0))


@query("o35_merge_regions", sql("pixels mask", """+ m AS (SELECT CASE WHEN adm IN ('R0', 'R1', 'R2') THEN 'B' ELSE adm END AS adm, row, col FROM mask)
  SELECT adm, count(*) AS cells, round(avg(value), 6) AS mean FROM m JOIN (SELECT row, col, avg(value) AS value FROM pixels GROUP BY ALL) USING (row, col) GROUP BY adm"""))
def o35(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = zonal.merge_regions(fx.mask(spark).select("adm", "row", "col"), [(["R0", "R1"], "A"), (["A", "R2"], "B")])
    cells = fx.pixels(spark, sf_dir).groupBy("row", "col").agg(F.avg("value").alias("value"))
    return rounded(merged.join(cells, ["row", "col"]).groupBy("adm").agg(F.count("*").alias("cells"), F.avg("value").alias("mean")), "mean")


@query("o36_region_mask", sql("pixels mask", "SELECT adm, count(*) AS pixels, sum(weight)::BIGINT AS weight FROM mask JOIN pixels USING (row, col) GROUP BY adm"))
def o36(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = zonal.region_mask(fx.regions_of_cells(spark), fx.crop_mask(spark))
    return zonal.join_mask(fx.pixels(spark, sf_dir), masked).groupBy("adm").agg(F.count("*").alias("pixels"), F.sum("weight").alias("weight"))


_MONTHLY = "+ pm AS (SELECT strftime(date, '%Y-%m') AS date, row, col, value FROM pixels)"


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.pixels(spark, sf_dir).withColumn("date", F.date_format("date", "yyyy-MM"))


@query("o37_zonal_mean", sql("pixels mask", _MONTHLY + " SELECT adm, date, round(avg(value), 6) AS mean FROM pm JOIN mask USING (row, col) GROUP BY ALL"))
def o37(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(zonal.zonal_mean(_monthly(spark, sf_dir), fx.mask(spark)), "mean")


@query("o38_zonal_mean_quality", sql("pixels mask", _MONTHLY + """, n AS (SELECT adm, count(*) AS cells FROM mask GROUP BY adm),
  g AS (SELECT adm, date, count(*) FILTER (v > 0) AS good, sum(v) FILTER (v > 0) AS total FROM (SELECT adm, date, value - 20 AS v FROM pm JOIN mask USING (row, col)) GROUP BY ALL)
  SELECT adm, date, round(good / cells::DOUBLE, 6) AS quality, round(CASE WHEN good / cells::DOUBLE >= 0.1 THEN total / nullif(good, 0) / 100 END, 6) AS mean FROM g JOIN n USING (adm)"""))
def o38(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(zonal.zonal_mean_quality(_monthly(spark, sf_dir).withColumn("value", F.col("value") - 20), fx.mask(spark)), "quality", "mean")


@query("o39_zonal_weighted_mean", sql("pixels mask", _MONTHLY + """ SELECT adm, date, round(sum(value * weight) / sum(weight), 6) AS mean, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high,
  quantile_cont(value, 0.975) - quantile_cont(value, 0.025) > 40.01 AS wide FROM pm JOIN mask USING (row, col) GROUP BY ALL"""))
def o39(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(zonal.zonal_weighted_mean(_monthly(spark, sf_dir), fx.mask(spark), spread_limit=40.01), "mean", "low", "high")


@query("o40_zonal_histogram", sql("pixels mask", """+ b AS (SELECT adm, CASE WHEN value BETWEEN 10 AND 42 THEN least(floor((value - 10) / 4), 7)::INT END AS bin FROM pixels JOIN mask USING (row, col)),
  c AS (SELECT adm, bin, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY ALL), s AS (SELECT adm, sum(n) AS t FROM c GROUP BY adm)
  SELECT s.adm, k::INT AS bin, round(100 * coalesce(n, 0) / t, 6) AS percent FROM s CROSS JOIN range(8) AS r(k) LEFT JOIN c ON c.adm = s.adm AND c.bin = k"""))
def o40(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = zonal.zonal_histogram(fx.pixels(spark, sf_dir), fx.mask(spark), 10, 42, 8, by=[])
    return rounded(hist.select("adm", F.posexplode("histogram").alias("bin", "percent")), "percent")


@query("o41_zonal_static", sql("mask", """+ s AS (SELECT (p_partkey % 64)::INT AS row, (p_partkey // 64 % 64)::INT AS col, p_size, p_retailprice FROM part), m AS (SELECT * FROM mask SEMI JOIN s USING (row, col))
  SELECT adm, round(count(*) * (0.0025 / 360 * 400300) ** 2, 4) AS est_cropland_area, any_value(size) AS size, any_value(price) AS price FROM m JOIN (SELECT adm, round(avg(p_size), 6) AS size, round(avg(p_retailprice), 4) AS price FROM m JOIN s USING (row, col) GROUP BY adm) USING (adm) GROUP BY adm"""))
def o41(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = table(spark, sf_dir, "part").select((F.col("p_partkey") % 64).cast("int").alias("row"), F.expr("cast(p_partkey div 64 % 64 as int)").alias("col"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    maps = cell.unpivot(["row", "col"], ["size", "price"], "property", "value")
    known = fx.mask(spark).join(maps.select("row", "col").distinct(), ["row", "col"], "left_semi")
    out = zonal.zonal_static(maps, known, ["size", "price"])
    return rounded(rounded(out, "size"), "est_cropland_area", "price", digits=4)


@query("o42_monthly_quality", sql("pixels mask", """SELECT (row % 5)::INT AS country, month(date)::INT AS month, round(avg((value > 25)::INT), 6) AS quality FROM pixels GROUP BY ALL"""))
def o42(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.pixels(spark, sf_dir).select((F.col("row") % 5).alias("country"), "date", (F.col("value") > 25).cast("int").alias("quality"))
    return rounded(zonal.monthly_quality(rows), "quality")


@query("o43_correlation_matrix", """WITH c AS (SELECT l_quantity AS q, l_extendedprice AS p, l_discount AS d FROM lineitem)
  SELECT 'q' AS a, 'p' AS b, round(corr(q, p), 6) AS r FROM c UNION ALL SELECT 'q', 'd', round(corr(q, d), 6) FROM c UNION ALL SELECT 'p', 'd', round(corr(p, d), 6) FROM c""")
def o43(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("d"))
    return rounded(zonal.correlation_matrix(rows, ["q", "p", "d"]), "r")


@query("o44_day_of_year", "SELECT o_orderkey, dayofyear(o_orderdate)::INT AS doy, (make_date(year(o_orderdate)::INT, 1, 1) + (dayofyear(o_orderdate)::INT - 400))::DATE::VARCHAR AS day FROM orders")
def o44(spark: SparkSession, sf_dir: str) -> DataFrame:
    doy = profiles.day_of_year(F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", doy.alias("doy"), profiles.year_day_to_date(F.year("o_orderdate"), doy - 399).cast("string").alias("day"))


def _waves(doy: str, n: int = 5) -> str:
    return "[0.5, " + ", ".join(f"{f}(2 * pi() * {k} * {doy} / 365)" for k in range(1, n + 1) for f in ("cos", "sin")) + "]"


def _powers(doy: str, degree: int = 4) -> str:
    return "[" + ", ".join(f"pow(({doy} - 183) / 182.0::DOUBLE, {k})" for k in range(degree + 1)) + "]"


def _profile_sql(basis, size: int) -> str:
    return recursive(sql("daily", f"""+ obs AS (SELECT adm, value AS y, {basis("dayofyear(date)")} AS b FROM daily WHERE value IS NOT NULL), {least_squares("obs", size)},
  days AS (SELECT range::INT AS doy, {basis("range")} AS h FROM range(1, 366)) SELECT adm, doy, round(list_inner_product(beta, h), 6) AS value FROM beta, days"""))


@query("o45_fourier_profile", _profile_sql(_waves, 11))
def o45(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiles.fourier_profile(fx.daily_series(spark, sf_dir)), "value")


@query("o46_fill_gaps_fourier", recursive(sql("daily", f"""+ g AS (SELECT adm, date, CASE WHEN day(date) % 4 <> 0 THEN value END AS value, {_waves("dayofyear(date)")} AS b FROM daily),
  obs AS (SELECT adm, value AS y, b FROM g WHERE value IS NOT NULL), {least_squares("obs", 11)}
  SELECT adm, date::VARCHAR AS date, round(coalesce(value, list_inner_product(beta, b)), 6) AS value FROM g LEFT JOIN beta USING (adm)""")))
def o46(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = fx.daily_series(spark, sf_dir).withColumn("value", F.when(F.dayofmonth("date") % 4 != 0, F.col("value")))
    return dated(rounded(profiles.fill_gaps_fourier(gaps), "value"))


@query("o47_polynomial_profile", _profile_sql(_powers, 5))
def o47(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiles.polynomial_profile(fx.daily_series(spark, sf_dir), 4), "value")


_INTERPOLATED = """+ i AS (SELECT *, row_number() OVER (PARTITION BY adm ORDER BY date) AS i FROM gap),
k AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER p AS a, last_value(value IGNORE NULLS) OVER p AS va,
  first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER f AS b, first_value(value IGNORE NULLS) OVER f AS vb FROM i
  WINDOW p AS (PARTITION BY adm ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY adm ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT adm, date, coalesce(value, va + (vb - va) * (i - a) / nullif(b - a, 0), va, vb) AS value FROM k)"""


@query("o48_interpolate_linear", sql("ev gap", _INTERPOLATED + " SELECT adm, date::VARCHAR AS date, round(value, 6) AS value FROM filled"))
def o48(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated(rounded(profiles.interpolate_linear(fx.gappy_series(spark, sf_dir)), "value"))


@query("o49_rolling_mean_centered", sql("ev gap", _INTERPOLATED + " SELECT adm, date::VARCHAR AS date, round(avg(value) OVER (PARTITION BY adm ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS value FROM filled"))
def o49(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated(rounded(profiles.rolling_mean_centered(fx.gappy_series(spark, sf_dir), 5), "value"))


@query("o50_rolling_gaussian", sql("ev gap", """+ i AS (SELECT *, row_number() OVER (PARTITION BY adm ORDER BY date) AS i FROM gap),
  p AS (SELECT a.adm, a.date, b.value, exp(-0.5 * (((b.i - a.i)::DOUBLE + 0.5) / 2) ** 2) AS w FROM i a JOIN i b ON a.adm = b.adm AND b.i - a.i BETWEEN -3 AND 2)
  SELECT adm, date::VARCHAR AS date, round(sum(w * value) / sum(w) FILTER (value IS NOT NULL), 6) AS value FROM p GROUP BY 1, 2"""))
def o50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated(rounded(profiles.rolling_gaussian(fx.gappy_series(spark, sf_dir), 6), "value"))


@query("o50_rolling_gaussian_long", sql("daily", """+ i AS (SELECT *, row_number() OVER (PARTITION BY adm ORDER BY date) AS i FROM daily),
  p AS (SELECT a.adm, a.date, b.value, exp(-0.5 * (((b.i - a.i)::DOUBLE + 0.5) / 60) ** 2) AS w FROM i a JOIN i b ON a.adm = b.adm AND b.i BETWEEN a.i - 90 AND a.i + 89)
  SELECT adm, date::VARCHAR AS date, round(sum(w * value) / sum(w) FILTER (value IS NOT NULL), 6) AS value FROM p GROUP BY 1, 2"""))
def o50_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated(rounded(profiles.rolling_gaussian(fx.daily_series(spark, sf_dir), 180), "value"))


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each day of the year of each region, days 1 to 365."""
    days = fx.daily_series(spark, sf_dir).groupBy("adm", F.least(F.dayofyear("date"), F.lit(365)).alias("doy"))
    return days.agg(F.avg("value").alias("value"))


_PROFILE = "+ prof AS (SELECT adm, least(dayofyear(date), 365)::INT AS doy, avg(value) AS value FROM daily GROUP BY 1, 2)"


@query("o51_detect_season", sql("daily", _PROFILE + """, r AS (SELECT adm, doy, round(value, 9) AS value FROM prof),
  s AS (SELECT adm, min(value) AS low, max(value) AS high FROM r GROUP BY adm), bottom AS (SELECT r.adm, min(doy) AS lowest FROM r JOIN s ON r.adm = s.adm AND value = low GROUP BY r.adm),
  o AS (SELECT r.adm, doy, (doy - lowest + 365) % 365 AS off FROM r JOIN s USING (adm) JOIN bottom USING (adm) WHERE value > low + 0.5 * (high - low) AND (doy - lowest + 365) % 365 >= 1),
  d AS (SELECT adm, arg_min(doy, off) AS sos, arg_max(doy, off) + 1 AS eos FROM o GROUP BY adm)
  SELECT s.adm, sos::INT AS sos, eos::INT AS eos, (CASE WHEN eos < sos THEN eos - sos + 365 ELSE eos - sos END)::INT AS season_length FROM s LEFT JOIN d USING (adm)"""))
def o51(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasons and, by O52, their lengths."""
    return profiles.season_length(profiles.detect_season(rounded(_profile(spark, sf_dir), "value", digits=9)))


@query("o52_season_length", sql("cal", "SELECT adm, CASE WHEN eos < sos THEN eos - sos + 365 ELSE eos - sos END AS season_length FROM cal"))
def o52(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.season_length(fx.calendar(spark, sf_dir)).select("adm", "season_length")


@query("o53_calendar_exceeds", sql("cal", "SELECT adm, eos, (70 + 2 * n_nationkey)::INT AS harvest_end FROM cal WHERE eos > 70 + 2 * n_nationkey"))
def o53(spark: SparkSession, sf_dir: str) -> DataFrame:
    cal = fx.calendar(spark, sf_dir)
    return profiles.calendar_exceeds(cal, cal.select("adm", (70 + 2 * F.col("n_nationkey")).alias("harvest_end")))


@query("o54_calendar_from_dekads", """WITH d AS (SELECT n_name AS adm, n_nationkey * 1.7::DOUBLE + 0.03 AS sos, n_nationkey * 2.9::DOUBLE - 3 AS eos, n_nationkey AS k FROM nation),
  r AS (SELECT adm, round(sos * 10)::INT AS s, round(eos * 10)::INT AS e, ((k * 2 - 1) % 36 + 36) % 36 + 1 AS ws, ((k * 3 - 1 - 7) % 36 + 36) % 36 + 1 AS we, ((k - 7) % 36 + 36) % 36 AS wg FROM d)
  SELECT adm, CASE WHEN (s % 365 + 365) % 365 = 0 THEN 365 ELSE (s % 365 + 365) % 365 END AS sos, CASE WHEN (e % 365 + 365) % 365 = 0 THEN 365 ELSE (e % 365 + 365) % 365 END AS eos, e - s AS growth,
  ws AS sos_dekad, we AS eos_dekad, wg AS growth_dekads FROM r""")
def o54(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("adm"), (k * 1.7 + 0.03).alias("sos"), (k * 2.9 - 3).alias("eos"), (k * 2).alias("sos_dekad"), (k * 3 - 7).alias("eos_dekad"))
    days = profiles.calendar_from_dekads(n).withColumnRenamed("growth", "g")
    return profiles.wrap_dekads(days, "sos_dekad", "eos_dekad").withColumnsRenamed({"growth": "growth_dekads", "g": "growth"})


@query("o55_pick_by_season_count", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 THEN CASE WHEN l_quantity * 5 <= 200 THEN l_quantity * 5 END ELSE CASE WHEN l_quantity * 6 <= 200 THEN l_quantity * 6 END END AS value FROM lineitem")
def o55(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("seasons"), (F.col("l_quantity") * 6).alias("season_1"), (F.col("l_quantity") * 5).alias("season_2"))
    return profiles.pick_by_season_count(rows).select("l_orderkey", "l_linenumber", "value")


@query("o56_fill_from_donor", sql("cal", "SELECT adm AS adm1, CASE WHEN adm IN ('NATION_3', 'NATION_4') THEN (SELECT sos FROM cal WHERE adm = 'NATION_9') ELSE sos END AS sos FROM cal"))
def o56(spark: SparkSession, sf_dir: str) -> DataFrame:
    cal = fx.calendar(spark, sf_dir).select(F.col("adm").alias("adm1"), "sos")
    return profiles.fill_from_donor(cal, [("NATION_3", "NATION_9"), ("NATION_4", "NATION_3")], ["sos"])


@query("o56_fill_from_nearest", sql("cal", """+ c AS (SELECT adm, sos, eos, n_nationkey % 5 AS lon, n_nationkey * 1.3::DOUBLE AS lat, n_nationkey % 4 = 0 AS gone FROM cal)
  SELECT adm, sos, eos FROM c WHERE NOT gone UNION ALL SELECT a.adm, arg_min(b.sos, (a.lon - b.lon) ** 2 + (a.lat - b.lat) ** 2), arg_min(b.eos, (a.lon - b.lon) ** 2 + (a.lat - b.lat) ** 2)
  FROM c a JOIN c b ON a.gone AND NOT b.gone GROUP BY a.adm"""))
def o56_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    cal, n = fx.calendar(spark, sf_dir), F.col("n_nationkey")
    return profiles.fill_from_nearest(cal.where(n % 4 != 0).select("adm", "sos", "eos"), cal.select("adm", (n % 5).alias("lon"), (n * 1.3).alias("lat")), ["sos", "eos"])


@query("o57_rotate_profile", sql("daily cal", _PROFILE + """, t AS (SELECT adm, (doy - sos + 365) % 365 AS step, value FROM prof JOIN cal USING (adm))
  SELECT adm, step::INT AS step, round(d, 6) AS value FROM (SELECT *, value - lag(value) OVER (PARTITION BY adm ORDER BY step) AS d FROM t WHERE step < 250) WHERE d IS NOT NULL"""))
def o57(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiles.diff_profile(profiles.rotate_profile(_profile(spark, sf_dir), fx.calendar(spark, sf_dir))), "value")


@query("o58_index_gaussian", sql("daily", """+ d AS (SELECT adm, date, least(dayofyear(date), 365) AS doy, value FROM daily),
  z AS (SELECT *, (value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w > 1e-9 * max(abs(value)) OVER w THEN stddev_pop(value) OVER w END AS z FROM d WINDOW w AS (PARTITION BY adm, doy))
  SELECT adm, date::VARCHAR AS date, round(z, 5) AS value FROM z"""))
def o58(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = indices.standardized_index(fx.daily_series(spark, sf_dir), detrend=False)
    return dated(rounded(index, "value", digits=5))


def _ratio(i: int, x: str) -> str:
    """One of the rational approximations of the normal quantile at ``x``."""
    top, bottom = (f"list_reduce([{", ".join(f"{c!r}::DOUBLE" for c in QUANTILE[j])}], lambda s, c: s * ({x}) + c)" for j in (i, i + 1))
    return f"{top} / {bottom}"


_PSI = """(ln(a + 10) - 0.5 / (a + 10) - 1 / (12 * pow(a + 10, 2)) + 1 / (120 * pow(a + 10, 4)) - 1 / (252 * pow(a + 10, 6)) + 1 / (240 * pow(a + 10, 8))
    - list_sum(list_transform(range(0, 10), lambda j: 1 / (a + j))))"""
_PSI_SLOPE = """(1 / (a + 10) + 0.5 / pow(a + 10, 2) + 1 / (6 * pow(a + 10, 3)) - 1 / (30 * pow(a + 10, 5)) + 1 / (42 * pow(a + 10, 7))
    + list_sum(list_transform(range(0, 10), lambda j: 1 / pow(a + j, 2))))"""


@query("o58_index_gamma", sql("daily", f"""+ i AS (SELECT *, row_number() OVER (PARTITION BY adm ORDER BY date) AS i FROM daily),
  p AS (SELECT a.adm, a.date, b.value, exp(-0.5 * (((b.i - a.i)::DOUBLE + 0.5) / 10) ** 2) AS w FROM i a JOIN i b ON a.adm = b.adm AND b.i BETWEEN a.i - 15 AND a.i + 14),
  s AS (SELECT adm, date, least(dayofyear(date), 365) AS doy, sum(w * value) / sum(w) FILTER (value IS NOT NULL) AS v FROM p GROUP BY 1, 2),
  m AS (SELECT adm, date, v / avg(v) OVER w AS r, greatest(ln(avg(v) OVER w) - avg(ln(v)) OVER w, 1e-12) AS g FROM s WINDOW w AS (PARTITION BY adm, doy)),
  b AS (SELECT *, (3 - g + sqrt((g - 3) * (g - 3) + 24 * g)) / (12 * g) AS a0 FROM m),
  k AS (SELECT adm, date, r, CASE WHEN g < 0.5 / 1e5 THEN a0 ELSE list_reduce(range(1, 8)::DOUBLE[], lambda a, _: a - (ln(a) - {_PSI} - g) / (1 / a - {_PSI_SLOPE}), a0) END AS a FROM b),
  x AS (SELECT adm, date, a, r, a * r AS x, (ceil(greatest(a * r - a, 0) + 9 * sqrt(a * r) + 40))::BIGINT AS n,
    (a + 9.5) * ln(a + 10) - a - 10 + 0.5 * ln(2 * pi()) + 1 / (12 * (a + 10)) - 1 / (360 * pow(a + 10, 3)) + 1 / (1260 * pow(a + 10, 5)) - list_sum(list_transform(range(0, 10), lambda j: ln(a + j))) - a * ln(a) + a AS rest
    FROM k WHERE a < 1e5),
  t AS (SELECT adm, date, a, r, rest, list_reduce(list_transform(range(n, 0, -1), lambda j: x / (a + j)), lambda s, q: 1 + s * q, 1.0::DOUBLE) AS total FROM x),
  c AS (SELECT adm, date, least(exp(a * (ln(r) - r + 1) - rest) * total / a, 1) AS c FROM t),
  q AS (SELECT adm, date, c, c - 0.5 AS q, sqrt(-ln(least(c, 1 - c))) AS t FROM c),
  z AS (SELECT adm, date, CASE WHEN abs(q) <= 0.425 THEN q * {_ratio(0, "0.180625 - q * q")} WHEN t <= 5 THEN sign(q) * {_ratio(2, "t - 1.6")} ELSE sign(q) * {_ratio(4, "t - 5")} END AS z FROM q
    UNION ALL SELECT adm, date, 3 * sqrt(a) * (cbrt(r) - 1 + 1 / (9 * a)) FROM k WHERE a >= 1e5)
  SELECT adm, date::VARCHAR AS date, round(z, 5) AS value FROM z"""))
def o58_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed, not detrended, gamma."""
    return dated(rounded(indices.standardized_index(fx.daily_series(spark, sf_dir), 30, "gamma", False), "value", digits=5))


@query("o59_trend_report", sql("daily", f"""+ q AS (SELECT *, row_number() OVER (PARTITION BY adm ORDER BY date) - 1 AS i FROM daily),
  f AS (SELECT adm, regr_count(value, i) AS n, regr_slope(value, i) AS slope, regr_r2(value, i) AS r2 FROM q GROUP BY adm), t AS (SELECT *, {slope_p("r2", "n")} < 0.05 AS real FROM f)
  SELECT count(*) AS series, round(avg(coalesce(real, false)::INT), 6) AS significant_share, round(avg(CASE WHEN real THEN (slope > 0)::INT END), 6) AS rising_share, round(avg(slope), 6) AS mean_slope FROM t"""))
def o59(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(indices.trend_report(fx.daily_series(spark, sf_dir)), "significant_share", "rising_share", "mean_slope")


@query("o60_season_window_join", sql("daily cal win", "SELECT adm, harv_year, count(*) AS days, round(sum(value), 4) AS total, min(date)::VARCHAR AS first, max(date)::VARCHAR AS last FROM season GROUP BY ALL"))
def o60(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = season.season_window_join(fx.nation_years(spark, sf_dir), fx.calendar(spark, sf_dir), fx.daily_series(spark, sf_dir))
    return cut.groupBy("adm", "harv_year").agg(F.count("*").alias("days"), rnd(F.sum("value"), 4).alias("total"), F.min("date").cast("string").alias("first"), F.max("date").cast("string").alias("last"))


def _season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return season.season_window_join(fx.nation_years(spark, sf_dir), fx.calendar(spark, sf_dir), fx.daily_series(spark, sf_dir))


_SEGMENTS = """+ p AS (SELECT *, row_number() OVER (PARTITION BY adm, harv_year ORDER BY date) - 1 AS p, count(*) OVER (PARTITION BY adm, harv_year) AS n FROM season),
seg0 AS (SELECT adm, harv_year, date, value, p, n, (p // CEIL(n / 6.0)::BIGINT + 1)::INT AS step FROM p),
seg AS (SELECT * FROM seg0 UNION ALL SELECT * REPLACE (6 AS step) FROM seg0 WHERE p = n - 1 AND step < 6)"""


@query("o61_segment_aggregate", sql("daily cal win", _SEGMENTS + """, a AS (SELECT adm, harv_year, step, avg(value) AS mean, min(value) AS low, max(value) AS high, sum(value) AS total FROM seg GROUP BY ALL),
  k AS (SELECT DISTINCT adm, harv_year FROM season), s AS (SELECT adm, harv_year, step::INT AS step, f FROM k, range(1, 7) AS r(step), (VALUES ('mean'), ('min'), ('max'), ('sum')) AS fs(f))
  SELECT adm, harv_year, f AS func, step, round(CASE f WHEN 'mean' THEN mean WHEN 'min' THEN low WHEN 'max' THEN high ELSE total END, 5) AS value FROM s LEFT JOIN a USING (adm, harv_year, step)"""))
def o61(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(season.segment_aggregate(_season(spark, sf_dir), 6, ["mean", "min", "max", "sum"]), "value", digits=5)


@query("o62_max_consecutive_dry_days", sql("daily cal win", """+ w AS (SELECT adm, harv_year, date, (value >= 26)::INT AS wet FROM season), r AS (SELECT *, sum(wet) OVER (PARTITION BY adm, harv_year ORDER BY date) AS run FROM w),
  c AS (SELECT adm, harv_year, run, sum(1 - wet) AS days FROM r GROUP BY ALL) SELECT adm, harv_year, max(days)::INT AS max_cdd FROM c GROUP BY ALL"""))
def o62(spark: SparkSession, sf_dir: str) -> DataFrame:
    return season.max_consecutive_dry_days(_season(spark, sf_dir), ["adm", "harv_year"], 26.0)


@query("o63_rescale_series", sql("daily cal win", """+ p AS (SELECT *, row_number() OVER (PARTITION BY adm, harv_year ORDER BY date) - 1 AS p, count(*) OVER (PARTITION BY adm, harv_year) AS n FROM season),
  k AS (SELECT DISTINCT adm, harv_year, n FROM p), q AS (SELECT adm, harv_year, n, i, i * (n - 1) / 31.0::DOUBLE AS place FROM k, range(32) AS r(i))
  SELECT q.adm, q.harv_year, i::INT AS step, round(CASE WHEN q.n = 32 THEN a.value ELSE a.value + (b.value - a.value) * (place - floor(place)) END, 5) AS value
  FROM q JOIN p a ON a.adm = q.adm AND a.harv_year = q.harv_year AND a.p = CASE WHEN q.n = 32 THEN i ELSE floor(place)::BIGINT END
  JOIN p b ON b.adm = q.adm AND b.harv_year = q.harv_year AND b.p = least(floor(place)::BIGINT + 1, q.n - 1)"""))
def o63(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = season.rescale_series(_season(spark, sf_dir), 32)
    return rounded(scaled.select("adm", "harv_year", F.posexplode("values").alias("step", "value")), "value", digits=5)


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two series in one table: the daily values, and how far they lie from 25."""
    daily = fx.daily_series(spark, sf_dir)
    return daily.withColumn("feature", F.lit("ndvi")).unionByName(daily.select(F.lit("preci").alias("feature"), "adm", "date", F.abs(F.col("value") - 25).alias("value")))


@query("o64_designed_features", sql("daily cal win", """+ p AS (SELECT adm, harv_year, date, value AS a, abs(value - 25) AS b, row_number() OVER (PARTITION BY adm, harv_year ORDER BY date) - 1 AS p, count(*) OVER (PARTITION BY adm, harv_year) AS n FROM season),
  s0 AS (SELECT *, p // CEIL(n / 2.0)::BIGINT + 1 AS step FROM p), s AS (SELECT * FROM s0 UNION ALL SELECT * REPLACE (2 AS step) FROM s0 WHERE p = n - 1 AND step < 2)
  SELECT adm, harv_year, round(avg(a) FILTER (step = 1), 5) AS ndvi_mean_1, round(avg(a) FILTER (step = 2), 5) AS ndvi_mean_2, round(sum(b) FILTER (step = 1), 5) AS preci_sum_1, round(sum(b) FILTER (step = 2), 5) AS preci_sum_2,
  round(max(b) FILTER (step = 1), 5) AS preci_max_1, round(max(b) FILTER (step = 2), 5) AS preci_max_2 FROM s GROUP BY ALL"""))
def o64(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = season.designed_features(fx.nation_years(spark, sf_dir), fx.calendar(spark, sf_dir), _features(spark, sf_dir), {"ndvi": ["mean"], "preci": ["sum", "max"]}, 2)
    return rounded(wide, *[c for c in wide.columns if c not in ("adm", "harv_year")], digits=5)


@query("o65_timeseries_tensor", sql("daily cal win", """+ p AS (SELECT *, row_number() OVER (PARTITION BY adm, harv_year ORDER BY date) - 1 AS p, count(*) OVER (PARTITION BY adm, harv_year) AS n FROM season),
  k AS (SELECT DISTINCT adm, harv_year, n FROM p), q AS (SELECT adm, harv_year, n, i, i * (n - 1) / 31.0::DOUBLE AS place FROM k, range(32) AS r(i)),
  v AS (SELECT q.adm, q.harv_year, i::INT AS step, q.n = 32 AS same, place - floor(place) AS part, a.value AS x, b.value AS y, abs(a.value - 25) AS u, abs(b.value - 25) AS w FROM q
    JOIN p a ON a.adm = q.adm AND a.harv_year = q.harv_year AND a.p = CASE WHEN q.n = 32 THEN i ELSE floor(place)::BIGINT END
    JOIN p b ON b.adm = q.adm AND b.harv_year = q.harv_year AND b.p = least(floor(place)::BIGINT + 1, q.n - 1)),
  t AS (SELECT adm, harv_year, step, CASE WHEN same THEN x ELSE x + (y - x) * part END AS x, CASE WHEN same THEN u ELSE u + (w - u) * part END AS u FROM v)
  SELECT adm, harv_year, step, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 5) AS ndvi, round(u / stddev_pop(u) OVER (), 5) AS preci FROM t"""))
def o65(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tensor's rows one by one."""
    tensor = season.timeseries_tensor(fx.nation_years(spark, sf_dir), fx.calendar(spark, sf_dir), _features(spark, sf_dir), ["ndvi", "preci"])
    steps = tensor.select("adm", "harv_year", F.posexplode("tensor").alias("step", "row"))
    return rounded(steps.select("adm", "harv_year", "step", F.col("row")[0].alias("ndvi"), F.col("row")[1].alias("preci")), "ndvi", "preci", digits=5)


REGISTRY.sql.update({name: steady(text) for name, text in REGISTRY.sql.items()})
