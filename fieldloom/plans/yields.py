"""Registered queries on reports, cleaning, merging, trends and the benchmark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.keys import assign_parent, attach_geometry, rename_values, unmatched_regions, with_adm
from fieldloom.operators import benchmark, cleaning, trends
from fieldloom.operators.metrics import region_performance
from fieldloom.plans import fixtures as fx
from fieldloom.plans.fixtures import REGION, rnd, slope_p, sql, steady
from fieldloom.plans.registry import Registry, table
from fieldloom.sources import reports

REGISTRY = Registry()
query = REGISTRY.query
GROUP = [*REGION, "season"]
KEYS = [*REGION, "harv_year"]


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: rnd(c, digits) for c in cols})


def _long_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact as indicator rows; rows of some keys come twice, or with another value."""
    fact = fx.yield_fact(spark, sf_dir)
    names = {v: k for k, v in cleaning.INDICATORS.items()}
    rows = fact.unpivot([*GROUP, "harv_year"], ["area", "production", "yield"], "indicator", "value").replace(names, subset=["indicator"])
    mark = (F.col("harv_year") + F.length("adm2") + F.length("indicator")) % 7
    again = rows.where(mark == 0)
    return rows.unionByName(again).unionByName(rows.where(mark == 1).withColumn("value", F.col("value") + 1))


_LONG = """+ names(m, indicator) AS (VALUES ('area', 'Area Planted'), ('production', 'Quantity Produced'), ('yield', 'Yield')),
u AS (SELECT country, adm1, adm2, season, harv_year, indicator, CASE m WHEN 'area' THEN area WHEN 'production' THEN production ELSE yield END AS value FROM yf CROSS JOIN names),
rep AS (SELECT * FROM u UNION ALL SELECT * FROM u WHERE (harv_year + length(adm2) + length(indicator)) % 7 = 0
  UNION ALL SELECT country, adm1, adm2, season, harv_year, indicator, value + 1 FROM u WHERE (harv_year + length(adm2) + length(indicator)) % 7 = 1),
clean AS (SELECT country, adm1, adm2, season, harv_year, indicator, any_value(value) AS value FROM (SELECT DISTINCT * FROM rep)
  GROUP BY 1, 2, 3, 4, 5, 6 HAVING count(*) = 1)"""


@query("o02_map_reports", """SELECT n_name AS country, s_name AS adm1, 'None' AS adm2, 'Annual' AS season, year(l_shipdate)::INT AS harv_year,
  'Yield' AS indicator, round(sum(l_quantity), 4) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  WHERE n_name = 'NATION_3' AND l_returnflag = 'A' AND l_linestatus IN ('O') GROUP BY ALL""")
def o02(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    raw = lines.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("country"), F.col("s_name").alias("admin_1"), F.lit("none").alias("admin_2"), F.lit("Annual").alias("season_name"), F.col("l_shipdate").cast("string").alias("season_date"),
        F.col("l_returnflag").alias("crop"), F.col("l_linestatus").alias("crop_production_system"), F.lit("Yield").alias("indicator"), F.col("l_quantity").alias("value"),
    )
    mapped = reports.map_reports(raw, "NATION_3", {"admin_1": "adm1", "admin_2": "adm2", "season_name": "season"}, "A", ["O"])
    return mapped.groupBy("country", "adm1", "adm2", "season", "harv_year", "indicator").agg(rnd(F.sum("value"), 4).alias("value"))


@query("o03_unpivot_year_blocks", sql("yf", """+ r AS (SELECT n_name AS adm1, n_nationkey AS k FROM nation),
  t AS (SELECT adm1, harv_year, sum(area) AS area, sum(production) AS production FROM yf GROUP BY ALL)
  SELECT 'X' AS country, adm1, harv_year, round(area * 1000, 3) AS area, round(production * 1000, 3) AS production, round(production / area, 6) AS yield
  FROM t WHERE harv_year BETWEEN 1996 AND 2000"""))
def o03(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = fx.yield_fact(spark, sf_dir).groupBy("adm1", "harv_year").agg(F.sum("area").alias("area"), F.sum("production").alias("production"))
    fact = fact.withColumn("yield", F.col("production") / F.col("area")).unpivot(["adm1", "harv_year"], ["area", "production", "yield"], "m", "v")
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("adm1"), "n_nationkey")
    place = F.when(F.col("m") == "area", 0).when(F.col("m") == "production", 1).otherwise(2)
    wide = fact.join(nations, "adm1").groupBy((3 * F.col("n_nationkey") + place).alias("row")).pivot("harv_year", list(range(1996, 2001))).agg(F.first("v"))
    regions = {r.n_nationkey: r.adm1 for r in nations.collect()}  # 25 nations
    return rounded(rounded(reports.unpivot_year_blocks(wide, regions, {"country": "X"}), "area", "production", digits=3), "yield")


@query("o04_blank_to_null", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1) THEN NULL ELSE o_totalprice END AS value FROM orders""")
def o04(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 5 == 0, F.lit("  ")).when(F.col("o_orderkey") % 5 == 1, F.lit("-")).otherwise(F.concat(F.lit(" "), F.col("o_totalprice").cast("string")))
    return reports.blank_to_null(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("value")), ["value"])


#: All days of the events.
_DAYS = [f"2024-01-{d:02d}" for d in range(1, 32)]


@query("o05_wide_to_long", sql("ev", "SELECT adm, date::VARCHAR AS date, value FROM ev"))
def o05(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = reports.long_to_wide(fx.event_series(spark, sf_dir), ["adm"], _DAYS)
    return reports.wide_to_long(wide, ["adm"]).where(F.col("value").isNotNull()).withColumn("date", F.col("date").cast("string"))


@query("o06_long_to_wide", sql("ev", "SELECT adm, " + ", ".join(f"""max(value) FILTER (date = '{d}') AS "{d.replace('-', '_')}\"""" for d in _DAYS) + " FROM ev GROUP BY adm"))
def o06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.long_to_wide(fx.event_series(spark, sf_dir), ["adm"], _DAYS)


@query("o07_file_date", "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS a, o_orderdate::DATE::VARCHAR AS b, o_orderdate::DATE::VARCHAR AS c FROM orders")
def o07(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda pad, pattern: F.concat(F.lit("/images/" + "x" * pad), F.date_format("o_orderdate", pattern), F.lit(".tif"))
    files = {"a": ("ndvi", name(18, "yyyy_MM_dd")), "b": ("precipitation", name(22, "yyyyMMdd")), "c": ("temperature", name(27, "yyyyMMdd"))}
    return table(spark, sf_dir, "orders").select("o_orderkey", *[reports.file_date(path, product).cast("string").alias(k) for k, (product, path) in files.items()])


@query("o08_dekad_scaffold", """SELECT n_name AS adm, y::INT AS year, m::INT AS month, d::INT AS dekad, NULL::DOUBLE AS value
  FROM nation, range(2001, 2004) AS a(y), range(1, 13) AS b(m), (VALUES (10), (20), (30)) AS c(d)""")
def o08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dekad_scaffold(table(spark, sf_dir, "nation").select(F.col("n_name").alias("adm")), 2001, 2003)


@query("o09_load_yield", sql("yf", "SELECT *  REPLACE (round(production, 6) AS production, round(yield, 6) AS yield), '[' || country || ' ' || adm1 || ' ' || adm2 || ']' AS adm, country || '_' || adm1 AS adm1_ FROM yf WHERE harv_year BETWEEN 1997 AND 2000"))
def o09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.load_yield(fx.yield_fact(spark, sf_dir), 1997, 2000), "production", "yield")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder of the warehouse, which executors and driver share."""
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/fieldloom-{name}-{uuid.uuid4().hex}"


@query("o01_read_reports", sql("yf", "SELECT country, adm2, harv_year, round(production, 6) AS production FROM yf"))
def o01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact written as delimited text without a header, and read back by position."""
    path = _folder(spark, "o01")
    fx.yield_fact(spark, sf_dir).write.option("sep", ";").option("nullValue", "-").csv(path)
    schema = "a string, b string, c string, d string, e int, f double, g double, h double"
    rows = reports.read_reports(spark, path, schema, ";", "-", False, {0: "country", 2: "adm2", 4: "harv_year", 6: "production"})
    return rounded(rows, "production")


@query("o10_write_table", sql("yf", "SELECT country, harv_year, count(*) AS n, round(sum(area), 2) AS area FROM yf GROUP BY ALL"))
def o10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written into the shared warehouse, partitioned by country, and read back."""
    path = _folder(spark, "o10")
    reports.write_table(fx.yield_fact(spark, sf_dir), path, ["country"])
    return spark.read.parquet(path).groupBy("country", "harv_year").agg(F.count("*").alias("n"), rnd(F.sum("area"), 2).alias("area"))


@query("o11_with_adm", sql("yf", "SELECT DISTINCT country, adm1, CASE WHEN adm2 = 'BUILDING' THEN 'None' ELSE adm2 END AS adm2, CASE WHEN adm2 = 'BUILDING' THEN '[' || country || ' ' || adm1 || ']' ELSE '[' || country || ' ' || adm1 || ' ' || adm2 || ']' END AS adm FROM yf"))
def o11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.yield_fact(spark, sf_dir).select(*REGION).distinct()
    return with_adm(rows.withColumn("adm2", F.when(F.col("adm2") == "BUILDING", "None").otherwise(F.col("adm2"))))


@query("o12_rename_values", sql("yf", """SELECT DISTINCT country, CASE WHEN adm2 IN ('BUILDING', 'AUTOMOBILE') THEN 'NATION_0' ELSE adm1 END AS adm1,
  CASE adm2 WHEN 'MACHINERY' THEN 'AUTOMOBILE_X' WHEN 'FURNITURE' THEN 'BUILDING_X' ELSE adm2 END AS adm2 FROM yf"""))
def o12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.yield_fact(spark, sf_dir).select(*REGION)
    rows = rename_values(rename_values(rows, "adm2", {"MACHINERY": "M", "FURNITURE": "BUILDING_X"}), "adm2", {"M": "AUTOMOBILE_X"})
    return assign_parent(rows, {"BUILDING": "NATION_0", "AUTOMOBILE": "NATION_0"}).distinct()


@query("o13_drop_conflicting_duplicates", sql("yf", _LONG + " SELECT * REPLACE (round(value, 6) AS value) FROM clean"))
def o13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cleaning.drop_conflicting_duplicates(_long_reports(spark, sf_dir), [*GROUP, "harv_year", "indicator"]), "value")


@query("o14_pivot_indicators", sql("yf", _LONG + """, p AS (SELECT country, adm1, adm2, season, harv_year, max(value) FILTER (indicator = 'Area Planted') AS area,
  max(value) FILTER (indicator = 'Quantity Produced') AS production, max(value) FILTER (indicator = 'Yield') AS yield FROM clean WHERE adm1 <> 'NATION_4' GROUP BY ALL)
  SELECT * REPLACE (round(area, 6) AS area, round(production, 6) AS production, round(yield, 6) AS yield) FROM p WHERE area IS NOT NULL AND production IS NOT NULL AND yield IS NOT NULL"""))
def o14(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = cleaning.drop_conflicting_duplicates(_long_reports(spark, sf_dir), [*GROUP, "harv_year", "indicator"])
    return rounded(cleaning.pivot_indicators(clean, [*GROUP, "harv_year"], exclude_regions=["NATION_4"]), "area", "production", "yield")


def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact with a reported yield that is off for some rows."""
    off = F.when((F.col("harv_year") + F.length("adm2")) % 7 == 0, 0.1).when((F.col("harv_year") + F.length("adm2")) % 7 == 1, 0.01).otherwise(0.0)
    return fx.yield_fact(spark, sf_dir).withColumn("yield", F.col("yield") + off)


_REPORTED = """+ rp AS (SELECT * REPLACE (yield + CASE WHEN (harv_year + length(adm2)) % 7 = 0 THEN 0.1 WHEN (harv_year + length(adm2)) % 7 = 1 THEN 0.01 ELSE 0.0 END AS yield) FROM yf)"""


@query("o15_consistency_filter", sql("yf", _REPORTED + " SELECT country, adm1, adm2, harv_year, round(production / area, 6) AS yield, abs(production / area - yield) < 0.05 AS consistent FROM rp"))
def o15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cleaning.consistency_check(_reported(spark, sf_dir)).select(*KEYS, "yield", "consistent"), "yield")


@query("o16_min_mean_area_filter", sql("yf", "SELECT country, adm1, adm2, harv_year, area FROM (SELECT *, avg(area) OVER (PARTITION BY country, adm1, adm2, season) AS m FROM yf) WHERE m >= 1501"))
def o16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.min_mean_area_filter(fx.yield_fact(spark, sf_dir), GROUP, 1501).select(*KEYS, "area")


@query("o17_row_bounds_filter", sql("yf", "SELECT country, adm1, adm2, harv_year, area FROM yf WHERE area >= 1000 AND yield < 1.9"))
def o17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.row_bounds_filter(fx.yield_fact(spark, sf_dir), 1000, 1.9).select(*KEYS, "area")


@query("o18_suspicious_repeats", sql("yf", """SELECT country, adm1, adm2, harv_year, coalesce(abs(yield - lag(yield) OVER w) < 0.02, false) OR coalesce(abs(yield - lead(yield) OVER w) < 0.02, false) AS suspicious
  FROM yf WINDOW w AS (PARTITION BY country, adm1, adm2, season ORDER BY harv_year)"""))
def o18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.suspicious_repeats(fx.yield_fact(spark, sf_dir), GROUP, threshold=0.02).select(*KEYS, "suspicious")


_FIT = """c AS (SELECT *, harv_year - avg(harv_year) OVER w AS x, {y} - avg({y}) OVER w AS d, count(*) OVER w AS n FROM {t} WINDOW w AS (PARTITION BY {g})),
m AS (SELECT *, avg(x*x) OVER w AS s2, avg(x*x*x) OVER w AS s3, avg(x*x*x*x) OVER w AS s4, avg(x*d) OVER w AS p1, avg(x*x*d) OVER w AS p2 FROM c WINDOW w AS (PARTITION BY {g})),
r AS (SELECT *, d - ((p1 * (s4 - s2*s2) - p2 * s3) * x + (p2 * s2 - p1 * s3) * (x*x - s2)) / (s2 * (s4 - s2*s2) - s3*s3) AS res FROM m),
z AS (SELECT *, CASE WHEN n >= 5 THEN res / nullif(stddev_pop(res) OVER (PARTITION BY {g}), 0) END AS z FROM r)"""


@query("o19_polyfit_outliers", sql("mf", "+" + _FIT.format(t="mf", g="adm", y="yield") + " SELECT adm, harv_year, round(z, 6) AS z, coalesce(z > 3, false) AS outlier FROM z"))
def o19(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaning.polyfit_outliers(cleaning.polyfit_z(fx.monthly_fact(spark, sf_dir), ["adm"], "yield"), ["adm"], "yield", side="high")
    return rounded(rows.select("adm", "harv_year", "z", "outlier"), "z")


@query("o20_min_datapoints_filter", sql("yf", "SELECT country, adm1, adm2, harv_year FROM (SELECT *, count(yield) OVER (PARTITION BY country, adm1, adm2) AS n FROM yf WHERE yield < 1.95) WHERE n >= 5"))
def o20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.min_datapoints_filter(fx.yield_fact(spark, sf_dir).where("yield < 1.95"), REGION, 5).select(*KEYS)


@query("o21_clean_yield", sql("mf", "+" + _FIT.format(t="(SELECT * FROM (SELECT *, avg(area) OVER (PARTITION BY adm) AS ma FROM mf) WHERE ma >= 500 AND area >= 500 AND yield < 10)", g="adm", y="area") + """,
  a AS (SELECT adm, harv_year, area, yield FROM z WHERE NOT coalesce(abs(z) > 2.5, false)),
  c2 AS (SELECT *, harv_year - avg(harv_year) OVER w AS x, yield - avg(yield) OVER w AS d, count(*) OVER w AS n FROM a WINDOW w AS (PARTITION BY adm)),
  m2 AS (SELECT *, avg(x*x) OVER w AS s2, avg(x*x*x) OVER w AS s3, avg(x*x*x*x) OVER w AS s4, avg(x*d) OVER w AS p1, avg(x*x*d) OVER w AS p2 FROM c2 WINDOW w AS (PARTITION BY adm)),
  r2 AS (SELECT *, d - ((p1 * (s4 - s2*s2) - p2 * s3) * x + (p2 * s2 - p1 * s3) * (x*x - s2)) / (s2 * (s4 - s2*s2) - s3*s3) AS res FROM m2),
  z2 AS (SELECT *, CASE WHEN n >= 5 THEN res / nullif(stddev_pop(res) OVER (PARTITION BY adm), 0) END AS z FROM r2)
  SELECT adm, harv_year, area, round(yield, 6) AS yield FROM (SELECT *, count(*) OVER (PARTITION BY adm) AS k FROM z2 WHERE NOT coalesce(z > 2.5, false)) WHERE k >= 4"""))
def o21(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.monthly_fact(spark, sf_dir).withColumn("production", F.col("area") * F.col("yield"))
    return rounded(cleaning.clean_yield(rows, ["adm"], 500, 10, 2.5).select("adm", "harv_year", "area", "yield"), "yield")


@query("o22_event_exclusion", sql("yf", "SELECT country, adm1, adm2, harv_year FROM yf WHERE NOT (country = 'ASIA' AND harv_year = 1998 OR country = 'AFRICA' AND harv_year = 1996)"))
def o22(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = table(spark, sf_dir, "region").select(F.col("r_name").alias("country")).where(F.col("country").isin("ASIA", "AFRICA")).withColumn("harv_year", F.when(F.col("country") == "ASIA", 1998).otherwise(1996))
    return cleaning.event_exclusion(fx.yield_fact(spark, sf_dir), rules).select(*KEYS)


def _second(fact: DataFrame) -> DataFrame:
    """A second source: some keys left out, the others off by up to two per cent."""
    off = (F.col("harv_year") * 3 + F.length("adm2")) % 5 - 2
    return fact.where((F.col("harv_year") + F.length("adm1")) % 6 != 0).withColumn("yield", F.col("yield") * (1 + off / F.lit(100.0)))


_TWO = """+ a AS (SELECT * FROM yf WHERE (harv_year + length(adm2)) % 5 <> 0),
b AS (SELECT * REPLACE (yield * (1 + ((harv_year * 3 + length(adm2)) % 5 - 2) / 100.0::DOUBLE) AS yield) FROM yf WHERE (harv_year + length(adm1)) % 6 <> 0),
j AS (SELECT coalesce(a.country, b.country) AS country, coalesce(a.adm1, b.adm1) AS adm1, coalesce(a.adm2, b.adm2) AS adm2, coalesce(a.harv_year, b.harv_year) AS harv_year, a.yield AS ya, b.yield AS yb
  FROM a FULL JOIN b ON a.country = b.country AND a.adm1 = b.adm1 AND a.adm2 = b.adm2 AND a.harv_year = b.harv_year)"""


@query("o23_tolerant_merge", sql("yf", _TWO + """ SELECT country, adm1, adm2, harv_year, round(coalesce(ya, yb), 6) AS yield, CASE WHEN yb IS NULL THEN 'first' WHEN ya IS NULL THEN 'second' ELSE 'both' END AS origin
  FROM j WHERE ya IS NULL OR yb IS NULL OR abs(ya - yb) <= 0.0151 * greatest(abs(ya), abs(yb))"""))
def o23(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = fx.yield_fact(spark, sf_dir)
    return rounded(cleaning.tolerant_merge(fact.where((F.col("harv_year") + F.length("adm2")) % 5 != 0), _second(fact), KEYS, tolerance=0.0151), "yield")


@query("o23_merge_report", sql("yf", _TWO + """ SELECT CASE WHEN yb IS NULL THEN 'first' WHEN ya IS NULL THEN 'second' WHEN abs(ya - yb) <= 0.0151 * greatest(abs(ya), abs(yb)) THEN 'both' ELSE 'inconsistent' END AS origin, count(*) AS n FROM j GROUP BY 1"""))
def o23_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = fx.yield_fact(spark, sf_dir)
    return cleaning.merge_report(fact.where((F.col("harv_year") + F.length("adm2")) % 5 != 0), _second(fact), KEYS, tolerance=0.0151)


@query("o24_coalesce_sources", sql("yf", _TWO + " SELECT country, adm1, adm2, harv_year, round(CASE WHEN ya IS NULL THEN yb WHEN yb IS NULL THEN ya ELSE yb END, 6) AS yield FROM j WHERE ya IS NULL OR yb IS NULL OR abs(ya - yb) < 0.0173"))
def o24(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = fx.yield_fact(spark, sf_dir)
    return rounded(cleaning.coalesce_sources(fact.where((F.col("harv_year") + F.length("adm2")) % 5 != 0), _second(fact), KEYS, tolerance=0.0173), "yield")


@query("o25_union_sources", sql("yf", "SELECT country, adm1, adm2, harv_year FROM (SELECT * FROM yf WHERE harv_year % 2 = 0 UNION ALL SELECT * FROM yf WHERE harv_year % 2 = 1) WHERE harv_year > 1996 AND country NOT IN ('EUROPE')"))
def o25(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = fx.yield_fact(spark, sf_dir)
    return cleaning.union_sources([fact.where("harv_year % 2 = 0"), fact.where("harv_year % 2 = 1")], ["EUROPE"], 1996).select(*KEYS)


@query("o26_linear_trend", sql("yf", "SELECT adm1, adm2, regr_count(yield, harv_year)::BIGINT AS n, round(regr_slope(yield, harv_year), 6) AS slope, round(regr_r2(yield, harv_year), 6) AS r2 FROM yf GROUP BY ALL"))
def o26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trends.linear_trend(fx.yield_fact(spark, sf_dir), ["adm1", "adm2"]).select("adm1", "adm2", "n", "slope", "r2"), "slope", "r2")


@query("o26_slope_significance", sql("mf", f"""+ f AS (SELECT adm, regr_count(yield, harv_year)::BIGINT AS n, regr_r2(yield, harv_year) AS r2 FROM mf GROUP BY adm)
  SELECT adm, n, round({slope_p("r2", "n")}, 6) AS p_value FROM f"""))
def o26_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trends.linear_trend(fx.monthly_fact(spark, sf_dir), ["adm"]).select("adm", "n", "p_value"), "p_value")


@query("o27_standardized_yield", sql("yf", """+ f AS (SELECT *, yield - (avg(yield) OVER w + regr_slope(yield, harv_year) OVER w * (harv_year - avg(harv_year) OVER w)) AS r FROM yf WINDOW w AS (PARTITION BY country, adm1, adm2))
  SELECT country, adm1, adm2, harv_year, round(r / CASE WHEN count(r) OVER w > 2 AND stddev_pop(r) OVER w > 1e-9 * max(abs(yield)) OVER w THEN stddev_pop(r) OVER w END, 5) AS standardized_yield FROM f WINDOW w AS (PARTITION BY country, adm1, adm2)"""))
def o27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(trends.standardized_yield(fx.yield_fact(spark, sf_dir), REGION).select(*KEYS, "standardized_yield"), "standardized_yield", digits=5)


@query("o28_region_counts", sql("yf", "SELECT adm, count(*) AS n, round(avg(yield), 6) AS mean_yield FROM yk GROUP BY adm"))
def o28(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = fx.keyed_fact(spark, sf_dir)
    return rounded(trends.region_counts(fact).join(trends.region_mean(fact, "yield"), "adm"), "mean_yield")


_BENCH = """s AS (SELECT *, harv_year - avg(harv_year) OVER (PARTITION BY adm) AS c FROM yk),
t AS (SELECT *, count(*) OVER w - 1 AS n, sum(c) OVER w - c AS x, sum(c*c) OVER w - c*c AS xx, sum(yield) OVER w - yield AS y, sum(c*yield) OVER w - c*yield AS xy FROM s WINDOW w AS (PARTITION BY adm)),
b AS (SELECT *, CASE WHEN n >= 1 THEN y/n + coalesce(CASE WHEN xx - x*x/n > 1e-9 THEN (xy - x*y/n) / (xx - x*x/n) END, 0) * (c - x/n) END AS y_bench FROM t)"""


@query("o73_benchmark_linear", sql("yf", "+" + _BENCH + " SELECT adm, harv_year, round(y_bench, 6) AS y_bench FROM b"))
def o73(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(benchmark.benchmark_predictions(fx.keyed_fact(spark, sf_dir)).select("adm", "harv_year", "y_bench"), "y_bench")


@query("o73_benchmark_knn", sql("yf", """+ p AS (SELECT a.adm, a.harv_year, b.yield, row_number() OVER (PARTITION BY a.adm, a.harv_year ORDER BY abs(a.harv_year - b.harv_year), b.harv_year) AS r,
  count(*) OVER (PARTITION BY a.adm, a.harv_year) AS n FROM yk a JOIN yk b ON a.adm = b.adm AND a.harv_year <> b.harv_year)
  SELECT yk.adm, yk.harv_year, round(avg(p.yield), 6) AS y_bench FROM yk LEFT JOIN p ON yk.adm = p.adm AND yk.harv_year = p.harv_year AND r <= CASE WHEN n < 5 THEN 2 ELSE 4 END GROUP BY 1, 2"""))
def o73_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(benchmark.benchmark_predictions(fx.keyed_fact(spark, sf_dir), "knn").select("adm", "harv_year", "y_bench"), "y_bench")


@query("o73_benchmark_quadratic", sql("yf", """+ o AS (SELECT a.adm, a.harv_year, (b.harv_year - a.harv_year)::DOUBLE AS c, b.yield AS y FROM yk a LEFT JOIN yk b ON a.adm = b.adm AND a.harv_year <> b.harv_year),
  m AS (SELECT adm, harv_year, count(y) AS n, avg(c) AS mx, avg(c*c) AS mq, avg(y) AS my FROM o GROUP BY ALL),
  s AS (SELECT adm, harv_year, any_value(n) AS n, any_value(mx) AS mx, any_value(mq) AS mq, any_value(my) AS my, sum((c-mx)*(c-mx)) AS xx, sum((c-mx)*(c*c-mq)) AS xq, sum((c*c-mq)*(c*c-mq)) AS qq, sum((c-mx)*(y-my)) AS xy, sum((c*c-mq)*(y-my)) AS qy
    FROM o JOIN m USING (adm, harv_year) GROUP BY ALL)
  SELECT adm, harv_year, round(CASE WHEN n >= 1 THEN CASE WHEN xx*qq - xq*xq > 1e-9*xx*qq THEN my - (xy*qq - qy*xq) / (xx*qq - xq*xq) * mx - (qy*xx - xy*xq) / (xx*qq - xq*xq) * mq
    ELSE my - coalesce(CASE WHEN xx > 1e-9 THEN xy / xx END, 0) * mx END END, 6) AS y_bench FROM s"""))
def o73_quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(benchmark.benchmark_predictions(fx.keyed_fact(spark, sf_dir), "quadratic").select("adm", "harv_year", "y_bench"), "y_bench")


@query("flagship_region_performance", sql("yf", "+" + _BENCH + """, l AS (SELECT *, y / nullif(n, 0) AS m FROM b)
  SELECT country, adm, count(*) AS n, round(sqrt(avg((yield - y_bench) * (yield - y_bench))), 6) AS rmse, round(1 - sum((yield - y_bench) * (yield - y_bench)) / sum((yield - m) * (yield - m)), 5) AS r2
  FROM l GROUP BY ALL HAVING count(*) >= 3"""))
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the trivial benchmark predicts each region's yield."""
    rows = benchmark.benchmark_predictions(fx.keyed_fact(spark, sf_dir)).withColumn("y_pred", F.col("y_bench"))
    return rounded(rounded(region_performance(rows).drop("brr2"), "rmse"), "r2", digits=5)


@query("o92_attach_geometry", sql("yf", """+ a AS (SELECT country, adm1, adm2, sum(area) AS area FROM yf WHERE harv_year = 1999 AND adm2 <> 'BUILDING' GROUP BY ALL), r AS (SELECT DISTINCT country, adm1, adm2, length(adm1) AS geometry FROM yf)
  SELECT country, adm1, adm2, area, geometry, adm2 AS label FROM r LEFT JOIN a USING (country, adm1, adm2)"""))
def o92(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = fx.yield_fact(spark, sf_dir)
    sums = fact.where("harv_year = 1999 AND adm2 <> 'BUILDING'").groupBy(*REGION).agg(F.sum("area").alias("area"))
    return attach_geometry(sums, fact.select(*REGION, F.length("adm1").alias("geometry")).distinct())


@query("o101_unmatched_regions", sql("yf", """SELECT DISTINCT adm, 'yield' AS missing FROM yk WHERE adm2 = 'BUILDING' AND adm1 <> 'NATION_1' UNION ALL SELECT DISTINCT adm, 'geometry' FROM yk WHERE adm1 = 'NATION_1' AND adm2 <> 'BUILDING'"""))
def o101(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = fx.keyed_fact(spark, sf_dir)
    return unmatched_regions(fact.where("adm1 <> 'NATION_1'"), fact.where("adm2 <> 'BUILDING'"))


REGISTRY.sql.update({name: steady(text) for name, text in REGISTRY.sql.items()})
