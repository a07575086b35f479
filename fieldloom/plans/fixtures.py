"""Stand-ins for the domain's tables, derived by Spark from the star-schema tables, with the same definitions in SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.plans.registry import table

REGION = ["country", "adm1", "adm2"]

#: Common table expressions by name; ``sql`` puts those that a query names before its text.
CTES = {
    "yf": """yf AS (SELECT r_name AS country, n_name AS adm1, c_mktsegment AS adm2, 'Annual' AS season, year(o_orderdate)::INT AS harv_year,
  sum(l_quantity) AS area, sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / 100000 AS production,
  sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / 100000 / sum(l_quantity) AS yield
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
yk AS (SELECT *, '[' || country || ' ' || adm1 || ' ' || adm2 || ']' AS adm FROM yf)""",
    "mf": """mf AS (SELECT n_name AS adm, (12 * year(o_orderdate) + month(o_orderdate))::INT AS harv_year, sum(l_quantity) AS area,
  sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / 100000 / sum(l_quantity) AS yield
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)""",
    "daily": """daily AS (SELECT n_name AS adm, l_shipdate::DATE AS date, avg(l_quantity) AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)""",
    "ev": """ev AS (SELECT 'u' || (user_id % 25) AS adm, ts::DATE AS date, (sum(round(value * 100)::BIGINT) // count(*))::DOUBLE / 100 AS value FROM events GROUP BY ALL)""",
    "gap": """gap AS (SELECT adm, date, CASE WHEN (day(date) * 7 + length(adm)) % 5 = 0 THEN NULL ELSE value END AS value FROM ev)""",
    "cal": """cal AS (SELECT n_name AS adm, (200 + 5 * n_nationkey % 150)::INT AS sos, (60 + 3 * n_nationkey % 120)::INT AS eos, n_nationkey FROM nation)""",
    "pixels": """pixels AS (SELECT l_shipdate::DATE AS date, (l_partkey % 64)::INT AS row, (l_suppkey % 64)::INT AS col, l_quantity AS value FROM lineitem)""",
    "mask": """grid AS (SELECT (range // 64)::INT AS row, (range % 64)::INT AS col FROM range(4096)),
crop AS (SELECT row, col, ((7 * row + 13 * col) % 101)::INT AS weight FROM grid),
mask AS (SELECT 'R' || (8 * (row // 8) + col // 8) AS adm, row, col, weight FROM crop WHERE weight > 0)""",
    "pred": """pred AS (SELECT yk.*, avg(yield) OVER (PARTITION BY adm) AS y_bench, 'run' || r AS run_id, r AS n_opt_trials, 0.01 * r AS train_mse,
  yield * (1 + ((harv_year * 7 + length(adm2) * 3 + r) % 11 - 5) / 100.0::DOUBLE) AS y_pred FROM yk, (VALUES (1), (2)) AS runs(r))""",
    "win": """win AS (SELECT adm, harv_year, make_date(harv_year - 1, 1, 1) + (sos - 60 - 1) AS first, make_date(harv_year, 1, 1) + (eos - 60 - 1) AS last
  FROM (SELECT DISTINCT n_name AS adm, year(o_orderdate)::INT AS harv_year FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) JOIN cal USING (adm)),
season AS (SELECT daily.*, harv_year FROM daily JOIN win USING (adm) WHERE date BETWEEN first AND last)""",
}


def sql(names: str, body: str) -> str:
    return "WITH " + ",\n".join(CTES[n] for n in names.split()) + ("," if body.lstrip().startswith("+") else "") + "\n" + body.lstrip().removeprefix("+")


def recursive(text: str) -> str:
    """SQL whose common table expressions may refer to themselves."""
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


def least_squares(rows: str, basis: int) -> str:
    """CTEs from ``rows`` (adm, y, b: list of ``basis`` values) to ``beta`` (adm, beta), by Gauss and Jordan on the normal equations."""
    line = lambda i: ", ".join([*[f"sum(b[{i}] * b[{j}])" for j in range(1, basis + 1)], f"sum(b[{i}] * y)"])
    gram = ", ".join(f"[{line(i)}]" for i in range(1, basis + 1))
    return f"""gram AS (SELECT adm, 1 AS k, [{gram}] AS m FROM {rows} GROUP BY adm),
solve AS (SELECT * FROM gram UNION ALL SELECT adm, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda x: x / r[k]) ELSE list_transform(r, lambda x, j: x - r[k] * m[k][j] / m[k][k]) END)
  FROM solve WHERE k <= {basis}),
beta AS (SELECT adm, list_transform(m, lambda r: r[{basis + 1}]) AS beta FROM solve WHERE k = {basis} + 1)"""


def slope_p(r2: str, n: str, steps: int = 4000) -> str:
    """SQL for a slope's two-sided p-value: the integral of cos^(dof - 1) from the angle of t on, as a share of the whole, by Simpson's rule."""
    area = lambda a: f"(pi() / 2 - {a}) * list_sum(list_transform(range(0, {steps + 1}), lambda i: (CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(greatest(cos({a} + (pi() / 2 - {a}) * i / {steps}), 0), {n} - 3)))"
    return f"CASE WHEN {n} > 2 THEN CASE WHEN {r2} >= 1 THEN 0.0 ELSE ({area(f'atan(sqrt(greatest({r2}, 0) / (1 - {r2})))')}) / ({area('0.0::DOUBLE')}) END END"


#: Added before rounding, so that exact halves go the same way whatever order they were summed in.
NUDGE = 1e-9


def rnd(c: Column | str, digits: int) -> Column:
    """Rounded, exact halves upwards, and never minus zero."""
    return F.round((F.col(c) if isinstance(c, str) else c) + NUDGE, digits) + F.lit(0.0)


def steady(text: str) -> str:
    """SQL with each ``round(x, digits)`` as ``rnd`` does it."""
    out, at = "", 0
    for found in re.finditer(r"\bround\(", text):
        if found.start() < at:
            continue
        depth, end, comma = 1, found.end(), None
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            comma = end if text[end] == "," and depth == 1 else comma
            end += 1
        if comma is None:
            continue
        out += f"{text[at:found.start()]}(round(({text[found.end():comma]}) + {NUDGE}::DOUBLE, {text[comma + 1:end - 1].strip()}) + 0.0::DOUBLE)"
        at = end
    return out + text[at:]


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's sums with its customer's nation and segment. Lines are added up by order before they meet anything, orders meet the customers first."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    lines = lines.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("l_quantity"), F.sum("cents").alias("cents"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    placed = orders.join(customers.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")), F.col("o_custkey") == F.col("c_custkey"))
    placed = placed.select("o_orderkey", "o_orderdate", "c_mktsegment", "n_name", "r_name")
    return lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))


def yield_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each market segment of a nation and year."""
    rows = _orders(spark, sf_dir).groupBy(
        F.col("r_name").alias("country"), F.col("n_name").alias("adm1"), F.col("c_mktsegment").alias("adm2"), F.year("o_orderdate").alias("harv_year")
    ).agg(F.sum("l_quantity").alias("area"), (F.sum("cents").cast("double") / 100000).alias("production"))
    return rows.select(*REGION, F.lit("Annual").alias("season"), "harv_year", "area", "production", (F.col("production") / F.col("area")).alias("yield"))


def keyed_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.functions.keys import with_adm

    return with_adm(yield_fact(spark, sf_dir))


def monthly_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each nation and month; ``harv_year`` counts months."""
    period = (12 * F.year("o_orderdate") + F.month("o_orderdate")).alias("harv_year")
    rows = _orders(spark, sf_dir).groupBy(F.col("n_name").alias("adm"), period)
    return rows.agg(F.sum("l_quantity").alias("area"), (F.sum("cents").cast("double") / 100000 / F.sum("l_quantity")).alias("yield"))


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("date"), "l_quantity")
    suppliers = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("n_name").alias("adm"), "date").agg(F.avg("l_quantity").alias("value"))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense month of daily values of 25 groups of users."""
    adm = F.concat(F.lit("u"), (F.col("user_id") % 25).cast("string")).alias("adm")
    rows = table(spark, sf_dir, "events").groupBy(adm, F.col("ts").cast("date").alias("date"))
    return rows.agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.count("*").alias("n")).select("adm", "date", (F.expr("cents div n").cast("double") / 100).alias("value"))


def gappy_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = (F.dayofmonth("date") * 7 + F.length("adm")) % 5 == 0
    return event_series(spark, sf_dir).withColumn("value", F.when(~missing, F.col("value")))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("adm"), (200 + 5 * n % 150).cast("int").alias("sos"), (60 + 3 * n % 120).cast("int").alias("eos"), n)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda c: (F.col(c) % 64).cast("int")
    return table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"), cell("l_partkey").alias("row"), cell("l_suppkey").alias("col"), F.col("l_quantity").alias("value"))


def grid(spark: SparkSession) -> DataFrame:
    return spark.range(4096).select(F.expr("id div 64").cast("int").alias("row"), (F.col("id") % 64).cast("int").alias("col"))


def crop_mask(spark: SparkSession) -> DataFrame:
    return grid(spark).withColumn("weight", (7 * F.col("row") + 13 * F.col("col")) % 101)


def regions_of_cells(spark: SparkSession) -> DataFrame:
    block = F.expr("8 * (row div 8) + col div 8").cast("string")
    return grid(spark).select(F.concat(F.lit("R"), block).alias("adm"), "row", "col")


def mask(spark: SparkSession) -> DataFrame:
    from fieldloom.operators.zonal import region_mask

    return region_mask(regions_of_cells(spark), crop_mask(spark))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    rows = keyed_fact(spark, sf_dir).withColumn("y_bench", F.avg("yield").over(W.partitionBy("adm"))).withColumn("r", F.explode(F.array(F.lit(1), F.lit(2))))
    error = ((F.col("harv_year") * 7 + F.length("adm2") * 3 + F.col("r")) % 11 - 5) / F.lit(100.0)
    return rows.withColumns({"run_id": F.concat(F.lit("run"), F.col("r").cast("string")), "n_opt_trials": F.col("r"), "train_mse": 0.01 * F.col("r"), "y_pred": F.col("yield") * (1 + error)}).drop("r")


def nation_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(adm, harv_year) of nations."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("harv_year"))
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("adm"))
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("adm", "harv_year").distinct()


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    trial = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").withColumn("trial", trial)
    start = F.col("ts").cast("timestamp")
    end = F.timestamp_micros(F.unix_micros(start) + F.round(F.col("value") * 100).cast("long") * 10000)
    return rows.select(F.concat(F.lit("run"), (F.col("user_id") % 3).cast("string")).alias("run_id"), F.col("user_id").cast("string").alias("study"), "trial", (F.col("user_id") % 2 == 0).alias("sequential"), start.alias("t_start"), end.alias("t_complete"))
