"""Reading, reshaping and writing of yield reports and regional matrices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions.keys import with_adm


def read_reports(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",", null_value: str = "", header: bool = True, positions: Mapping[int, str] | None = None) -> DataFrame:
    """Delimited text. Without a header, ``positions`` names the columns wanted by place; others are not parsed into the result."""
    df = spark.read.schema(schema).option("sep", sep).option("nullValue", null_value).option("header", header).csv(path)
    return df if positions is None else df.select(*[F.col(df.columns[i]).alias(name) for i, name in positions.items()])


def map_reports(
    df: DataFrame, country: str, rename: Mapping[str, str], crop: str | None = None, systems: Sequence[str] | None = None, date_col: str = "season_date"
) -> DataFrame:
    """One country's reports of one crop under the common names (country, adm1, adm2, season, harv_year, indicator, value).

    ``rename`` maps source columns to those names. The region name ``none`` becomes ``"None"``, as a null second level does; the
    harvest year is the first four characters of the date, null if they are no number.
    """
    rows = df.where(F.col("country") == country)
    if crop is not None:
        rows = rows.where(F.col("crop") == crop)
    if systems is not None:
        rows = rows.where(F.col("crop_production_system").isin(*systems))
    rows = rows.withColumnsRenamed(dict(rename))
    for level in ("adm1", "adm2"):
        name = F.col(level) if level in rows.columns else F.lit(None).cast("string")
        rows = rows.withColumn(level, F.when(name.isNull() | (F.lower(name) == "none"), F.lit("None")).otherwise(name))
    return rows.withColumn("harv_year", F.substring(F.col(date_col).cast("string"), 1, 4).try_cast("int")).select(
        "country", "adm1", "adm2", "season", "harv_year", "indicator", F.col("value").try_cast("double").alias("value")
    )


def unpivot_year_blocks(
    df: DataFrame,
    regions: Mapping[int, str],
    constants: Mapping[str, str],
    row_col: str = "row",
    measures: Sequence[str] = ("area", "production", "yield"),
    scale: Mapping[str, float] = {"area": 1000.0, "production": 1000.0},
) -> DataFrame:
    """Blocks of one row a measure and region, years in columns, to one row a region and year; incomplete ones are dropped.

    ``row_col`` numbers the source's rows from 0: row ``len(measures) * region + measure``. ``regions`` names the regions by number.
    """
    years = [c for c in df.columns if c[:4].isdigit()]
    n = len(measures)
    long = df.select(row_col, *[F.col(y).try_cast("double").alias(y) for y in years]).unpivot(row_col, years, "harv_year", "value")
    names = F.create_map(*[x for k, v in regions.items() for x in (F.lit(int(k)), F.lit(v))])
    kind = F.element_at(F.array(*map(F.lit, measures)), (F.col(row_col) % n + 1).cast("int"))
    long = long.select(
        names[F.floor(F.col(row_col) / n).cast("int")].alias("adm1"), F.substring("harv_year", 1, 4).cast("int").alias("harv_year"), kind.alias("measure"), "value"
    ).where(F.col("adm1").isNotNull())
    wide = long.groupBy("adm1", "harv_year").pivot("measure", list(measures)).agg(F.first("value")).dropna()
    scaled = [(F.col(m) * scale.get(m, 1.0)).alias(m) for m in measures]
    return wide.select(*[F.lit(v).alias(k) for k, v in constants.items()], "adm1", "harv_year", *scaled)


def blank_to_null(df: DataFrame, numeric_cols: Sequence[str]) -> DataFrame:
    """Text columns as doubles; blanks, NaN and text that is no number become null."""

    def number(c: str) -> Column:
        value = F.trim(F.col(c).cast("string")).try_cast("double")
        return F.when(F.isnan(value), F.lit(None)).otherwise(value)

    return df.withColumns({c: number(c) for c in numeric_cols})


def matrix_date(label: Column) -> Column:
    """Date of a column label ``YYYY_MM_DD``; the 30th of February is read as the 28th."""
    return F.to_date(F.replace(label, F.lit("02_30"), F.lit("02_28")), "yyyy_MM_dd")


def wide_to_long(df: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """A regional matrix as (ids, date, value): value columns are those whose first four characters are digits."""
    dates = [c for c in df.columns if c not in id_cols and c[:4].isdigit() and len(c) >= 4]
    long = df.select(*id_cols, *[F.col(c).try_cast("double").alias(c) for c in dates]).unpivot(list(id_cols), dates, "label", "value")
    return long.select(*id_cols, matrix_date(F.col("label")).alias("date"), "value")


def long_to_wide(df: DataFrame, id_cols: Sequence[str], dates: Sequence[str], date_col: str = "date", value_col: str = "value") -> DataFrame:
    """One column ``YYYY_MM_DD`` for each of the given dates (ISO text); absent ones are null."""
    label = F.date_format(date_col, "yyyy_MM_dd")
    return df.withColumn("__label", label).groupBy(*id_cols).pivot("__label", [d.replace("-", "_") for d in dates]).agg(F.first(value_col))


#: Where the date stands in an image file's name: first character from 1, length, format. Fixed by the files' producers.
FILE_DATES = {"ndvi": (19, 10, "yyyy_MM_dd"), "precipitation": (23, 8, "yyyyMMdd"), "temperature": (28, 8, "yyyyMMdd")}


def file_date(path: Column, product: str) -> Column:
    """Date in the name of an image file of one product; null where there is none."""
    start, length, pattern = FILE_DATES[product]
    return F.try_to_timestamp(F.substring(F.substring_index(path, "/", -1), start, length), F.lit(pattern)).cast("date")


def dekad_scaffold(df: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Every row of ``df`` with every (year, month, dekad of 10, 20 and 30) and a null value."""
    numbers = lambda a, b, step=1: F.explode(F.sequence(F.lit(a), F.lit(b), F.lit(step)))
    rows = df.withColumn("year", numbers(first_year, last_year)).withColumn("month", numbers(1, 12)).withColumn("dekad", numbers(10, 30, 10))
    return rows.withColumn("value", F.lit(None).cast("double"))


def load_yield(df: DataFrame, first_year: int = 2001, last_year: int = 2023, expected_rows: int | None = None) -> DataFrame:
    """Rows of a closed range of years with the region key; another number of rows than expected fails the job."""
    out = with_adm(df.where(F.col("harv_year").between(first_year, last_year))).withColumn("adm1_", F.concat_ws("_", "country", "adm1"))
    if expected_rows is not None and (n := out.count()) != expected_rows:
        raise ValueError(f"{n} rows, expected {expected_rows}")
    return out


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), kind: str = "parquet", mode: str = "overwrite") -> None:
    """Write as Parquet partitioned by columns, or as CSV with a header.

    Rows of a partition are brought together first by a rebalancing shuffle, in which a partition value with many rows is split
    over several tasks, and small ones share a task.
    """
    rows = df.hint("rebalance", *partition_by) if partition_by else df
    writer = rows.write.mode(mode).partitionBy(*partition_by)
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames by column name."""
    return reduce(DataFrame.unionByName, frames)
