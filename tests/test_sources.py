import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldloom.functions.keys import assign_parent, attach_geometry, rename_values, unmatched_regions, with_adm
from fieldloom.sources import reports as R


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_delimited_variants(spark, tmp_path):
    (tmp_path / "a.csv").write_text("country;value\nX;1.5\nY;\n")
    assert rows(R.read_reports(spark, str(tmp_path / "a.csv"), "country string, value double", ";")) == [("X", 1.5), ("Y", None)]
    (tmp_path / "b.csv").write_text("x,y,Z,3\nx,y,W,None\n")
    got = R.read_reports(spark, str(tmp_path / "b.csv"), "a string, b string, c string, d string", header=False, positions={2: "adm1", 3: "value"})
    assert rows(got) == [("W", "None"), ("Z", "3")]
    (tmp_path / "c.txt").write_text("l m 1 -\n")
    assert rows(R.read_reports(spark, str(tmp_path / "c.txt"), "a string, b string, c double, d double", " ", "-", False)) == [("l", "m", 1.0, None)]


def test_mapping_of_reports(spark):
    raw = spark.createDataFrame([("A", "P", "none", "S", "2001-05-01", "Maize", "Yield", "2.5"), ("A", "P", None, "S", "bad", "Maize", "Yield", "x"), ("B", "P", "Q", "S", "2001", "Maize", "Yield", "1"), ("A", "P", "Q", "S", "2002", "Rice", "Yield", "1")], "country string, admin_1 string, admin_2 string, season_name string, season_date string, crop string, indicator string, value string")
    got = R.map_reports(raw, "A", {"admin_1": "adm1", "admin_2": "adm2", "season_name": "season"}, "Maize")
    assert rows(got) == [("A", "P", "None", "S", 2001, "Yield", 2.5), ("A", "P", "None", "S", None, "Yield", None)]


def test_year_blocks_drop_incomplete(spark):
    raw = spark.createDataFrame([(0, "1", "2"), (1, "3", None), (2, "3", "1"), (3, "5", "6"), (4, "10", "6"), (5, "2", "1")], "row int, `2011` string, `2012` string")
    got = R.unpivot_year_blocks(raw, {0: "P", 1: "Q"}, {"country": "T"})
    assert rows(got) == [("T", "P", 2011, 1000.0, 3000.0, 3.0), ("T", "Q", 2011, 5000.0, 10000.0, 2.0), ("T", "Q", 2012, 6000.0, 6000.0, 1.0)]


def test_matrix_round_trip_and_labels(spark):
    wide = spark.createDataFrame([("a", " ", "1.5"), ("b", "2", None)], "adm string, `2000_02_30` string, `2001_01_01` string")
    long = R.wide_to_long(R.blank_to_null(wide, ["2000_02_30", "2001_01_01"]), ["adm"])
    assert rows(long) == [("a", dt.date(2000, 2, 28), None), ("a", dt.date(2001, 1, 1), 1.5), ("b", dt.date(2000, 2, 28), 2.0), ("b", dt.date(2001, 1, 1), None)]
    back = R.wide_to_long(R.long_to_wide(long, ["adm"], ["2000-02-28", "2001-01-01"]), ["adm"])
    assert rows(back) == rows(long)


def test_file_dates(spark):
    df = spark.createDataFrame([("d/" + "x" * 18 + "2003_07_04.tif", "d/" + "y" * 22 + "20030704.tif", "short")], "a string, b string, c string")
    got = df.select(R.file_date(F.col("a"), "ndvi"), R.file_date(F.col("b"), "precipitation"), R.file_date(F.col("c"), "temperature")).head()
    assert tuple(got) == (dt.date(2003, 7, 4), dt.date(2003, 7, 4), None)


def test_keys_and_expectations(spark, tmp_path):
    df = spark.createDataFrame([("Malawi", "Cent'ral", "Dedza", 2001), ("Tanzania", "Arusha", "None", 2002), ("T", "B", "C", 1990)], "country string, adm1 string, adm2 string, harv_year int")
    assert [r.adm for r in with_adm(df).orderBy("country", "adm1").collect()] == ["[Malawi Central Dedza]", "[T B C]", "[Tanzania Arusha]"]
    assert R.load_yield(df, expected_rows=2).count() == 2
    with pytest.raises(ValueError, match="expected 3"):
        R.load_yield(df, expected_rows=3)
    named = rename_values(rename_values(df, "adm2", {"Dedza": "X"}), "adm2", {"X": "Y"})
    assert {r.adm2 for r in assign_parent(named, {"Y": "New"}).where("adm1 = 'New'").collect()} == {"Y"}
    R.write_table(df, str(tmp_path / "t"), ["country"])
    assert rows(spark.read.parquet(str(tmp_path / "t")).select(*df.columns)) == rows(df)
    R.write_table(df, str(tmp_path / "c"), kind="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3
    assert R.dekad_scaffold(df.select("adm1"), 2000, 2001).count() == 3 * 2 * 36


def test_geometry(spark):
    regions = spark.createDataFrame([("A", "P", "None", "g1"), ("A", "P", "Q", "g2")], "country string, adm1 string, adm2 string, geometry string")
    df = spark.createDataFrame([("A", "P", "Q", 1)], "country string, adm1 string, adm2 string, v int")
    assert sorted((r.label, r.v) for r in attach_geometry(df, regions).collect()) == [("P", None), ("Q", 1)]
    with pytest.raises(ValueError, match="geometry"):
        attach_geometry(df, regions.withColumn("geometry", F.lit(None).cast("string")))
    assert rows(unmatched_regions(regions, df, ["adm2"])) == [("None", "yield")]
