"""The registered queries against their SQL, where the driver's tables are at hand."""

import os

import duckdb
import pytest

from fieldloom.plans import all_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
REGISTRY = all_queries()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        path = f"{SF}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(rows):
    return sorted((tuple(round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v if v is None else str(v) for v in row) for row in rows), key=str)


@pytest.mark.parametrize("name", sorted(REGISTRY.sql))
def test_query_equals_its_sql(spark, tables, name):
    df = REGISTRY.queries[name](spark, SF)
    columns = sorted(df.columns)
    names = [d[0] for d in tables.execute(REGISTRY.sql[name]).description]
    assert sorted(names) == columns
    want = plain([row[names.index(c)] for c in columns] for row in tables.execute(REGISTRY.sql[name]).fetchall())
    assert plain(df.select(*[f"`{c}`" for c in columns]).collect()) == want


@pytest.mark.parametrize("name", sorted(set(REGISTRY.queries) - set(REGISTRY.sql)))
def test_query_without_sql_has_rows(spark, name):
    assert REGISTRY.queries[name](spark, SF).count() > 0


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
