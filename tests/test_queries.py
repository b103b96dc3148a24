from pathlib import Path

import duckdb
import pytest

from quern import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_against_sql(spark, tables, name):
    df = queries.QUERIES[name](spark, SF)
    expected = tables.sql(queries.SQL[name])
    columns = sorted(expected.columns)
    assert sorted(df.columns) == columns
    wanted = tables.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()
    key = lambda r: [(v is None, str(v)) for v in r]
    assert sorted(map(tuple, df.select(*columns).collect()), key=key) == sorted(wanted, key=key)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"flagship", "scan_table"} <= set(entry.queries())
