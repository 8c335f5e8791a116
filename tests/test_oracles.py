"""Every registered query with SQL, held against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NaT or value != value:
        return "null"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if hasattr(value, "year"):
        return str(pd.Timestamp(value))
    if isinstance(value, (int, float)) or type(value).__module__ == "numpy":
        return f"{float(value):.9g}"
    return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(plain(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    assert rows(entry.queries()[name](spark, sf).toPandas()) == rows(duck.execute(entry.oracle_sql()[name]).fetchdf())


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() == 150
