"""Every query of the catalogue against its SQL in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__
from civicgrid import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


def plain(value):
    return repr(round(value, 6)) if isinstance(value, float) else repr(value)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, database, name):
    out = catalogue.QUERIES[name](spark, SF)
    rows = out.collect()
    if name not in catalogue.ORACLE:
        return
    want = database.sql(catalogue.ORACLE[name])
    columns = sorted(want.columns)
    assert columns == sorted(out.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert sorted(tuple(map(plain, r)) for r in want.project(quoted).fetchall()) == sorted(tuple(plain(r[c]) for c in columns) for r in rows)


def test_entry_points(spark):
    names = __spark_entry__.queries()
    assert set(catalogue.QUERIES) <= set(names) and set(__spark_entry__.oracle_sql()) <= set(names)
    assert __spark_entry__.entry(spark).count() > 0
