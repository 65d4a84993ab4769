"""Queries on small tables whose keys or counts are beyond those of the given ones, against their SQL."""

import duckdb
import pytest

from civicgrid.catalogue import ORACLE, QUERIES

TABLES = {
    "record_enrichment": {
        "part": "SELECT k AS p_partkey FROM range(6) t(k)",
        "lineitem": "SELECT 5000000 + 977 * k AS l_orderkey, k % 6 AS l_partkey, k * 31 % 400 AS l_suppkey, CAST(k * 7 % 4 + 1 AS INTEGER) AS l_linenumber, CAST(k % 50 AS DOUBLE) AS l_quantity, k % 11 / 100 AS l_discount, k % 9 / 100 AS l_tax FROM range(200) t(k)",
    },
    "visitors_by_span": {"events": "SELECT k AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * k AS ts, CAST(CASE WHEN k % 50 > 0 THEN k * 7919 % 29999 END AS BIGINT) AS user_id, CASE WHEN k % 9 > 0 THEN 'view' ELSE 'click' END AS event_type, 1.0::DOUBLE AS value, '{\"k\": ' || k % 3 || '}' AS props FROM range(40000) t(k)"},
}


@pytest.mark.parametrize("name", sorted(TABLES))
def test_query_beyond_the_given_sizes(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table, sql in TABLES[name].items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    want = con.sql(ORACLE[name])
    got = QUERIES[name](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in got.collect())
