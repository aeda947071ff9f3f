"""Registered queries against their SQL."""

import duckdb
import pytest

from tidemark.plans import registry

DIR = "/root/testdata/sf0.001"


def shown(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    con.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in con.description]
    want = sorted((tuple(map(shown, r)) for r in con.fetchall()), key=str)
    got = registry.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(map(shown, r)) for r in got.select(*columns).collect()), key=str) == want


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)
