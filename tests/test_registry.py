"""Every registered query of the analytics library against its SQL."""

from __future__ import annotations

import math

import duckdb
import pytest

from matchlake.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def plain(rows, names):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(r[n]) for n in names) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf)
    want = duck.sql(registry.ORACLE_SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert plain([r.asDict() for r in got.collect()], names) == plain(rows, names)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
