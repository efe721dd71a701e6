"""Every registered query of the engine against its DuckDB equivalent at the smallest scale."""

from __future__ import annotations

import math

import duckdb
import pytest

from barloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return str(v)[:19].replace(" 00:00:00", "") if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_duckdb(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    want = duck.sql(registry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    expected = sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=repr)
    assert got == expected


def test_rows_only_queries_run(spark, sf):
    for name in sorted(set(registry.queries()) - set(registry.oracle_sql())):
        assert registry.queries()[name](spark, sf).count() > 0


def test_flagship(spark, sf):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns[0] == "security_code" and df.count() > 0
