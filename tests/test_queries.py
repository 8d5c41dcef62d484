"""Every registered query with an equivalent against DuckDB on the smallest tables."""

import duckdb
import pytest

from textloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(v):
    if type(v).__name__ == "Decimal":
        v = float(v)
    if isinstance(v, float):
        return round(v, 5)
    return tuple(plain(x) for x in v) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equal(name, spark, duck, small):
    df = registry.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = duck.sql(registry.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(want.columns) == columns
    assert got == sorted((tuple(plain(x[i]) for i in at) for x in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(name, spark, small):
    assert registry.QUERIES[name](spark, small).count() > 0


def test_flagship(spark, small):
    rows = registry.flagship(spark, small).collect()
    assert 0 < len(rows) <= 20
