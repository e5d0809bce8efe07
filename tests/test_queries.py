"""Every registered query with SQL equals it on the smallest tables; the others run."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from wayfarer import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, float):
        return f"{v:.9g}"
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf, duck, name):
    df = plans.QUERIES[name](spark, sf)
    rows, columns = df.collect(), sorted(df.columns)
    if name in plans.ORACLES:
        result = duck.execute(plans.ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        other = [dict(zip(names, r, strict=True)) for r in result.fetchall()]
        assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == sorted(tuple(plain(r[c]) for c in columns) for r in other)


def test_entry(spark):
    assert 0 < entry.entry(spark).count() <= 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_oracle_is_text():
    """No query is its own oracle."""
    assert all(isinstance(sql, str) and sql.strip() for sql in entry.oracle_sql().values())
