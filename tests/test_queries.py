"""Every registered query of the library against its SQL, over the smallest tables."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

import offerloom.queries  # noqa: F401
from offerloom.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 6) if isinstance(v, float) else float(v) if hasattr(v, "quantize") else v


@pytest.fixture(scope="session")
def duck(small):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in ORACLES:
        return
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in found.fetchall()]
    assert Counter(map(repr, got)) == Counter(map(repr, want))


def test_entry_works_without_the_removable_parts():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
