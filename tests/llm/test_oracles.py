"""The registered queries of the subpackage that have SQL, against it."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from offerloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_sql(spark, name, sf):
    at = f"/root/testdata/{sf}"
    df = queries.queries()[name](spark, at)
    columns = sorted(df.columns)
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    found = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = Counter(tuple(r[names.index(c)] for c in columns) for r in found.fetchall())
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == want
