"""Self-joins of a key that many rows share: every pair once, no task with more of them than the others."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from offerloom.operators import clustering as C
from offerloom.operators import matching as M
from offerloom.operators import relational as R


def test_cells_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(R, "CELL_ROWS", 7)
    rng = random.Random(5)
    words = {d: {rng.choice("abcdefgh") for _ in range(4)} | {"all"} for d in range(90)}
    tokens = spark.createDataFrame([(d, w) for d, ws in words.items() for w in ws], "doc long, term string")
    want = {(a, b, len(words[a] & words[b])) for a in words for b in words if a < b}
    assert {tuple(r) for r in C.block_pairs(tokens, 90, 1, 1.0).collect()} == want
    sims = C.centroid_pairs(tokens.withColumn("w", F.lit(1.0))).collect()
    assert {(r.a, r.b, int(r.sim)) for r in sims} == want and len(sims) == len(want)
    products = spark.createDataFrame([(d, f"s{d % 3}", sorted(ws)) for d, ws in words.items()], "id long, shop string, grams array<string>")
    assert {(r.a, r.b, r.shared) for r in M.gram_pairs(products).collect()} == {x for x in want if x[0] % 3 != x[1] % 3}


@pytest.mark.parametrize("pairs", [lambda t: C.block_pairs(t, 20_000, 1, 1.0), lambda t: M.gram_pairs(t.select(F.col("doc").alias("id"), F.col("doc").cast("string").alias("shop"), F.array("term").alias("grams")))])
def test_a_frequent_key_is_many_tasks(spark, monkeypatch, pairs):
    seen, real = [], R.both_sides

    def kept(*args):
        seen.append(real(*args))
        return seen[-1]

    for module in (C, M):
        monkeypatch.setattr(module, "both_sides", kept)
    pairs(spark.range(20_000).select(F.col("id").alias("doc"), F.lit("x").alias("term")))
    x, _ = seen[0]
    sizes = [r["count"] for r in x.groupBy("_cell").count().collect()]
    assert len(sizes) == 5 and max(sizes) < 1.2 * 20_000 / 5 and x.rdd.getNumPartitions() == 20


def test_blocks_are_multiplied_where_they_meet(spark, monkeypatch):
    """Vectors of two blocks and more terms than are multiplied at once; a pair is not moved once it is made."""
    rng = random.Random(12)
    vectors = {d: {f"t{rng.randrange(2600)}": rng.random() for _ in range(25)} | ({"zero": 0.0} if d % 3 == 0 else {}) for d in range(1300)}
    made = C.centroid_pairs(spark.createDataFrame([(d, t, w) for d, v in vectors.items() for t, w in v.items()], "doc long, term string, w double"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "Exchange" not in plan.partition("FlatMapGroupsInPandas")[0]
    want = {(a, b): sum(w * vectors[b].get(t, 0.0) for t, w in vectors[a].items()) for a in vectors for b in vectors if a < b and vectors[a].keys() & vectors[b].keys()}
    got = {(r.a, r.b): r.sim for r in made.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
