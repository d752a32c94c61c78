from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import types as T

from offerloom.llm import topk


def brute(rows, k=topk.K, every=topk.EVERY):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.setdefault(i, []).append([math.floor(64 * x) for x in v])
    out = set()
    for q in ok:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(ok[q][0], v)), c) for c in ok for v in ok[c] if c != q)[:k]
            out |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(scored)}
    return out


SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def test_search_with_ties_and_bad_rows(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(6, 64))
    rows = [(i, np.float32(centre[i % 6] * 0.3 + rng.normal(size=64) * (0.05 if i % 3 else 0)).tolist()) for i in range(400)]
    rows += [(1000, None), (1020, [None] * 64), (1040, [float("nan")] * 64), (1060, [float("inf")] + [0.0] * 63), (None, [0.1] * 64), (2000, []), (2001, [0.5] * 10)]
    got = topk.nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()
    assert {tuple(r) for r in got} == brute(rows)


@pytest.mark.parametrize("scale", [1.0, 1e3, 1e7, 1e12])
def test_block_pairs(scale):
    rng = np.random.default_rng(1)
    q, x = np.floor(rng.normal(size=(64, 30)) * scale), np.floor(rng.normal(size=(64, 700)) * scale * rng.uniform(0.01, 1, 700))
    ids = np.arange(700)
    at, of, score = topk.best(q, np.arange(30), x, ids, 20)
    for i in range(30):
        want = sorted((-min(max(sum(int(a) * int(b) for a, b in zip(q[:, i], x[:, j])), 1 - 2**63), 2**63 - 1), j) for j in range(700) if j != i)[:20]
        assert [(-s, ids[o]) for s, o in zip(score[at == i].tolist(), of[at == i])] == want


def test_small_and_empty(spark):
    assert topk.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert topk.nearest(spark.createDataFrame([(0, [1.0], 0)], SCHEMA)).count() == 0
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5])]
    got = topk.nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 1, 2048), (0, 2, 1, 2048)]


def test_one_large_vector_does_not_slow_its_block():
    import time

    rng = np.random.default_rng(2)
    q, x = np.floor(rng.normal(size=(384, 128)) * 20), np.floor(rng.normal(size=(384, 4096)) * 20)
    x[:, 7] = 2.0**30
    began = time.time()
    at, of, score = topk.best(q, np.arange(10_000, 10_128), x, np.arange(4096), 20)
    assert time.time() - began < 20
    for i in (0, 77):
        want = sorted((-int(s), j) for j, s in enumerate((q[:, i].astype(object) @ x.astype(object)).tolist()))[:20]
        assert [(-s, o) for s, o in zip(score[at == i].tolist(), of[at == i].tolist())] == want


def test_many_blocks_and_their_plan(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 37)
    monkeypatch.setattr(topk, "QUERIES", 5)
    rng = np.random.default_rng(3)
    rows = [(i, np.float32(rng.normal(size=24) * 0.3).tolist()) for i in range(900)]
    df = topk.nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(5))
    assert {tuple(r) for r in df.collect()} == brute(rows)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
