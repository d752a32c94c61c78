"""Pairs of names: none is lost by the bitmaps, and few are left that don't belong together."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from offerloom.functions import names as N
from offerloom.operators import matching as M


def test_similar_against_all_pairs(spark):
    rng = random.Random(8)
    parts = ["on", "the", "er", "ti", "an", "sh", "re", "ing", "ou", "é"]
    names = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(150)]
    names += [n[: len(n) // 2] + "".join(rng.choices(parts, k=3)) + n[len(n) // 2 :] for n in names[:80]]
    df = spark.createDataFrame(list(enumerate(sorted(set(names)))), "id long, norm string").withColumn("grams", N.trigrams(F.col("norm"))).cache()
    sets = {r.id: set(r.grams) for r in df.collect()}
    for t in (0.4, 0.7):
        want = {(a, b) for a in sets for b in sets if a < b and 2 * len(sets[a] & sets[b]) / (len(sets[a]) + len(sets[b])) + M.EPSILON >= t}
        assert want and {(r.a, r.b) for r in M.similar(df, t).collect()} == want


@pytest.mark.parametrize("name", ["a_11_cluster_score", "j_09_redirect_targets", "x_06_dice", "a_10_mean_edge", "g_01_edges", "g_02_components", "g_01_matcher", "w_14_one_per_shop", "w_15_canonical"])
def test_few_pairs_are_compared_whole(spark, small, monkeypatch, name):
    """Of the pairs that share a rare gram most end before their sets are moved, in as many tasks as the session has partitions."""
    seen, real = [], M.head_pairs

    def counted(heads, threshold):
        out = real(heads, threshold)
        met = heads.alias("x").join(heads.alias("y"), "gram").where("x.id < y.id").select("x.id", "y.id").distinct().count()
        seen.append((out.count(), met))
        return out

    monkeypatch.setattr(M, "head_pairs", counted)
    entry.queries()[name](spark, small).count()
    assert seen and all(10 * left < met for left, met in seen), seen
