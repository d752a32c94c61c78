"""The level-by-level split against a plain recursion, on random vectors and on the clusters of the test table."""

from __future__ import annotations

import random

import numpy as np
import pytest

from offerloom.operators import clustering as C


def plain_sides(x, rounds=18):
    """0 and 1 for unit vectors (rows) by cosine from the first and the middle row, similarities to twelve places."""
    centre, label = x[[0, len(x) // 2]].copy(), np.zeros(len(x), int)
    for k in range(rounds):
        s = np.round(x @ centre.T, 12)
        new = (s[:, 1] > s[:, 0]).astype(int)
        if k and (new == label).all():
            break
        label = new
        for side in (0, 1):
            if (label == side).any():
                m = x[label == side].sum(0)
                centre[side] = m / max(np.linalg.norm(m), 1e-12)
    return label


def plain_cohesion(sets, sample=40, ahead=7):
    s = sets[:sample]
    j = [len(s[a] & s[b]) / max(len(s[a] | s[b]), 1) for a in range(len(s)) for b in range(a + 1, min(a + ahead + 1, len(s)))]
    return float(np.mean(j)) if j else 1.0


def plain_split(labels, vectors, tokens, largest, least_size, least_cohesion):
    terms = {t: k for k, t in enumerate(sorted({t for _, t, _ in vectors}))}
    x = {d: np.zeros(max(len(terms), 1)) for d in labels}
    for d, t, w in vectors:
        if d in x:
            x[d][terms[t]] = w
    sets = {d: set() for d in labels}
    for d, t in tokens:
        if d in sets:
            sets[d].add(t)
    groups, out = {}, {d: -1 for d, c in labels.items() if c < 0}
    for d, c in sorted(labels.items()):
        if c >= 0:
            groups.setdefault(c, []).append(d)
    todo = list(groups.values())
    while todo:
        part = todo.pop()
        weak = len(part) > largest or len(part) >= least_size and plain_cohesion([sets[d] for d in part]) < least_cohesion
        if len(part) < 8 or not weak:
            out |= dict.fromkeys(part, part[0])
            continue
        label = plain_sides(np.array([x[d] for d in part]))
        small = min((label == 0).sum(), (label == 1).sum())
        if small < 2 or small / len(part) < 0.05:
            label = (np.arange(len(part)) >= len(part) // 2).astype(int)
        todo += [[d for d, side in zip(part, label) if side == k] for k in (0, 1)]
    return out


def both(spark, labels, vectors, tokens, n, **limits):
    got = {r.doc: r.cluster for r in C.split_weak(labels, vectors, tokens, n, **limits).collect()}
    want = plain_split({r.doc: r.cluster for r in labels.collect()}, [tuple(r) for r in vectors.select("doc", "term", "w").collect()], [tuple(r) for r in tokens.select("doc", "term").distinct().collect()], limits.get("most") or max(n * 0.015, 250), limits["least_size"], limits["least_cohesion"])
    return got, want


@pytest.mark.parametrize("seed, most", [(1, 20), (2, None)])
def test_random_clusters(spark, seed, most):
    rng = random.Random(seed)
    themes = [[f"t{k}{c}" for c in "abcde"] for k in range(7)]
    docs = {d: rng.choices(themes[d % 7], k=3) + rng.choices(["u", "v", "w", "x"], k=2) if d % 11 else [] for d in range(1, 130)}
    tokens = spark.createDataFrame([(d, t) for d, ts in docs.items() for t in ts], "doc long, term string")
    vectors = C.tfidf(tokens, len(docs), 900, 2)
    labels = spark.createDataFrame([(d, 1 if d < 80 else 80 if d < 110 else -1 if d < 120 else 120) for d in docs], "doc long, cluster long")
    got, want = both(spark, labels, vectors, tokens, len(docs), least_size=10, least_cohesion=0.3, most=most)
    assert got == want and len(set(got.values())) > 4


def test_table_clusters(spark, small):
    from offerloom.queries.matching import dbscan_labels
    from offerloom.registry import Tables

    _, words, _, n, vectors, labels = dbscan_labels(Tables(spark, small))
    got, want = both(spark, labels, vectors, words, n, least_size=8, least_cohesion=0.5)
    assert got == want


def test_equal_and_missing_vectors_are_halved_by_order(spark):
    docs = {d: ["same", "words"] if d < 12 else [] for d in range(24)}
    tokens = spark.createDataFrame([(d, t) for d, ts in docs.items() for t in ts], "doc long, term string")
    labels = spark.createDataFrame([(d, 0 if d < 12 else 12) for d in docs], "doc long, cluster long")
    got, want = both(spark, labels, C.tfidf(tokens, 80, 900, 2), tokens, 24, least_size=8, least_cohesion=0.18, most=10)
    assert got == want and max(list(got.values()).count(c) for c in set(got.values())) == 6
