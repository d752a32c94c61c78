"""Many documents in few buckets: what the registers rule out never moves its sets."""

import random

import numpy as np
import pytest

from offerloom.llm import near_dedup


@pytest.fixture
def staged(monkeypatch):
    """Row counts of the staged tables, by their names."""
    counts: dict[str, int] = {}
    plain = near_dedup.stage

    def counted(df, name):
        out = plain(df, name)
        counts[name] = counts.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(near_dedup, "stage", counted)
    return counts


def test_unlinked_documents_that_share_a_passage(spark, staged):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(20000)]
    passage = rng.choices(words, k=300)
    texts = [(i, " ".join(passage + rng.choices(words, k=150))) for i in range(4000)]
    texts += [(4000 + k, t + " end") for k, (_, t) in enumerate(texts[:20])]
    got = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(8)).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i % 4000 for i, _ in texts}
    # with whole sets in the blocks, each row of "members" would take its set along
    assert staged["block-likely"] < 4000 < staged["members"]


def test_parts_hold_every_likely_pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 2000).astype("u8")
    sets = [np.unique(near_dedup.stir(np.concatenate([base[k : k + 300], rng.integers(0, 1 << 62, 5).astype("u8")]))) for k in rng.integers(0, 1000, 900)]
    size = np.array([len(s) for s in sets])
    regs = near_dedup.registers(np.concatenate(sets), np.cumsum(size) - size)
    component = rng.integers(0, 300, 900)
    both = np.arange(900)
    for same, left, right in ((True, both, both), (False, both[:500], both[500:])):
        near = near_dedup.near_by_registers(regs, size, component, left, right, 75)
        wanted = {tuple(sorted((int(left[i]), int(right[j])))) for i, j in zip(*np.nonzero(near))}
        parts = near_dedup.likely_parts(regs, size, component, left, right, same, 75)
        assert all(len(p) <= near_dedup.BLOCK_SETS + 1 for *_, p in parts)
        sides: dict = {}
        for i, j, side, p in parts:
            sides.setdefault((i, j), {})[side] = p.tolist()
        held = set()
        for s in sides.values():
            held |= {tuple(sorted((a, b))) for a in s[0] for b in s.get(1, s[0])}
        assert wanted and wanted <= held
