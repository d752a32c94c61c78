"""The pipeline's run against its stages done plainly, over the smallest tables."""

from __future__ import annotations

import zlib
from collections import Counter

import corpus_pipeline as P
from offerloom.llm import quality
from offerloom.llm.queries import tokenizer


def test_run(spark, small):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{small}/labels.parquet")
    kept = {r.doc_id for r in quality.judge(docs, labels).collect() if r.kept}
    assert 0.5 * len(rows) < len(kept) < len(rows)

    sets = {}
    for i in sorted(kept):
        w = rows[i].text.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    root = {i: i for i in kept}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in kept:
        for b in kept:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    single = {i for i in kept if find(i) == i}

    got = P.run(spark, small).collect()
    assert {r.doc_id for r in got} <= single
    copies = Counter(r.doc_id for r in got if r.piece == 0)
    size = {i: len(rows[i].text.encode().split()) for i in single}
    by_source: dict[str, int] = {}
    for i in single:
        by_source[rows[i].source] = by_source.get(rows[i].source, 0) + size[i]
    sources = sorted(by_source)
    weight = {s: 1.0 + k % 3 for k, s in enumerate(sources)}
    target, left, room = {}, set(sources), float(sum(by_source.values()))
    while left:
        level = room / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 3 * by_source[s]}
        if not over:
            target |= {s: level * weight[s] for s in left}
            break
        target |= {s: 3.0 * by_source[s] for s in over}
        room -= sum(target[s] for s in over)
        left -= over
    for s in sources:
        taken = sum(size[i] * copies[i] for i in single if rows[i].source == s)
        assert abs(taken - target[s]) <= max(size[i] for i in single if rows[i].source == s)
        assert len({copies[i] for i in single if rows[i].source == s}) <= 2

    encode = Tokenizer.from_file(tokenizer("byte_bpe_50k.json")).encode
    want = Counter()
    for i, n in copies.items():
        ids = encode(rows[i].text, add_special_tokens=False).ids + [0]
        starts = [0] if len(ids) <= 2048 else ([0] if len(ids) % 2048 else []) + list(range(len(ids) % 2048, len(ids), 2048))
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[i, k, a, b - a, zlib.crc32(b"".join(y.to_bytes(4, "little") for y in ids[a:b]))] += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs.limit(0), small).columns == docs.columns, name
    assert P.STAGES[-1][1](spark, docs.limit(0), small).count() == 0
