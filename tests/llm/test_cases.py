"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables, and columns with clashing names."""

from __future__ import annotations

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from offerloom.llm import chat, html_extract, lm_scoring, mixing, near_dedup, packing, quality, sharding, token_counts
from offerloom.llm.queries import tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "parola lunga " * 30_000
ROWS = [
    (1, "uno due tre quattro cinque sei sette", "it", "a", 1),
    (2, "uno due tre quattro cinque sei sette", "it", "a", 1),
    (2, "uno due tre quattro cinque sei sette", "it", "a", 1),
    (3, None, "it", "a", 1),
    (4, "", "it", None, 1),
    (5, " \n\t ", "it", None, 1),
    (6, LONG, "it", "b", 1),
    (7, "UNO due", "it", "b", 1),
    (8, "uno DUE", None, "b", None),
    (None, "senza numero <|endoftext|> qui", "it", "c", 1),
    (None, None, None, None, None),
]
CLASH = ["size", "slot", "shard", "bucket", "component", "kind", "n", "key", "salt", "rank", "copies", "target"]


@pytest.fixture(scope="module")
def docs(spark):
    """The rows, with extra columns named as operators name theirs."""
    df = spark.createDataFrame(ROWS, DOCS)
    return df.withColumns({c: F.lit("x") for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_sharding(docs, none):
    got = sharding.shard_documents(docs, 3, 64).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
    for s in range(3):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.law == "bytes" and r.grown_shard is None for r in got)
    assert sharding.shard_documents(none, 3, 64).count() == 0


def test_slot_maps(spark, tmp_path):
    sizes = [(i * 7919) % 1000 + 1 for i in range(512)]
    first = sharding.SlotMap.first(10, sizes, [1] * 512)
    second = first.rebalanced()
    assert max(second.loads()) - min(second.loads()) <= 0.002 * sum(sizes) / 10 and sum(second.loads()) == sum(sizes)
    third = second.grown()
    assert all(b in (a, 10) for a, b in zip(second.shard_of, third.shard_of)) and max(third.loads()) - min(third.loads()) < 0.05 * sum(sizes) / 11
    path = f"file://{tmp_path}/maps"
    assert [m.save(spark, path).version for m in (first, second, third)] == [1, 2, 3]
    assert [sharding.SlotMap.load(spark, path, v).shard_of for v in (1, 2, 3)] == [first.shard_of, second.shard_of, third.shard_of]


def test_runs_append_versions_of_the_map(spark, docs, tmp_path):
    path = f"file://{tmp_path}/maps"
    one = sharding.shard_documents(docs, 3, 64, store=path)
    first = sorted(map(tuple, one.collect()), key=str)
    assert sharding.SlotMap.versions(spark, path) == [1, 2]
    kept = sharding.SlotMap.load(spark, path, 2)
    assert sorted(map(tuple, sharding.shard_documents(docs, 3, 64, store=path).collect()), key=str) == first
    assert sharding.SlotMap.versions(spark, path) == [1, 2, 3] and sharding.SlotMap.latest(spark, path).shard_of == kept.shard_of
    more = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 100))
    sharding.shard_documents(more, 3, 64, store=path).count()
    edited = sharding.SlotMap.latest(spark, path)
    assert edited.version == 4 and sharding.SlotMap.load(spark, path, 2) == kept
    assert sum(a != b for a, b in zip(edited.shard_of, kept.shard_of)) < 20
    assert edited.save(spark, path).version == 5  # a number that is taken is never written again
    sharding.shard_documents(docs, 4, 64, store=path).count()
    assert sharding.SlotMap.latest(spark, path).shards == 4


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    size = {"a": 21, "b": 60_004, "c": 4, None: 0}
    total = sum(size.values())
    want, weight = {}, {"a": 1, "b": 2, "c": 3, None: 1}
    left, room = set(size), float(total)
    while left:  # share, clamp, share again
        over = {s for s in left if room * weight[s] / sum(weight[x] for x in left) > 3 * size[s]}
        if not over:
            want |= {s: room * weight[s] / sum(weight[x] for x in left) for s in left}
            break
        for s in over:
            want[s] = 3.0 * size[s]
            room -= want[s]
        left -= over
    words = lambda t: len((t or "").split())
    assert Counter((r.doc_id, r.size, r.source_size) for r in got) == Counter((i, words(t), size[s]) for i, t, _, s, _ in ROWS)
    for r in got:
        assert r.taken <= 3 * r.size and r.taken == r.size * r.copies
    assert {round(r.target, 6) for r in got if r.source_size == 21} == {round(want["a"], 6)} and {r.taken for r in got if r.source_size == 4 and r.doc_id is None and r.size} == {12}
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).columns == none.columns
    again = mixing.mixed_documents(docs)
    assert again.columns == docs.columns and again.count() == sum(r.copies for r in got)


def test_mix_comes_near_its_targets(spark):
    rows = [(i, "w " * (1 + i * 31 % 97), "s%d" % (0 if i % 3 == 0 else i % 7)) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(got) == 7 and all(abs(r.taken - r.target) <= 97 for r in got)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    reference = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, 64).collect()
    ids = lambda t: reference.encode(t or "", add_special_tokens=False).ids + [0]
    want = Counter()
    for i, t, *_ in ROWS:
        x = ids(t)
        starts = [0] if len(x) <= 64 else ([0] if len(x) % 64 else []) + list(range(len(x) % 64, len(x), 64))
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(x)])):
            want[i, k, a, b - a, zlib.crc32(b"".join(y.to_bytes(4, "little") for y in x[a:b]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= sum(k[3] * n for k, n in want.items()) // 64 + 2
    assert packing.pack_documents(none, path).count() == 0


def test_plan_uses_up_the_stock_tightly():
    import random

    rng = random.Random(1)
    counts = Counter(rng.choice([rng.randint(1, 2048), rng.randint(300, 700), 17]) for _ in range(5000))
    used: Counter = Counter()
    plan = packing.plan(dict(counts))
    for times, pattern in plan:
        assert sum(k * v for k, v in pattern.items()) <= 2048
        used.update({k: v * times for k, v in pattern.items()})
    assert used == counts
    assert sum(n for n, _ in plan) <= 1.01 * sum(k * v for k, v in counts.items()) / 2048


def test_two_fit_replaces_the_smallest():
    # greedily 60 + 20 + 15 leaves 5; 18 + 2 fills the room of the 15 exactly
    assert packing.plan({60: 1, 20: 1, 15: 1, 18: 0, 12: 1, 8: 1}, 100)[0] == (1, {60: 1, 20: 1, 12: 1, 8: 1})


def test_chunks_encode_as_whole_texts():
    import random

    import numpy as np
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    reference, encode, rng = Tokenizer.from_file(path), packing.ChunkEncoder(path), random.Random(2)
    texts = ["".join(rng.choice(["a", "b ", " ", "\n", "\t", "é", "12", "!", "'s", "<|endoftext|>", " ", "日本"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [reference.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("run", [" " * 5_000_000, "\n" * 1_500_000, " \n\t" * 500_000, "x" * 1_000_000, "!?" * 300_000, "1234567" * 100_000])
def test_long_runs_encode_and_count_as_in_the_library(run):
    import numpy as np
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    text = "a" + run + "b c"
    assert np.frombuffer(packing.ChunkEncoder(path)([text])[0], "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    path = tokenizer("word_bpe_49k.json")
    merger = token_counts.WordMerger(path)
    assert sum(merger.count_chunks(text.encode().split())) == len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)


def test_long_words_merge_as_short_ones():
    import random

    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    reference, merger, rng = Tokenizer.from_file(path), token_counts.WordMerger(path), random.Random(6)
    words = ["".join(rng.choices(rng.choice(["ab", "abc", "theaing", "é日a", "=-"]), k=rng.randint(1, 2000))) for _ in range(150)]
    assert merger.count_chunks([w.encode() for w in words]) == [len(reference.encode(w, add_special_tokens=False).ids) for w in words]


def test_every_character_counts_as_in_the_library():
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    reference, merger = Tokenizer.from_file(path), token_counts.WordMerger(path)
    texts = [form.replace("?", chr(c)) for c in [*range(0x80, 0xD800, 3), *range(0xA7C0, 0xA7E0), *range(0x10D40, 0x10D90), *range(0x13430, 0x14600, 2)] for form in ("a?b", "=?=") if not chr(c).isspace()]
    texts = [t for t in texts if len(t.split()) == 1]
    assert merger.count_chunks([t.encode() for t in texts]) == [len(x.ids) for x in reference.encode_batch(texts, add_special_tokens=False)]


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    reference = Tokenizer.from_file(path)
    got = token_counts.count_tokens(docs, path).collect()
    n = lambda t: len(reference.encode(t or "", add_special_tokens=False).ids)
    assert Counter(map(tuple, got)) == Counter((i, len((t or "").encode()), n(t), n(t) > 2048) for i, t, *_ in ROWS)
    assert token_counts.count_tokens(none, path).count() == 0


def test_odd_texts_count_as_the_library_counts():
    import random

    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    reference, merger, rng = Tokenizer.from_file(path), token_counts.WordMerger(path), random.Random(3)
    texts = ["aaaa aaaaaaa", "Straße İstanbul ΣΑΣ x y\x1cz  it's 12345 ''' don'T", "==" * 500, "日本語 テスト", "<|ENDOFTEXT|> <|endoftext|>a<|startoftext|>", "éa"]
    texts += ["".join(rng.choice(["a", "bc", " ", "É", "1", "!", "'s", "<|endoftext|>", "ß", "́"]) for _ in range(30)) for _ in range(300)]
    for t in texts:
        chunks = t.encode().split()
        assert (sum(merger.count_chunks(chunks)) if chunks else 0) == len(reference.encode(t, add_special_tokens=False).ids), t


def test_near_duplicates(docs, none):
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None}
    assert by[1] == (3, 1, True) and by[2] == (3, 1, False) and by[3] == (0, 3, True) and by[4] == (0, 4, True) and by[5] == (0, 5, True)
    assert by[6] == (2, 6, True) and by[7] == (1, 7, True) and by[8] == (1, 7, False)
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert near_dedup.near_duplicates(none).count() == 0
    kept = near_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter({1: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, None: 2})


def test_one_row_of_a_kept_id_and_text_stays(spark):
    text = "uno due tre quattro cinque sei sette"
    rows = [(1, text), (1, text), (2, text), (3, "altro testo"), (4, None), (4, None), (None, text), (None, text)]
    docs = spark.createDataFrame([(i, t, "it", "a", 1) for i, t in rows], DOCS).withColumns({c: F.lit("x") for c in CLASH}).repartition(3)
    kept = near_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter({(1, text): 1, (3, "altro testo"): 1, (4, None): 1, (None, text): 2})


def sets_of(texts):
    out = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        out[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    return out


def test_groups_of_near_copies_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    texts = {}
    for g in range(6):  # copies that are edited lightly, or so much that only some are linked
        base = rng.choices(words, k=rng.choice([40, 120, 400]))
        for _ in range(60):
            t = list(base)
            for _ in range(rng.randint(0, len(t) // 18)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts[len(texts)] = " ".join(t)
    s = sets_of(texts)
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in range(a):
            both = len(s[a] & s[b])
            if 100 * both >= 75 * (len(s[a]) + len(s[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(s[i]), find(i), find(i) == i) for i in texts}


def test_higher_limits_and_refused_ones(spark):
    import random

    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    texts = {}
    for _ in range(40):
        base = rng.choices(words, k=60)
        for _ in range(6):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts[len(texts)] = " ".join(t)
    df, s = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), sets_of(texts)
    least = {i: i for i in texts}
    for _ in range(6):
        for a in texts:
            for b in texts:
                both = len(s[a] & s[b])
                if both and 100 * both >= 90 * (len(s[a]) + len(s[b]) - both):
                    least[a] = least[b] = min(least[a], least[b])
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, 90).collect()} == least
    with pytest.raises(ValueError):
        near_dedup.near_duplicates(df, 60)


def test_estimates_and_block_links():
    import numpy as np

    rng = np.random.default_rng(5)
    base = np.unique(near_dedup.stir(rng.integers(0, 1 << 62, 4000).astype("u8")))
    pairs = [(base[:3000], base[k : 3000 + k]) for k in (0, 200, 500, 1000)]
    for a, b in pairs:
        regs = near_dedup.registers(np.concatenate([a, b]), np.array([0, len(a)]))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(near_dedup.estimate(np.array([(regs[0] == regs[1]).mean()]), np.array([3000.0]), np.array([3000.0]))[0] - j) < 0.17
    sets = [np.sort(x) for x in (base[:100], base[10:105], base[2000:2100], base[50:160])]
    at = np.arange(4)
    assert near_dedup.links_between(sets, at, at, at, 75) == [(0, 1)]


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 0), (6, 0, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels).collect()
    assert len(got) == len(ROWS) and not any(r.kept and r.base_failed for r in got)
    six = next(r for r in got if r.doc_id == 6)
    assert (six.n_words, six.n_repeat_words, six.base_failed) == (60_000, 60_000, True)
    assert quality.judge(none, labels).count() == 0 and quality.judge(docs, labels.limit(0)).count() == len(ROWS)
    assert quality.accepted(docs, labels).columns == docs.columns


@pytest.mark.parametrize("text", ["", "a", "a b a b a b", "x # y $$\nx # y $$\n\n  \n  \nq", "one two three one two three four one two three", "é ñ | < >\n\té", "same\nsame\nsame \n same"])
def test_rule_statistics(text):
    words = text.split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.split()]
    want = (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
    assert quality.statistics(text.encode())[:5] == want


def test_forest_tells_junk_from_prose():
    import numpy as np

    rng = np.random.default_rng(1)
    good, bad = rng.normal(0, 1, (900, 5)), rng.normal(0, 1, (60, 5)) + rng.choice([-8, 8], (60, 5))
    x = np.concatenate([good, bad])
    forest = quality.Forest(x)
    score, label = forest.score(x), np.arange(960) < 900
    cut = quality.calibrated(score, label)
    assert (score[label] <= cut).mean() >= quality.KEEP and (score[~label] > cut).mean() > 0.9
    assert quality.calibrated(score[label], label[label]) == float("inf") and (quality.Forest(x).score(x) == score).all()


def test_forest_scores_are_mean_path_lengths():
    import math

    import numpy as np

    rng = np.random.default_rng(2)
    rows = np.concatenate([rng.normal(size=(400, 4)), np.full((30, 4), 0.5)])
    forest = quality.Forest(rows, 25, 64)
    mean = lambda n: 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    for row, score in list(zip(rows, forest.score(rows)))[::37]:
        lengths = []
        for rule, value, left, right, length in forest.trees:
            at = steps = 0
            while left[at] != at:
                at = left[at] if row[rule[at]] <= value[at] else right[at]
                steps += 1
            assert steps <= length[at] <= steps + mean(64)  # the steps, and what the rows left in the leaf would take
            lengths.append(length[at])
        assert score == pytest.approx(2 ** (-np.mean(lengths) / mean(64)))
    assert len(set(forest.score(rows)[-30:])) == 1


@pytest.mark.parametrize(("sf", "good_kept"), [("sf0.01", 0.97), ("sf0.1", 0.98)])
def test_labelled_junk_is_rejected(spark, sf, good_kept):
    at = f"/root/testdata/{sf}"
    labels = spark.read.parquet(f"{at}/labels.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = quality.judge(docs, labels).where(f"n_words >= {quality.LEAST_WORDS}").join(labels, "doc_id").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert sum(good) >= good_kept * len(good) and sum(bad) <= 0.002 * len(bad)


def test_accepted_goes_by_each_row(spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    given = spark.read.parquet(f"{small}/documents.parquet")
    rows = given.collect()
    kept = {r.doc_id for r in quality.judge(given, labels).collect() if r.kept}
    clean = next(r.text for r in rows if r.doc_id in kept)
    more = spark.createDataFrame([(None, clean, "it", "a", 1), (None, "x " * 99, "it", "a", 1), (-1, clean, "it", "a", 1), (-1, "x " * 99, "it", "a", 1), (None, None, None, None, None)], DOCS)
    docs = given.select(more.columns).union(more).withColumns({c: F.lit("x") for c in CLASH})
    got = Counter((r.doc_id, r.text) for r in quality.accepted(docs, labels).collect())
    assert got == Counter([(r.doc_id, r.text) for r in rows if r.doc_id in kept] + [(None, clean), (-1, clean)])
    assert quality.accepted(docs.limit(0), labels).count() == 0


def test_cut_lies_between_the_labels():
    import numpy as np

    score, good = np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]), np.array([1, 1, 1, 1, 0, 0, 1], bool)
    assert quality.calibrated(score, good) == pytest.approx(0.45)


def test_every_labelled_row_sets_the_forest_and_the_cut(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    n = 24_000
    x = np.round(rng.normal(size=(n, len(quality.RULES))), 1)
    good = x[:, 0] + rng.normal(size=n) < 1.2
    base = [c for c in quality.BASE if c != "n_words"]
    stats = spark.createDataFrame([(k, 60, *[0] * len(base), *map(float, row)) for k, row in enumerate(x)], ", ".join(["doc_id long, n_words long", *(f"{c} long" for c in base), *(f"{c} double" for c in quality.RULES)]))
    labels = spark.createDataFrame([(k, int(g)) for k, g in enumerate(good)], "doc_id long, quality int")
    chosen = quality.labelled(labels)
    assert chosen.count() == n
    forest, threshold = quality.fit(stats, chosen)
    assert len(forest.trees) == quality.TREES and threshold == quality.calibrated(forest.score(x), good)
    rows = spark.createDataFrame([(int(h), *map(float, row)) for h, row in zip(rng.integers(-(2**63), 2**63, n), x)], ", ".join(["place long", *(f"{c} double" for c in quality.RULES)]))
    drawn = Counter(r.tree for r in quality.drawn(rows, n).collect())
    assert len(drawn) == quality.TREES and min(drawn.values()) > quality.TREE_ROWS and max(drawn.values()) < 3 * quality.TREE_ROWS


def test_cut_of_counted_scores_is_that_of_all_scores(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 300):
        for kinds in ([True], [False], [True, False]):
            score, good = rng.integers(0, 40, n) / 64, rng.choice(kinds, n)
            scored = spark.createDataFrame([(float(s), bool(g)) for s, g in zip(score, good)], "score double, good boolean")
            assert quality.cut(scored) == quality.calibrated(score, good)


def test_lm_scoring(spark, docs, none):
    got = lm_scoring.score(docs).collect()
    assert len(got) == len(ROWS)
    joined = lm_scoring.score(docs, model_cells=0, heavy_words=3).collect()
    key = lambda r: (str(r.doc_id), r.n_tokens, round(r.score, 3))
    for a, b in zip(sorted(got, key=key), sorted(joined, key=key)):
        assert tuple(a)[:5] == tuple(b)[:5] and abs(a.base_score - b.base_score) < 1e-6 and abs(a.score - b.score) < 1e-2 + 1e-5 * abs(a.score)
    learn = [(t or "").encode().lower() for i, t, *_ in ROWS if not lm_scoring.held_out(i)]
    assert {r.train_tokens for r in got} == {sum(len(t.split()) + 1 for t in learn)}
    assert lm_scoring.score(none).count() == 0


def plain_scores(rows, depth):
    """{place: (held_out, n_tokens, n_known, base_score, score, n_bytes)} from the definitions, a text, a byte, a bit, a node at a time."""
    import math

    texts = [(t or "").encode() for _, t in rows]
    out = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in rows]
    lower = [bytes(c + 32 if 65 <= c <= 90 else c for c in t) for t in texts]
    count = Counter()
    for t, o in zip(lower, out):
        if not o:
            count.update([*t.split(), None])
    tokens, distinct = sum(count.values()), len(count)
    node: dict = {}
    below: dict = {}
    for t, o in zip(lower, out):
        p = b"\xff" * depth + t + b"\xff"
        for i in range(depth, len(p) if not o else 0):
            for b in range(8):
                prefix, bit = 1 << b | p[i] >> (8 - b), p[i] >> (7 - b) & 1
                for d in range(depth + 1):
                    context = p[i - d : i]
                    node.setdefault((context, prefix), [0, 0])[bit] += 1
                    if d:
                        below.setdefault((context[1:], prefix), set()).add(context)

    def estimate(zeros, ones):
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(zeros + ones + 1)

    known: dict = {}

    def weighted(context, prefix):
        if (context, prefix) not in known:
            e = estimate(*node[context, prefix])
            if len(context) < depth:
                w = sum(weighted(c, prefix) for c in below[context, prefix])
                m = max(e, w)
                known[context, prefix] = m + math.log(0.5 * math.exp(e - m) + 0.5 * math.exp(w - m))
            else:
                known[context, prefix] = e
        return known[context, prefix]

    def predicted(context, prefix, bit):
        p = None
        for d in range(depth, -1, -1):
            short = context[len(context) - d :]
            if (short, prefix) in node:
                n = node[short, prefix]
                own = (n[bit] + 0.5) / (sum(n) + 1)
                if p is None:
                    p = own
                else:
                    share = 0.5 * math.exp(estimate(*n) - weighted(short, prefix))
                    p = share * own + (1 - share) * p
        return 0.5 if p is None else p

    found = {}
    for k, (t, o) in enumerate(zip(lower, out)):
        words = [*t.split(), None]
        p = b"\xff" * depth + t + b"\xff"
        score = sum(math.log10(predicted(p[i - depth : i], 1 << b | p[i] >> (8 - b), p[i] >> (7 - b) & 1)) for i in range(depth, len(p)) for b in range(8))
        found[k] = (o, len(words), sum(w in count for w in words), sum(math.log10((count[w] + 0.1) / (tokens + 0.1 * (distinct + 1))) for w in words), score, len(t) + 1)
    return tokens, found


@pytest.mark.parametrize(("model_cells", "deal_cells"), [(10**6, 10**5), (0, 3)])
def test_scores_against_the_definitions(spark, monkeypatch, model_cells, deal_cells):
    import random

    rng = random.Random(9)
    words = ["the", "then", "A", "banana", "é", "Band", "xyz", "can", "an"]
    rows = [(i, rng.choice(["\t", " "]).join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(60)] + [(7, None), (None, "the the"), (None, ""), (3, "the band\nthe band"), (21, "unseen words ZZ qq")]
    monkeypatch.setattr(lm_scoring.model, "__defaults__", (lm_scoring.DEPTH, deal_cells))
    tokens, want = plain_scores(rows, lm_scoring.DEPTH)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lm_scoring.score(df, model_cells=model_cells, heavy_words=3 if model_cells == 0 else 10**6).collect()
    assert {r.train_tokens for r in got} == {tokens} and len(got) == len(rows)
    key = lambda r: (str(r[0]), r[1:4], round(r[4], 3), round(r[5], 2))
    have = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score, r.score, r.n_bytes) for r in got), key=key)
    plain = sorted(((i, *want[k]) for k, (i, _) in enumerate(rows)), key=key)
    for a, b in zip(have, plain):
        assert a[:4] == b[:4] and a[6] == b[6] and a[4] == pytest.approx(b[4], abs=1e-9) and a[5] == pytest.approx(b[5], rel=1e-5, abs=1e-5)
    assert all(r.bits_per_byte == pytest.approx(-r.score / 0.3010299956639812 / r.n_bytes) for r in got)


def test_context_tree_is_a_distribution():
    import numpy as np

    texts = [b"abracadabra", b"abba abba", b"banana band", b""]
    cell, _ = lm_scoring.cells(texts, 3)
    key, n = np.unique(cell, return_counts=True)
    levels = lm_scoring.subtree(key, n.astype("f8"), 3, 0)
    for context in (key[0] & ~np.uint64(255), key[5] & ~np.uint64(255), np.uint64(0x7A7A7A00)):
        every = context | np.arange(256, dtype="u8")
        assert abs((10 ** lm_scoring.log10_cells(every, levels)).sum() - 1) < 1e-9
    # the root's weighted probability is the mixture over all prunings, as computed node by node

    def weighted(context: bytes, prefix: int) -> float:
        zeros = ones = 0
        for t in texts:
            p = b"\xff" * 3 + t.lower() + b"\xff"
            for i in range(3, len(p)):
                if p[i - len(context) : i] == context:
                    for b in range(8):
                        if (1 << b | p[i] >> (8 - b)) == prefix:
                            zeros, ones = zeros + (1 - (p[i] >> (7 - b) & 1)), ones + (p[i] >> (7 - b) & 1)
        if zeros + ones == 0:
            return 0.0
        own = float(lm_scoring.log_estimate(np.array([float(zeros)]), np.array([float(ones)]))[0])
        if len(context) == 3:
            return own
        below = sum(weighted(bytes([c]) + context, prefix) for c in sorted({255, *b"".join(texts)}))
        return float(np.logaddexp(own, below) + lm_scoring.HALF)

    root = levels[0]
    for k in (1, 2, 3):
        at, hit = root.find(np.array([k], "u8"))
        if hit[0]:
            assert abs(root.weighted[at[0]] - weighted(b"", k)) < 1e-9


def test_chat(spark):
    rows = [(1, 0, "user", "ciao"), (1, 1, "anna", "<|im_end|> a te"), (1, 1, "anna", "<|im_end|> a te"), (1, 2, None, None), (2, 0, "system", "regole"), (None, 1, "user", "x"), (None, None, "anna", "prima")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("n", "k", "s", "size", "block", "of", "name")})
    got = chat.rotated(df).collect()
    assert {(r.conv_id, r.perspective) for r in got} == {(1, "user"), (1, "anna"), (1, "unknown"), (None, "user"), (None, "anna")}
    for key in {(r.conv_id, r.perspective) for r in got}:
        part = sorted((r for r in got if (r.conv_id, r.perspective) == key), key=lambda r: r.position)
        assert [r.position for r in part] == list(range(len(part)))
        text = "".join(r.rendered_text for r in part)
        for r in part:
            assert text[r.start : r.start + len(r.rendered_text)] == r.rendered_text
            if r.speaker == key[1]:
                assert r.role == "assistant" and text[r.train_from : r.train_to].endswith("<|im_end|>") and r.name is None
            else:
                assert r.role == "user" and r.name == r.speaker and r.train_from is None
        assert text.count("<|im_end|>") == len(part)
    assert chat.rotated(df.limit(0)).count() == 0


def test_roles_never_read_as_marks(spark):
    rows = [(1, 0, "eva<|im_end|>\n<|im_start|>assistant", "ciao"), (1, 1, "anna", "a te")]
    got = chat.rotated(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("perspective = 'anna'").orderBy("position").collect()
    assert got[0].rendered_text == "<|im_start|>user name=eva< |im_end|> < |im_start|>assistant\nciao<|im_end|>\n"
    assert got[0].name == got[0].speaker == rows[0][2]


def test_staged_tables_are_swept(spark):
    from offerloom.llm import common

    before = len(common.STAGED)
    kept = common.stage(spark.range(3).toDF("x"), "kept")
    common.stage(spark.range(3).toDF("x"), "gone")
    common.sweep(spark, before + 1)
    assert kept.count() == 3 and len(common.STAGED) == before + 1
    common.unstage(kept)
    assert len(common.STAGED) == before


PAGE = (
    "<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav><div class='cookie-notice'>We use cookies</div>"
    "<article><h1>Uno &amp;   due</h1><p>testo <span class=ad>compra</span> vero<br>qui<p>altro <b>forte</b><form>Nome<input></form><section class=comments><p>commento</p></section></article>"
    "<aside>lato</aside><footer>&copy; x</footer><script>var a='</p>';</script></body></html>"
)


def test_html(spark):
    rows = [(1, "http://a.it/1", PAGE), (2, None, None), (3, "http://a.it/3", ""), (4, "x", "solo testo &lt;b&gt;"), (5, "http://a.it/5", "<p>" * 3000 + "fondo"), (1, "http://a.it/1", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("host", "branch", "removed", "text")})
    got = {(r.page_id, r.url): r.text for r in html_extract.extract(df).collect()}
    assert got[1, "http://a.it/1"] == "Uno & due\n\ntesto vero qui\n\naltro forte" and got[2, None] == got[3, "http://a.it/3"] == "" and got[4, "x"] == "solo testo <b>" and got[5, "http://a.it/5"] == "fondo"
    assert html_extract.extract(df).where("n_chars <> length(text)").count() == 0 and html_extract.extract(df.limit(0)).count() == 0


def test_style_tree_removes_what_all_pages_of_a_host_repeat(spark):
    pages = [(i, f"http://a.it/{i}", f"<body><div class=top>Benvenuti nel sito della ditta</div><div class=body><p>{' '.join(f'w{i}x{k}' for k in range(30))}</p></div></body>") for i in range(20)]
    got = html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert all(r.text == " ".join(f"w{r.page_id}x{k}" for k in range(30)) for r in got)
    copies = [(i, f"http://b.it/{i}", "<body><article><p>sempre lo stesso articolo</p></article></body>") for i in range(20)]
    assert all(r.text == "sempre lo stesso articolo" for r in html_extract.extract(spark.createDataFrame(copies, "page_id long, url string, html string")).collect())
