"""Cross-tokenizer alignment against the libraries' ids and all overlapping ranges."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from offerloom.llm import alignment as L
from offerloom.llm.queries import tokenizer

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
BITS = [" ", "  ", "\n", " \n", "\t", "a", "ab", "the", "é", "ß", "ñ", "▁", "<s>", "<|endoftext|>", "<0x0A>", "<unk>", "'s", "'ll", "1", "23", "...", "$", "###", "日本", "𝒳", "é", " ", "　", "\x00", "\r", "İ", "ﬁ", "½", "–"]
SCHEMA = "doc_id long, text string, lang string, row string"


@pytest.fixture(scope="module")
def plain():
    """(n_a, n_b, n_groups, groups, links) of a text by the libraries, every A token held against every B token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model, known = Tokenizer.from_file(tokenizer(A)), sentencepiece.SentencePieceProcessor(model_file=tokenizer(B)), L.Aligner(tokenizer(A), tokenizer(B))
    a_model.encode_special_tokens = True

    def align(text):
        raw = (" " + (text or "")).encode()
        a, b = a_model.encode(" " + (text or ""), add_special_tokens=False).ids, b_model.encode(text or "")
        parts_a, parts_b = [known.a.bytes[i] for i in a], [known.b.bytes[i] for i in b]
        if not text or b"".join(parts_a) != raw or b"".join(parts_b) != raw:
            return None
        ends_a, ends_b = np.cumsum([len(x) for x in parts_a]), np.cumsum([len(x) for x in parts_b])
        begin_a, begin_b = ends_a - [len(x) for x in parts_a], ends_b - [len(x) for x in parts_b]
        links = [(x, y) for x, s, e in zip(a, begin_a, ends_a) for y, t, f in zip(b, begin_b, ends_b) if s < f and t < e]
        groups, last = [], 0
        for cut in sorted({*ends_a} & {*ends_b}):
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, ends) if last < e <= cut) for ids, ends in ((a, ends_a), (b, ends_b))))
            last = cut
        return len(a), len(b), len(groups), ";".join(groups), links

    return align


def rows(texts, align):
    found = [align(t) for t in texts]
    count = Counter(x for f in found if f for x in f[4])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(n, best.get(b, 0))
    for f in found:
        if f is None:
            yield 0, 0, 0, 0, 0, 0, ""
        else:
            yield f[0], f[1], f[2], len(f[4]), sum(count[x] == best[x[1]] for x in f[4]), sum(count[x] for x in f[4]), hashlib.sha256(f[3].encode()).hexdigest()


def given(spark, texts):
    return spark.createDataFrame([(k if k % 7 else None, t, "en", "own") for k, t in enumerate(texts)], SCHEMA)


def results(df):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def wanted(texts, align):
    return Counter((k if k % 7 else None, *r) for k, r in enumerate(rows(texts, align)))


def test_chunks_align_as_whole_texts_do(plain):
    rng = random.Random(5)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randrange(14))) for _ in range(3000)] + [" ", "a", " a ", "  ", "\n ", None, ""]
    aligner = L.Aligner(tokenizer(A), tokenizer(B))
    for at in range(0, len(texts), 64):
        for text, got in zip(texts[at : at + 64], aligner(texts[at : at + 64])):
            want = plain(text)
            assert (got is None) == (want is None), text
            if want:
                links = [(int(x) & (1 << L.BITS) - 1, int(x) >> L.BITS) for x in np.frombuffer(got[4], "i8")]
                assert (*got[:3], got[3].decode(), links) == want, text


def test_texts_that_end_and_begin_with_white_space(spark, plain):
    rng = random.Random(9)
    texts = ["a ", " b", "a  ", "  b", "c\n", " \n d", "\n", " ", "   ", "\t ", " e\t"] + ["".join(rng.choice([" ", "  ", "a", "\n", "b"]) for _ in range(rng.randrange(9))) for _ in range(400)]
    assert results(L.align(given(spark, texts), tokenizer(A), tokenizer(B))) == wanted(texts, plain)


def test_documents_with_hot_sides_in_several_cells(spark, plain):
    rng = random.Random(8)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randrange(20))) for _ in range(150)] + ["the same text, twice"] * 2 + [None, "", "the the the " * 40]
    df = given(spark, texts)
    for least in (7, L.LEAST_CELL):
        assert results(L.align(df, tokenizer(A), tokenizer(B), least_cell=least)) == wanted(texts, plain)


def test_long_runs_and_the_groups_themselves(spark, plain):
    texts = ["x" * 50_000, "a b " * 9000, " " * 3000 + "end", "é\n" * 500]
    found = {r.doc_id: r for r in L.aligned(given(spark, ["", *texts]), tokenizer(A), tokenizer(B)).collect()}
    for k, t in enumerate(texts, 1):
        if len(t) < 5000:
            assert (found[k].n_a, found[k].n_b, found[k].n_groups, found[k].groups) == plain(t)[:4]
        assert found[k].groups.count(";") + 1 == found[k].n_groups


def test_empty_table(spark):
    assert L.align(given(spark, []), tokenizer(A), tokenizer(B)).collect() == []


def test_sides_that_go_on_in_further_batches():
    key = np.array([5 << L.BITS | 1] * 3 + [5 << L.BITS | 2] * 2 + [6 << L.BITS | 1])
    row, n_best, count_sum = L.added_up(key, np.array([1, 2, -1, 1, 3, 1]), np.array([1, 2, 8, 4, 5, 7]))
    assert (row.tolist(), n_best.tolist(), count_sum.tolist()) == ([1, 2, 1, 3, 1], [0, 0, 4, 5, 7], [8, 16, 36, 45, 49])


def test_given_table(spark, plain, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("length(text) < 1500")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want = Counter((i, *r) for (i, _), r in zip(texts, rows([t for _, t in texts], plain)))
    assert results(L.align(docs, tokenizer(A), tokenizer(B))) == want
