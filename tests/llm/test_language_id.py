"""Language identification: probabilities against sums over all labellings, accuracy on rows that are held out, defined cases."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest

from offerloom.llm import language_id as G
from offerloom.llm.queries import op11_linear_chain_crf

SCHEMA = "doc_id long, text string, lang string, source string, held_out int"


@pytest.fixture(scope="module")
def model(spark, small):
    return G.fit(G.training_runs(spark.read.parquet(f"{small}/documents.parquet")))


def plain(model, words):
    """Probabilities of the languages of words, one word after another."""
    e, t, n = model.emissions(words), model.transitions, len(model.languages)
    if len(words) <= 5:
        p = np.zeros((len(words), n))
        for path in itertools.product(range(n), repeat=len(words)):
            weight = np.exp(sum(e[k, x] for k, x in enumerate(path)) + sum(t[x, y] for x, y in zip(path, path[1:])))
            for k, x in enumerate(path):
                p[k, x] += weight
        return p / p.sum(1, keepdims=True)
    a, b = np.zeros_like(e), np.zeros_like(e)
    a[0] = e[0]
    for k in range(1, len(words)):
        a[k] = e[k] + np.logaddexp.reduce(a[k - 1][:, None] + t, 0)
    for k in range(len(words) - 2, -1, -1):
        b[k] = np.logaddexp.reduce(t + (e[k + 1] + b[k + 1])[None], 1)
    x = a + b
    p = np.exp(x - x.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def test_probabilities_of_short_and_long_texts(model):
    rng = np.random.default_rng(1)
    stock = "the of and der die und les dans pour que los el casa haus maison zzz ab".split()
    texts = [" ".join(rng.choice(stock, k)) for k in (1, 3, 5, 63, 64, 65, 128, 700)] + ["", None, "12 34"]
    label = G.Labeller(model)
    got = [np.zeros((0, len(model.languages)))] * len(texts)
    for text, place, p in label.probabilities(label.number(texts)):
        for k in range(len(texts)):
            assert (np.diff(place[text == k]) == 1).all()
            got[k] = np.concatenate((got[k], p[text == k]))
    for t, p in zip(texts, got):
        words = [w for w in (t or "").split() if w.isalpha()]
        assert len(words) == len(p)
        if words:
            assert np.abs(plain(model, words) - p).max() < 2e-3


def test_slabs_and_texts_do_not_matter(model, monkeypatch):
    texts = ["der Hund und die Katze " * 90, "the house of the rising sun", "la maison est dans la rue " * 40]
    whole = G.Labeller(model).sums(texts)[0]
    monkeypatch.setattr(G, "SLAB", 2)
    assert np.allclose(whole, np.concatenate([G.Labeller(model).sums([t])[0] for t in texts]), atol=1e-3)


def test_gradient_moves_are_expected_transitions():
    rng = np.random.default_rng(2)
    scores, t = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    _, moves = G.expected(scores, t)
    want = np.zeros((3, 3))
    for row in scores:
        total, add = 0.0, np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=4):
            w = np.exp(sum(row[k, x] for k, x in enumerate(path)) + sum(t[x, y] for x, y in zip(path, path[1:])))
            total += w
            for x, y in zip(path, path[1:]):
                add[x, y] += w
        want += add / total
    assert np.allclose(moves, want)


def test_held_out_accuracy_and_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = op11_linear_chain_crf(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_switched_text_is_cut_where_it_switches(model):
    text = "the of and to with this house is here for that. der die und nicht mit auf das ist ein und die der. le la les des pour dans une maison est le les"
    spans = [s[1:] for s in G.Labeller(model).spans([text])]
    assert [s[2] for s in spans] == ["en", "de", "fr"] and abs(spans[1][0] - 11) <= 2 and abs(spans[2][0] - 23) <= 2


def test_cases(spark):
    text = {"en": "the cat and the dog are in the house", "de": "der Hund und die Katze sind nicht im Haus"}
    held = [i for i in range(400) if zlib.crc32(b"%d" % i) % 3 == 1]
    rows = [(i, text["de" if i % 2 else "en"], "de" if i % 2 else "en", "s", 1) for i in range(400)]
    odd = [(None, text["de"], "xx", "s", 1), (1000, None, "en", "s", 1), (1001, "12 % --", "en", "s", 1), (1002, "", None, "s", 1), (1003, text["en"] * 900, None, None, None), (0, text["en"], "en", "s", 1), (held[0], text["en"], "only held out", "s", 1)]
    got = G.identify(spark.createDataFrame(rows + odd, SCHEMA))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == len(rows) + len(odd)
    of = {r.doc_id: r for r in got.collect()}
    assert all(of[i].lang_pred == ("de" if i % 2 else "en") for i in range(400) if i != held[0])
    assert {r.lang_pred for r in of.values()} == {"en", "de", "und"}
    assert all((of[i].lang_pred, of[i].score) == ("und", 0) for i in (1000, 1001, 1002))
    assert of[1003].lang_pred == "en" and of[None].lang_pred == "de" and of[None].held_out is False
    assert all(of[i].held_out for i in held)
    spans = {(r.doc_id, r.span): r for r in G.language_spans(spark.createDataFrame(rows[:50] + odd, SCHEMA)).collect()}
    assert spans[1003, 0].words == 9 * 900 - 899  # copies run into each other


def test_nothing_to_learn_from(spark):
    assert G.identify(spark.createDataFrame([], SCHEMA)).collect() == []
    (row,) = G.identify(spark.createDataFrame([(1, "a text", None, "s", 1)], SCHEMA)).collect()
    assert (row.lang_pred, row.score) == ("und", 0.0)


def test_the_fit_is_bounded_and_the_same_every_time(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    runs = G.training_runs(docs.union(docs), per_language=5, run=20)
    assert len(runs) <= 20 and all(len(w) <= 20 for _, w in runs)
    assert runs == G.training_runs(docs.repartition(3), per_language=5, run=20)
    a, b = G.fit(runs), G.fit(runs)
    assert (a.weights == b.weights).all() and (a.transitions == b.transitions).all()
