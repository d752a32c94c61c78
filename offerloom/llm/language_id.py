"""Language of texts by a linear-chain conditional random field over their words.

Each word has a score per language from its features: prefixes and suffixes of up to four letters,
letter n-grams with marks at the word's ends, and how a lexicon of the training words spreads over the languages. Learned
transitions join neighbouring words, so that a text that switches its language is cut
where the evidence turns, and not at every odd word. Forward-backward gives each word
the probability of each language; a text goes by their sum over its words.

Training. At most ``PER_LANGUAGE`` labelled documents of each language, chosen by a hash of their id, give runs of
at most ``RUN`` words each (a run that begins anywhere in the text). Half of them make the lexicon. The
others are cut into spans of random length, which are dealt into sequences of ``STEPS`` words that switch
languages where spans meet: from those weights and transitions are learned, by full gradients
with a fixed number of steps. So the model's size and the cost of its fit are bounded, and reruns agree.

Labelling. A worker keeps the scores of the distinct words it has met. Texts are laid out in blocks of ``BLOCK``
words. Transfer matrices of the blocks are multiplied word by word, all blocks at once; a
short pass over the blocks of each text hands forward and backward vectors from block to
block; a second pass gives the words' probabilities. Only a slab of blocks is unfolded
at a time, so a text of any length is labelled whole in bounded memory.

Cases: a null text, or one without a letter, is ``und`` with a score of 0, and so is every text if no row can be
learned from. Rows without an id are labelled, but never learned from nor held out. Rows without a language are labelled and never
learned from. Texts that share an id are labelled each. Equal sums go to the language that is first in the alphabet. An
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_enough, stage

#: Labelled documents of a language, and words of each, that the model is fitted on at most; languages at most, by number of documents.
PER_LANGUAGE = 600
RUN = 150
LANGUAGES = 200
#: Words of a training sequence, and the mean length of the spans of one language in it.
STEPS = 40
SPAN = 12
ITERATIONS = 60
RATE = 0.3
RIDGE = 1e-4
#: Features are hashed to so many places.
PLACES = 1 << 16
SEED = 3

BLOCK = 64
SLAB = 4096
#: Distinct words that a worker remembers before it starts afresh.
REMEMBER = 300_000
#: Words of a batch of texts, about.
BATCH_WORDS = 400_000

UNKNOWN = "und"
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"
SPANS = "doc_id long, span int, first_word long, words long, lang string"


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; rows of fold 1 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


class Words:
    """Words of texts: runs of letters and marks, lower case, each as a number; chunks without white space are cut once."""

    def __init__(self):
        import regex

        self.find = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall
        self.chunks: dict[str, bytes] = {}
        self.number: dict[str, int] = {}
        self.words: list[str] = []

    def _cut(self, chunk: str) -> bytes:
        out = []
        for w in self.find(chunk):
            w = w.lower()
            k = self.number.get(w)
            if k is None:
                k = self.number[w] = len(self.words)
                self.words.append(w)
            out.append(k)
        return np.array(out, "<i4").tobytes()

    def __call__(self, text: str | None) -> np.ndarray:
        chunks, parts = self.chunks, []
        for c in (text or "").split():
            found = chunks.get(c)
            if found is None:
                found = self._cut(c)
                if len(c) < 100:
                    chunks[c] = found
            parts.append(found)
        return np.frombuffer(b"".join(parts), "<i4")

    def full(self) -> bool:
        return len(self.chunks) > REMEMBER or len(self.words) > REMEMBER


#: Fixed odd factors that mix a window's letters and its kind.
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
#: Kinds of features: n-grams by their length, prefixes, suffixes, lexicon verdicts.
GRAM, PREFIX, SUFFIX, LEXICON = 0, 8, 16, 24


def hashed(letters: list[np.ndarray], kind: int) -> np.ndarray:
    """Places of windows, given as their first, second, ... letters."""
    h = np.full(len(letters[0]), kind + len(letters), "u8") * MIX[3]
    for x in letters:
        h = (h ^ x) * MIX[0]
        h ^= h >> np.uint64(29)
    return ((h * MIX[1]) >> np.uint64(64 - 16)).astype("i8") % PLACES


def features(words: list[str], lexicon: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(word, place) of all features of words: affixes, n-grams with end marks, the lexicon's verdicts; all words at once."""
    codes = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    length = np.fromiter(map(len, words), "i8", len(words))
    end = np.cumsum(length + 2)
    begin = end - length - 2
    every = np.arange(len(words))
    of, at = [every], [np.zeros(len(words), "i8")]  # the bias
    word, left = np.repeat(every, length + 2), np.repeat(end, length + 2) - np.arange(len(codes))
    for n in (2, 3):
        i = np.flatnonzero(left >= n)
        of.append(word[i])
        at.append(hashed([codes[i + k] for k in range(n)], GRAM))
    for n in range(1, 5):
        i = np.flatnonzero(length >= n)
        for kind, first in ((PREFIX, begin[i] + 1), (SUFFIX, end[i] - 1 - n)):
            of.append(i)
            at.append(hashed([codes[first + k] for k in range(n)], kind))
    told = [lexicon.get(w, (-2,)) for w in words]
    of.append(np.repeat(every, list(map(len, told))))
    at.append(hashed([np.array([x + 2 for t in told for x in t], "u8")], LEXICON))
    return np.concatenate(of), np.concatenate(at)


class Model:
    """Languages, weights of features, transitions, and the lexicon with its verdicts for each word."""

    def __init__(self, languages: list[str], weights: np.ndarray, transitions: np.ndarray, lexicon: dict[str, tuple[int, ...]]):
        self.languages, self.weights, self.transitions, self.lexicon = languages, weights, transitions, lexicon

    def emissions(self, words: list[str]) -> np.ndarray:
        """A row of scores per word."""
        if not words:
            return np.zeros((0, len(self.languages)))
        of, place = features(words, self.lexicon)
        return np.stack([np.bincount(of, self.weights[place, k], len(words)) for k in range(len(self.languages))], 1)


def lexicon_of(runs: list[tuple[int, list[str]]], languages: int) -> dict[str, tuple[int, ...]]:
    """For words of two runs or more the languages that hold over a third of their rate, with the share in tenths."""
    held = [Counter() for _ in range(languages)]
    sizes = np.ones(languages)
    for lang, words in runs:
        held[lang].update(set(words))
        sizes[lang] += 1
    out = {}
    for w in set().union(*held):
        n = np.array([h[w] for h in held])
        if n.sum() >= 2:
            share = n / sizes
            share /= share.sum()
            out[w] = tuple(int(10 * k + min(9, int(10 * share[k]))) for k in np.flatnonzero(share > 1 / 3)) or (-1,)
    return out


def sequences(runs: list[tuple[int, list[str]]], rng: np.random.Generator) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, word numbers, labels): spans of the runs in random order, laid end to end and cut into rows of ``STEPS`` words."""
    spans = []
    for lang, words in runs:
        at = 0
        while at < len(words):
            n = int(rng.geometric(1 / SPAN))
            spans.append((lang, words[at : at + n]))
            at += n
    spans = [spans[k] for k in rng.permutation(len(spans))]
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for _, words in spans for w in words], "i8")
    label = np.repeat([s[0] for s in spans], [len(s[1]) for s in spans])
    rows = -(-len(ids) // STEPS)
    pad = np.arange(rows * STEPS) % max(len(ids), 1)  # the last row is filled from the first
    return list(number), ids[pad].reshape(rows, STEPS), label[pad].reshape(rows, STEPS)


def expected(scores: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word probabilities (rows, steps, languages) and expected transitions of sequences of equal length."""
    rows, steps, n = scores.shape
    e = np.exp(scores - scores.max(2, keepdims=True))
    t = np.exp(transitions - transitions.max())
    ahead, back = np.empty_like(e), np.ones_like(e)
    ahead[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for k in range(1, steps):
        x = ahead[:, k - 1] @ t * e[:, k]
        ahead[:, k] = x / x.sum(1, keepdims=True)
    moves = np.zeros((n, n))
    for k in range(steps - 1, 0, -1):
        x = back[:, k] * e[:, k]
        pair = ahead[:, k - 1, :, None] * t * x[:, None, :]
        moves += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        y = x @ t.T
        back[:, k - 1] = y / y.sum(1, keepdims=True)
    p = ahead * back
    return p / p.sum(2, keepdims=True), moves


def fit(runs: list[tuple[str, list[str]]]) -> Model | None:
    """The model of labelled runs of words, the same for the same runs; None without any."""
    languages = sorted({lang for lang, words in runs if words})
    if not languages:
        return None
    index = {lang: k for k, lang in enumerate(languages)}
    coded = [(index[lang], words) for lang, words in runs if words]
    lexicon = lexicon_of(coded[::2], len(languages))
    words, ids, labels = sequences(coded[1::2] or coded, np.random.default_rng(SEED))
    n = len(languages)
    of, place = features(words, lexicon)
    weights, moves = np.zeros((PLACES, n)), np.zeros((n, n))
    flat = ids.ravel()
    seen = np.zeros((len(words), n))
    np.add.at(seen, (flat, labels.ravel()), 1)
    switched = np.zeros((n, n))
    np.add.at(switched, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), 1)
    past_w, past_m = np.full((PLACES, n), 1e-8), np.full((n, n), 1e-8)
    for _ in range(ITERATIONS):
        scores = np.stack([np.bincount(of, weights[place, k], len(words)) for k in range(n)], 1)
        p, went = expected(scores[ids], moves)
        p = p.reshape(-1, n)
        gap = seen - np.stack([np.bincount(flat, p[:, k], len(words)) for k in range(n)], 1)
        up_w = np.stack([np.bincount(place, gap[of, k], PLACES) for k in range(n)], 1) / len(flat) - RIDGE * weights
        up_m = (switched - went) / len(flat) - RIDGE * moves
        past_w += up_w**2
        past_m += up_m**2
        weights += RATE * up_w / np.sqrt(past_w)
        moves += RATE * up_m / np.sqrt(past_m)
    return Model(languages, weights.astype("f4"), moves, lexicon)


def training_runs(docs: DataFrame, per_language: int = PER_LANGUAGE, run: int = RUN, languages: int = LANGUAGES) -> list[tuple[str, list[str]]]:
    """(language, words) of the chosen documents, in a fixed order.

    Ids are chosen first, from two narrow columns; only the texts of chosen ids are read.
    """
    known = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL").where(fold_of(F.col("doc_id")) != 1).select(F.col("doc_id").cast("long").alias("doc_id"), "lang")
    most = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language).drop("k").join(F.broadcast(most), "lang")  # ``languages`` rows
    chosen = stage(chosen, "training-ids")
    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").join(small_enough(chosen), ["doc_id", "lang"], "left_semi")
    # of texts that share an id and a language the one with the least hash
    texts = texts.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "lang").orderBy(F.xxhash64("text"), "text"))).where("k = 1").drop("k")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            words, rows = Words(), []
            for doc, lang, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ids = words(text)
                at = zlib.crc32(b"%d" % doc) % (len(ids) - run + 1) if len(ids) > run else 0
                rows.append((doc, lang, [words.words[k] for k in ids[at : at + run]]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.list_(pa.string())))], names=["doc_id", "lang", "words"])

    found = texts.mapInArrow(cut, "doc_id long, lang string, words array<string>").collect()  # bounded by per_language, languages and run
    return [(r.lang, list(r.words)) for r in sorted(found, key=lambda r: (zlib.crc32(b"%d" % r.doc_id), r.doc_id, r.lang))]


class Labeller:
    """Probabilities of the languages of the words of texts, by forward-backward over blocks."""

    def __init__(self, model: Model):
        self.model, self.words = model, Words()
        n = len(model.languages)
        self.scores, self.known = np.zeros((0, n), "f4"), 0
        self.t = np.exp(model.transitions - model.transitions.max()).astype("f4")

    def number(self, texts: list[str | None]) -> list[np.ndarray]:
        """The word numbers of texts, whose scores are known then."""
        if self.words.full():
            self.words, self.known = Words(), 0
        out = [self.words(t) for t in texts]
        if len(self.words.words) > self.known:
            x = self.model.emissions(self.words.words[self.known :])
            x = np.exp(x - x.max(1, keepdims=True)).astype("f4") + np.float32(1e-12)
            if len(self.scores) < len(self.words.words):
                grown = np.empty((2 * len(self.words.words), x.shape[1]), "f4")
                grown[: self.known] = self.scores[: self.known]
                self.scores = grown
            self.scores[self.known : self.known + len(x)] = x
            self.known += len(x)
        return out

    def probabilities(self, ids: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Slabs of (text, place, probabilities) of all words of texts, in order; texts without words have none."""
        t, n = self.t, len(self.t)
        length = np.array([len(x) for x in ids], "i8")
        blocks = -(-length // BLOCK)
        total = int(blocks.sum())
        if not total:
            return
        first = np.cumsum(blocks) - blocks
        flat, start = np.concatenate(ids), np.cumsum(length) - length
        text = np.repeat(np.arange(len(ids)), blocks)
        inside = np.arange(total) - first[text]
        begin = start[text] + BLOCK * inside
        size = np.minimum(BLOCK, length[text] - BLOCK * inside)

        def unfold(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
            """Scores and presence of the words of blocks a to b."""
            at = begin[a:b, None] + np.arange(BLOCK)
            there = np.arange(BLOCK) < size[a:b, None]
            e = self.scores[flat[np.minimum(at, len(flat) - 1)]]
            e[~there] = 1
            return e, there

        through = np.empty((total, n, n), "f4")
        for a in range(0, total, SLAB):
            b = min(a + SLAB, total)
            e, there = unfold(a, b)
            m = np.repeat(np.eye(n, dtype="f4")[None], b - a, 0)
            opens = inside[a:b] == 0
            for k in range(int(size[a:b].max())):
                moved = (m.reshape(-1, n) @ t).reshape(m.shape)
                if k == 0:
                    moved[opens] = m[opens]  # nothing comes before a text's first word
                moved *= e[:, k, None, :]
                moved /= moved.max((1, 2), keepdims=True)
                m = np.where(there[:, k, None, None], moved, m)
            through[a:b] = m
        into, after = np.empty((total, n), "f4"), np.empty((total, n), "f4")
        order = np.argsort(-blocks, kind="stable")
        many = np.searchsorted(-blocks[order], -np.arange(1, int(blocks.max()) + 1), "right")  # texts with as many blocks at least
        x = np.ones((len(ids), n), "f4")
        for j, count in enumerate(many):
            at = first[order[:count]] + j
            into[at] = x[:count]
            y = np.einsum("ij,ijk->ik", x[:count], through[at])
            x[:count] = y / y.max(1, keepdims=True)
        x = np.ones((len(ids), n), "f4")
        for j in range(len(many) - 1, -1, -1):
            at = first[order[: many[j]]] + j
            after[at] = x[: many[j]]
            y = np.einsum("ijk,ik->ij", through[at], x[: many[j]])
            x[: many[j]] = y / y.max(1, keepdims=True)
        for a in range(0, total, SLAB):
            b = min(a + SLAB, total)
            e, there = unfold(a, b)
            p, v, opens = np.empty_like(e), into[a:b].copy(), inside[a:b] == 0
            for k in range(BLOCK):
                moved = v @ t
                if k == 0:
                    moved[opens] = v[opens]
                moved *= e[:, k]
                moved /= moved.max(1, keepdims=True)
                v = np.where(there[:, k, None], moved, v)
                p[:, k] = v
            v = after[a:b].copy()
            for k in range(BLOCK - 1, -1, -1):
                p[:, k] *= v
                moved = (v * e[:, k]) @ t.T
                moved /= moved.max(1, keepdims=True)
                v = np.where(there[:, k, None], moved, v)
            p = p[there]
            of = np.repeat(np.arange(a, b), size[a:b])
            yield text[of], inside[of] * BLOCK + np.broadcast_to(np.arange(BLOCK), there.shape)[there], p / p.sum(1, keepdims=True)

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The summed probabilities of each text's words, and the number of its words."""
        ids = self.number(texts)
        out = np.zeros((len(texts), len(self.model.languages)))
        for text, _, p in self.probabilities(ids):
            for k in range(p.shape[1]):
                out[:, k] += np.bincount(text, p[:, k], len(texts))
        return out, np.array([len(x) for x in ids])

    def spans(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, str]]:
        """(text, first word, words, language) of the runs of words with the same likeliest language."""
        parts = [(text, place, p.argmax(1)) for text, place, p in self.probabilities(self.number(texts))]
        if not parts:
            return
        text, place, best = (np.concatenate(c) for c in zip(*parts))
        new = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(best, prepend=-1) != 0))
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(text)]):
            yield int(text[a]), int(place[a]), b - a, self.model.languages[best[a]]


def pieces(column: list, most_letters: int = 6 * BATCH_WORDS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about ``most_letters`` characters each."""
    a = size = 0
    for k, t in enumerate(column):
        size += len(t or "")
        if size >= most_letters:
            yield a, k + 1
            a, size = k + 1, 0
    if a < len(column):
        yield a, len(column)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every text."""
    import pyarrow as pa

    model = fit(training_runs(docs))
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: hashed weights and the lexicon of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = None
        for batch in batches:
            texts = batch.column(2).to_pylist()
            label = label or (Labeller(shipped.value) if shipped.value else None)
            best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for a, b in pieces(texts) if label else ():
                sums, words = label.sums(texts[a:b])
                for k in np.flatnonzero(words):
                    best[a + k] = label.model.languages[int(sums[k].argmax())]
                    score[a + k] = min(1.0, float(sums[k].max() / words[k]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(fold_of(F.col("doc_id")) == 1, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(run, RESULT)


def language_spans(docs: DataFrame) -> DataFrame:
    """doc_id, span (from 0), first_word, words, lang: the runs of words of one language in every text."""
    import pyarrow as pa

    shipped = docs.sparkSession.sparkContext.broadcast(fit(training_runs(docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            label = label or (Labeller(shipped.value) if shipped.value else None)
            for a, b in pieces(texts) if label else ():
                rows, last = [], None
                for text, first, words, lang in label.spans(texts[a:b]):
                    k = k + 1 if text == last else 0  # noqa: F821
                    last = text
                    rows.append((ids[a + text], k, first, words, lang))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "span", "first_word", "words", "lang"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SPANS)
