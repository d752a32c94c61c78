"""Quality rules: an isolation forest on rule statistics.

Every document is reduced to a row of rule statistics. A forest of random splits, grown
from all labelled rows, gives the expected path length of a row; rows that
few splits set apart are anomalous. The threshold on the anomaly score is calibrated on
every labelled row, from both labels: of all cuts, the one with the greatest sum of
the share of good rows kept and the share of bad rows rejected. Scores are counted by value
in ranges, so that no task and no driver holds them all.

Parameters: ``TREES`` trees, each on its own ``TREE_ROWS`` of all labelled rows, as the method has it: those with the least
hashes for the tree. Trees are grown in tasks. The forest is of fixed size and is shipped to the
executors; statistics, scores and verdicts cover every row.

Cases: a null text has no words; documents that fail the base rules are never kept; rows
without an id are judged and kept like others but never used as labelled rows; rows that
share an id are judged each, and those of a labelled id are labelled rows each, equal statistics once; several labels for one id use the least; without labelled rows of both kinds there is no threshold and the
base rules alone decide; texts of any length are measured whole; equal statistics have equal
scores, so ties fall on one side of the cut; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_enough, stage, utf8

TREES = 300
TREE_ROWS = 256
#: What is kept at least of good rows that lie well apart from the bad ones; it sets no cut.
KEEP = 0.995
SEED = 11

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("symbols_per_word", "bars_per_word", "marks_per_word", "upper_share", "digit_share", "repeat_share", "dup_line_share", "distinct_share", "top_word_share", "word_length", "words_per_line")
STATS = ", ".join(["doc_id long", *(f"{c} long" for c in BASE), *(f"{c} double" for c in RULES)])

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\v\f\r"
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = True


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """How many words lie in a 3-word window that the text holds twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    if distinct < 2_000_000:
        code = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
    else:
        pair = np.unique(ids[:-2] * distinct + ids[1:-1], return_inverse=True)[1]
        code = pair * distinct + ids[2:]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def statistics(raw: bytes) -> tuple:
    """The base statistics, then the rule statistics, of a text."""
    words = raw.split()
    n = len(words)
    codes = np.frombuffer(raw, "u1")
    points = int(((codes & 0xC0) != 0x80).sum())
    word_chars = points - sum(raw.count(w) for w in (WHITE[i : i + 1] for i in range(len(WHITE))))
    symbols = sum(raw.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    seen, dup, lines = set(), 0, 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
            lines += 1
        elif line and line.strip(WHITE):
            seen.add(line)
            lines += 1
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), "i8", n)
    repeat = repeated_words(ids, len(number))
    per = max(n, 1)
    letters = int(LETTER[codes].sum())
    top = int(np.bincount(ids).max()) if n else 0
    return (
        n, word_chars, symbols, dup, repeat,
        symbols / per, raw.count(b"|") / per, (raw.count(b"!") + raw.count(b"?")) / per,
        int(UPPER[codes].sum()) / max(letters, 1), sum(raw.count(b"%d" % d) for d in range(10)) / max(word_chars, 1),
        repeat / per, dup / max(lines, 1), len(number) / per, top / per, word_chars / per, float(np.log1p(n / max(lines, 1))),
    )


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, base and rule statistics of every document."""
    import pyarrow as pa

    names = ["doc_id", *BASE, *RULES]
    types = [pa.int64()] * (1 + len(BASE)) + [pa.float64()] * len(RULES)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = list(zip(*(statistics(t or b"") for t in utf8(part.column(1)))))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(rows, types[1:]))], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(measure, STATS)


class Forest:
    """Isolation trees as flat arrays: the split rule and value of each node, its children, the path length of a leaf."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        size = min(tree_rows, len(rows))
        self._measure(size)
        self.trees = [self._grow(rows[rng.choice(len(rows), size, replace=False)], rng) for _ in range(trees)]

    @classmethod
    def bare(cls, size: int) -> Forest:
        """A forest of trees of ``size`` rows, without trees yet."""
        forest = cls.__new__(cls)
        forest._measure(size)
        forest.trees = []
        return forest

    def _measure(self, size: int) -> None:
        self.depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
        self.scale = self.average(size)

    @staticmethod
    def average(n: int) -> float:
        """The mean path length of an unsuccessful search among n rows."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        rule, value, left, right, length = [], [], [], [], []

        def node(part: np.ndarray, depth: int) -> int:
            me = len(rule)
            for x, v in ((rule, 0), (value, 0.0), (left, me), (right, me), (length, depth + self.average(len(part)))):
                x.append(v)
            low, high = (part.min(0), part.max(0)) if len(part) else (np.zeros(0), np.zeros(0))
            open_ = np.flatnonzero(high > low)
            if len(part) > 1 and depth < self.depth and len(open_):
                rule[me] = int(rng.choice(open_))
                value[me] = float(rng.uniform(low[rule[me]], high[rule[me]]))
                below = part[:, rule[me]] <= value[me]
                left[me], right[me] = node(part[below], depth + 1), node(part[~below], depth + 1)
            return me

        node(rows, 0)
        return tuple(np.array(x) for x in (rule, value, left, right, length))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path length / scale): near 1 for rows that are set apart early."""
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for rule, value, left, right, length in self.trees:
            at = np.zeros(len(rows), "i8")
            for _ in range(self.depth):
                at = np.where(rows[every, rule[at]] <= value[at], left[at], right[at])
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / max(self.scale, 1e-9))


def calibrated(score: np.ndarray, good: np.ndarray) -> float:
    """The cut with the most good kept plus bad rejected, midway to the next score; the higher one of equals; infinite unless both kinds are there."""
    if good.all() or not good.any():
        return float("inf")
    at = np.unique(score)
    kept = np.searchsorted(np.sort(score[good]), at, "right") * int((~good).sum())
    passed = np.searchsorted(np.sort(score[~good]), at, "right") * int(good.sum())
    best = len(at) - 1 - int(np.argmax((kept - passed)[::-1]))
    return float((at[best] + at[min(best + 1, len(at) - 1)]) / 2)


def labelled(labels: DataFrame) -> DataFrame:
    """A staged table of all labelled ids and their quality."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    return stage(marks, "labelled")


def drawn(rows: DataFrame, n: int, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED) -> DataFrame:
    """(tree, key, rules) of the ``n`` rows that may be among the ``tree_rows`` least keys of a tree: twice as many, or all."""
    import pyarrow as pa

    share = 2 * tree_rows / n
    most = np.uint64(2**64 - 1 if share >= 1 else int(share * 2**64))
    salt = np.random.default_rng(seed).integers(0, 2**64, trees, "u8")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                key = part.column("place").to_numpy().view("u8")[:, None] ^ salt
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    key = (key ^ key >> np.uint64(shift)) * np.uint64(factor)
                key ^= key >> np.uint64(31)
                row, tree = np.nonzero(key <= most)
                taken = part.select(list(RULES)).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(tree.astype("i4")), pa.array((key[row, tree] >> np.uint64(1)).astype("i8")), *taken.columns], names=["tree", "key", *RULES])

    return rows.select("place", *RULES).mapInArrow(draw, ", ".join(["tree int, key long", *(f"{c} double" for c in RULES)]))


def grown(rows: DataFrame, n: int, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED) -> Forest:
    """The forest of the ``n`` rows, each tree grown in a task from its own draw of them all."""
    import pandas as pd

    forest = Forest.bare(min(tree_rows, n))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        tree = int(part["tree"].iloc[0])
        own = part.sort_values(["key", *RULES]).head(tree_rows)[list(RULES)].to_numpy("f8")
        return pd.DataFrame([(tree, *(x.tolist() for x in forest._grow(own, np.random.default_rng([seed, tree]))))], columns=["tree", "rule", "value", "left", "right", "length"])

    found = drawn(rows, n, trees, tree_rows, seed).groupBy("tree").applyInPandas(grow, "tree int, rule array<int>, value array<double>, left array<int>, right array<int>, length array<double>")
    forest.trees = [tuple(map(np.array, r[1:])) for r in sorted(found.collect(), key=lambda r: r.tree)]  # of fixed size
    return forest


def cut(scored: DataFrame) -> float:
    """``calibrated`` of rows (score, good) without collecting them: counts by value, added up within ranges and over the ranges before."""
    kinds = [F.count_if(c).alias(name) for name, c in (("good", F.col("good")), ("bad", ~F.col("good")))]
    values = stage(scored.groupBy("score").agg(*kinds), "scores")
    ranges = stage(values.repartitionByRange("score").withColumn("part", F.spark_partition_id()), "score-ranges")
    parts = ranges.groupBy("part").agg(F.min("score").alias("first"), F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy("part").collect()  # a row a partition
    good, bad = sum(p.good for p in parts), sum(p.bad for p in parts)
    if not good or not bad:
        return float("inf")
    before = [(p.part, sum(q.good for q in parts[:k]), sum(q.bad for q in parts[:k]), parts[k + 1].first if k + 1 < len(parts) else None) for k, p in enumerate(parts)]
    known = scored.sparkSession.createDataFrame(before, "part int, good_before long, bad_before long, further double")
    order = Window.partitionBy("part").orderBy("score")
    kept, passed = (F.col(f"{c}_before") + F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, 0)) for c in ("good", "bad"))
    gain = kept * F.lit(bad).cast("long") - passed * F.lit(good).cast("long")
    best = ranges.join(F.broadcast(known), "part").select("score", gain.alias("gain"), F.coalesce(F.lead("score").over(order), "further", "score").alias("further")).orderBy(F.desc("gain"), F.desc("score")).first()
    return (best.score + best.further) / 2


def fit(stats: DataFrame, chosen: DataFrame) -> tuple[Forest | None, float]:
    """The forest and its threshold, from every ``labelled`` row that the base rules let through by its length."""
    import pyarrow as pa

    marked = stats.where(f"n_words >= {LEAST_WORDS}").join(small_enough(chosen), "doc_id").select("doc_id", (F.col("quality") == 1).alias("good"), *RULES).dropDuplicates()
    rows = stage(marked.withColumn("place", F.xxhash64("doc_id", *RULES)), "labelled-rows")
    n = rows.count()
    if n < 2:
        return None, float("inf")
    forest = grown(rows, n)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = forest.score(np.stack([batch.column(c).to_numpy() for c in RULES], 1))
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(found)], names=["good", "score"])

    return forest, cut(rows.select("good", *RULES).mapInArrow(scores, "good boolean, score double"))


def verdict(base: dict[str, np.ndarray], rows: np.ndarray, forest: Forest | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, kept and score of rows of base and rule statistics."""
    failed = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED_PERCENT * base["n_words"])
    score = forest.score(rows) if forest and len(rows) else np.zeros(len(rows))
    return failed, ~failed & (score <= threshold), score


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, score of every document."""
    import pyarrow as pa

    stats = stage(measured(docs), "statistics")
    forest, threshold = fit(stats, labelled(labels))

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = {c: batch.column(c).to_numpy() for c in BASE}
            found = verdict(base, np.stack([batch.column(c).to_numpy() for c in RULES], 1), forest, threshold)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *BASE)), *map(pa.array, found)], names=["doc_id", *BASE, "base_failed", "kept", "score"])

    return stats.mapInArrow(verdicts, ", ".join(["doc_id long", *(f"{c} long" for c in BASE), "base_failed boolean, kept boolean, score double"]))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, each by its own verdict, whatever its id."""
    import pyarrow as pa

    chosen = labelled(labels)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small_enough(chosen.select("doc_id")), "doc_id", "left_semi")
    forest, threshold = fit(stage(measured(marked), "statistics"), chosen)
    text = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = np.array([statistics(t or b"") for t in utf8(part.column(text))], "f8")
                base = {c: found[:, k].astype("i8") for k, c in enumerate(BASE)}
                yield part.filter(pa.array(verdict(base, found[:, len(BASE) :], forest, threshold)[1]))

    return docs.mapInArrow(keep, docs.schema)
