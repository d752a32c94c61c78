"""Language-model scoring by context-tree weighting over bytes.

Texts are lower-cased (A-Z) bytes that end with a byte that UTF-8 never holds. The model
predicts each byte bit by bit; a node is a context of up to ``DEPTH`` preceding bytes
with the bits of the byte so far, and holds how often a 0 and a 1 followed in training.
Each node has its Krichevsky-Trofimov estimate, and the weighted probability of a
context is half its own estimate and half the product of its extensions', so that the
prediction mixes all depths by how well each has coded the training texts. A context
that training never saw leaves the prediction to the longest suffix it saw, whose estimate then
stands alone instead of being mixed with the even odds of its unseen extension; it is still a
distribution. All depths means all up to ``DEPTH``: a cell has five bytes of context besides
its own byte, so that it is one 64-bit key.

Counts are cells (context and byte in one key), gathered from all documents by a shuffle.
Cells of one two-byte context are dealt by their third byte into as many parts as their
number asks for; a task holds the whole subtrees below the three bytes. What they weigh is summed
by two-byte context in a shuffle, and by one byte and none on the driver, where
at most 256 * 255 + 255 nodes arrive. The outcome is the log probability of every cell that any
document has, in single precision; a text's score is their sum in double precision, so it is
right to about seven digits. It is looked up in arrays on
the workers while it has at most ``MODEL_CELLS`` cells, which is counted first; a larger
table is joined with the documents' cells by a shuffle instead.

The base score is a unigram model with add-0.1 smoothing. Words frequent enough that at
most ``HEAVY_WORDS`` of them can exist are shipped to the workers; the counts of all others are
joined by a shuffle.

Cases: null and empty texts are their end alone; a row without an id counts as held out, as its
id as text is empty; repeated rows count and are scored each; without training texts all
bits are even and every base count is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage, utf8
from .near_dedup import WordHashes

DEPTH = 5
END = 255
MODEL_CELLS = 12_000_000
HEAVY_WORDS = 1_000_000
END_WORD = np.int64(-1)
ADD = 0.1
CHUNK = 1 << 20
#: Cells that a task should hold, with the nodes it makes of them.
TASK_CELLS = 100_000
#: Cells of a two-byte context above which it is dealt by the third byte.
DEAL_CELLS = 100_000
REMEMBER = 200_000

HALF = np.log(0.5)


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def cells(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The cell of every byte of every text and its end, texts end to end; where each text begins."""
    joined = np.frombuffer(b"".join(t.lower() + b"\xff" for t in texts), "u1")
    size = np.array([len(t) + 1 for t in texts], "i8")
    starts = np.cumsum(size) - size
    key = joined.astype("u8")
    for d in range(1, depth + 1):
        # byte d before; contexts don't reach beyond the text's beginning, where they hold END
        before = np.full(len(joined), END, "u1")
        before[d:] = joined[:-d] if d < len(joined) else joined[:0]
        for k in range(d):
            at = starts + k
            before[at[k < size]] = END
        key |= before.astype("u8") << np.uint64(8 * d)
    return key, starts


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series at x + 8."""
    y, p = x + 8, np.ones_like(x)
    for k in range(8):
        p = p * (x + k)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(p)


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov probability of so many zeros and ones, as a logarithm."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - 2 * 0.5723649429247001 - log_gamma(zeros + ones + 1)


class Level:
    """The nodes of one depth, sorted: key (context, bits so far with a leading 1), counts, and later weighted logs."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.key, self.zeros, self.ones = key, zeros, ones
        self.estimate = log_estimate(zeros, ones)
        self.weighted, self.own = self.estimate, np.ones(len(key))

    def mix(self, parent: np.ndarray, weighted: np.ndarray) -> None:
        """Join the extensions: ``weighted`` logs of nodes whose suffixes here are ``parent``."""
        self.join(np.bincount(np.searchsorted(self.key, parent), weighted, len(self.key)))

    def join(self, below: np.ndarray) -> None:
        """As mix, with the sums of the extensions' weighted logs, one a node."""
        self.weighted = np.logaddexp(self.estimate, below) + HALF
        self.own = np.exp(self.estimate + HALF - self.weighted)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.key):
            return np.zeros(len(key), "i8"), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return at, self.key[at] == key


def bits_so_far(cell: np.ndarray, bit: int) -> np.ndarray:
    return np.uint64(1 << bit) | ((cell & np.uint64(255)) >> np.uint64(8 - bit))


def suffix(key: np.ndarray, depth: int) -> np.ndarray:
    """Context of ``depth`` bytes, from a cell or node key, with its last byte kept."""
    return key & np.uint64((1 << 8 * (depth + 1)) - 1)


def level(cell: np.ndarray, count: np.ndarray, depth: int) -> Level:
    context = suffix(cell, depth) & ~np.uint64(255)
    short, inverse = np.unique(context | (cell & np.uint64(255)), return_inverse=True)
    n = np.bincount(inverse, count, len(short))
    key = np.concatenate([(short & ~np.uint64(255)) | bits_so_far(short, b) for b in range(8)])
    bit = np.concatenate([(short >> np.uint64(7 - b)) & np.uint64(1) for b in range(8)]).astype("f8")
    key, inverse = np.unique(key, return_inverse=True)
    n = np.tile(n, 8)
    total, ones = np.bincount(inverse, n), np.bincount(inverse, n * bit)
    return Level(key, total - ones, ones)


def subtree(cell: np.ndarray, count: np.ndarray, depth: int, top: int) -> list[Level]:
    """Levels top..depth of the trees that the trained cells make, weighted from the bottom up."""
    seen = count > 0
    levels = [level(cell[seen], count[seen], d) for d in range(top, depth + 1)]
    for d in range(len(levels) - 2, -1, -1):
        levels[d].mix(suffix(levels[d + 1].key, top + d), levels[d + 1].weighted)
    return levels


def log10_cells(cell: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 of the probability of each cell's byte in its context; ``levels`` from depth 0."""
    out = np.zeros(len(cell))
    for b in range(8):
        prefix, one = bits_so_far(cell, b), ((cell >> np.uint64(7 - b)) & np.uint64(1)) == 1
        p, deeper = np.full(len(cell), 0.5), np.zeros(len(cell), bool)
        for d in range(len(levels) - 1, -1, -1):
            x = levels[d]
            at, hit = x.find((suffix(cell, d) & ~np.uint64(255)) | prefix)
            if not len(x.key):
                continue
            estimate = (np.where(one, x.ones[at], x.zeros[at]) + 0.5) / (x.zeros[at] + x.ones[at] + 1)
            mixed = np.where(deeper, x.own[at] * estimate + (1 - x.own[at]) * p, estimate)
            p, deeper = np.where(hit, mixed, p), deeper | hit
        out += np.log10(p)
    return out


def _columns(batches) -> list[np.ndarray]:
    """The columns of all batches of a task, in the order of the first, a key."""
    parts = [[b.column(i).to_numpy() for i in range(b.num_columns)] for b in batches]
    if not parts:
        return []
    found = [np.concatenate(x) for x in zip(*parts)]
    found[0] = found[0].view("u8")
    order = np.argsort(found[0], kind="stable")
    return [x[order] for x in found]


class CellTable:
    """log10 values by cell, in open addressing with linear probing."""

    def __init__(self, cell: np.ndarray, value: np.ndarray, step: int = 250_000):
        self.bits = max(10, int(np.ceil(np.log2(max(len(cell), 1) * 1.35))))
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.zeros(1 << self.bits, "f4")
        for at in range(0, len(cell), step):  # some at a time, as a worker has little besides the table
            self._put(cell[at : at + step], value[at : at + step])

    def _put(self, cell: np.ndarray, value: np.ndarray) -> None:
        at = self._home(cell)
        while len(cell):
            free = self.keys[at] == np.uint64(0xFFFFFFFFFFFFFFFF)
            self.keys[at[free]] = cell[free]
            lost = self.keys[at] != cell
            self.values[at[~lost]] = value[~lost]
            cell, value, at = cell[lost], value[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _home(self, cell: np.ndarray) -> np.ndarray:
        return (cell * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype("i8")

    def __call__(self, cell: np.ndarray) -> np.ndarray:
        at = self._home(cell)
        out = self.values[at]
        miss = np.flatnonzero(self.keys[at] != cell)
        where = at[miss]
        while len(miss):
            where = (where + 1) & ((1 << self.bits) - 1)
            hit = self.keys[where] == cell[miss]
            out[miss[hit]] = self.values[where[hit]]
            miss, where = miss[~hit], where[~hit]
        return out


def _chunks(batch, most: int = CHUNK) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts) of a batch of (doc_id, text), a few MB at a time."""
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
        ids.append(i)
        texts.append(t or b"")
        size += len(texts[-1]) + 1
        if size >= most:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def gathered(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """kind 0: cells of all documents, kind 1: words of training documents; key and training count, per task."""
    import pyarrow as pa

    def rows(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, "i4")), pa.array(key.view("i8")), pa.array(n.astype("i8"))], names=["kind", "key", "n"])

    def merged(parts: list) -> list:
        key, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return [(key, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(key)).astype("i8"))]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        words: Counter = Counter()
        parts: list = []
        ends = 0
        for batch in batches:
            for ids, texts in _chunks(batch):
                out = np.array([held_out(i) for i in ids])
                for part, learn in (([t for t, o in zip(texts, out) if not o], 1), ([t for t, o in zip(texts, out) if o], 0)):
                    if part:
                        key, n = np.unique(cells(part, depth)[0], return_counts=True)
                        parts.append((key, n * learn))
                    if learn:
                        ends += len(part)
                        for t in part:
                            words.update(t.lower().split())
                if sum(len(k) for k, _ in parts) > 3_000_000:
                    parts = merged(parts)
                    if len(parts[0][0]) > 1_500_000:  # memory stays bounded; the shuffle adds the rest
                        yield rows(0, *parts.pop())
                if len(words) > 1_000_000:
                    yield rows(1, np.array([xxh3_64_intdigest(w) for w in words], "u8"), np.fromiter(words.values(), "i8", len(words)))
                    words.clear()
        if parts:
            yield rows(0, *merged(parts)[0])
        if words:
            yield rows(1, np.array([xxh3_64_intdigest(w) for w in words], "u8"), np.fromiter(words.values(), "i8", len(words)))
        if ends:
            yield rows(2, np.array([END_WORD], "i8"), np.array([ends]))

    return docs.select("doc_id", "text").mapInArrow(gather, "kind int, key long, n long")


NODES = "key long, zeros double, ones double, below double"


def model(cell_counts: DataFrame, depth: int = DEPTH, deal_cells: int = DEAL_CELLS) -> DataFrame:
    """A staged table (cell, value): log10 of the probability of every cell of ``cell_counts`` (key, n)."""
    import pyarrow as pa

    # key: byte, then contexts from the nearest byte up; the two nearest are bits 8 to 23, the third is bits 24 to 31
    two_bytes = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF)).alias("two")
    third = F.shiftright("key", 24).bitwiseAND(F.lit(0xFF))
    spark = cell_counts.sparkSession
    sizes = stage(cell_counts.groupBy(two_bytes).agg(F.count(F.lit(1)).alias("cells")).withColumn("deal", F.least(F.ceil(F.col("cells") / deal_cells), F.lit(256)).cast("int")), "contexts")
    total = sizes.agg(F.coalesce(F.sum("cells"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_CELLS + 1)
    deal = F.broadcast(sizes.select("two", "deal"))  # at most 65,536 rows
    cells_of = cell_counts.select("key", "n", two_bytes).join(deal, "two").select("two", F.pmod(third, "deal").alias("part"), "key", "n")

    def nodes(key: np.ndarray, *sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key.view("i8")), *map(pa.array, sums)], names=["key", "zeros", "ones", "below"])

    def summed(tree: Level, depth: int) -> pa.RecordBatch:
        key, inverse = np.unique(suffix(tree.key, depth), return_inverse=True)
        return nodes(key, *(np.bincount(inverse, x, len(key)) for x in (tree.zeros, tree.ones, tree.weighted)))

    def below_three(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _columns(batches)
        if found and (found[1] > 0).any():
            yield summed(subtree(found[0], found[1].astype("f8"), depth, 3)[0], 2)

    def below_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                two = Level(batch.column(0).to_numpy().view("u8"), *(batch.column(i).to_numpy() for i in (1, 2)))
                two.join(batch.column(3).to_numpy())
                yield summed(two, 1)

    def added(found: DataFrame) -> DataFrame:
        return found.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below")))

    upper = stage(added(cells_of.repartition(parts, "two", "part").select("key", "n").mapInArrow(below_three, NODES)), "two-bytes")
    rows = added(upper.mapInArrow(below_two, NODES)).orderBy("key").toPandas()  # at most 256 * 255 rows
    one = Level(rows["key"].to_numpy().astype("u8"), rows["zeros"].to_numpy("f8"), rows["ones"].to_numpy("f8"))
    one.join(rows["below"].to_numpy("f8"))
    key, inverse = np.unique(suffix(one.key, 0), return_inverse=True)
    zero = Level(key, np.bincount(inverse, one.zeros, len(key)), np.bincount(inverse, one.ones, len(key)))
    if len(key):
        zero.mix(suffix(one.key, 0), one.weighted)

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _columns(batches)
        if not found:
            return
        key, count, zeros, ones, below = found
        inner, cell = count < 0, count >= 0
        two = Level(key[inner], zeros[inner], ones[inner])
        two.join(below[inner])
        key, count = key[cell], count[cell]
        levels = [zero, one, two, *subtree(key, count.astype("f8"), depth, 3)]
        for at in range(0, len(key), 500_000):
            part = key[at : at + 500_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.view("i8")), pa.array(log10_cells(part, levels).astype("f4"))], names=["cell", "value"])

    # each part of a two-byte context gets that context's own nodes, 255 at most, marked by a count of -1
    nothing = [F.lit(0.0).alias(c) for c in ("zeros", "ones", "below")]
    own = upper.select("*", two_bytes).join(deal, "two").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("deal") - 1)))
    both = cells_of.select("two", "part", "key", "n", *nothing).union(own.select("two", "part", "key", F.lit(-1).cast("long"), "zeros", "ones", "below"))
    placed = both.repartition(parts, "two", "part").select("key", "n", "zeros", "ones", "below")
    out = stage(placed.mapInArrow(valued, "cell long, value float"), "cells")
    unstage(upper, sizes)
    return out


def score(docs: DataFrame, depth: int = DEPTH, model_cells: int = MODEL_CELLS, heavy_words: int = HEAVY_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes (end included), bits_per_byte of every document."""
    import pyarrow as pa

    spark = docs.sparkSession
    counts = stage(gathered(docs, depth).groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    table = model(counts.where("kind = 0"), depth)
    words = counts.where("kind > 0")
    levels = [F.sum((F.col("n") >= (1 << i)).cast("long")).alias(f"c{i}") for i in range(48)]
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), *levels).first()
    tokens, distinct = totals["n"], totals["v"]
    scale = np.log10(tokens + ADD * (distinct + 1))
    least = next(1 << i for i in range(48) if (totals[f"c{i}"] or 0) <= heavy_words)
    heavy = words.where(F.col("n") >= least).select("key", "n").orderBy("key").toArrow()  # at most heavy_words rows
    inside = table.count() <= model_cells
    found = table.toArrow() if inside else None
    shipped = spark.sparkContext.broadcast((heavy["key"].to_numpy(), heavy["n"].to_numpy(), found["cell"].to_numpy() if inside else None, found["value"].to_numpy() if inside else None))
    unknown = float(np.log10(ADD) - scale)
    later = 1.0  # no log; its word is counted by the join

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keys, n, cell_of, value_of = shipped.value
        value = CellTable(cell_of.view("u8"), value_of) if inside else None

        def logs_of(h: np.ndarray) -> np.ndarray:
            if not len(keys):
                return np.full(len(h), unknown if least == 1 else later)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            return np.where(keys[at] == h, np.log10(n[at] + ADD) - scale, unknown if least == 1 else later)

        end = float(logs_of(np.array([END_WORD]))[0])
        hashes, logs = WordHashes(), {}
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for ids, texts in _chunks(batch):
                cell, starts = cells(texts, depth)
                sums = np.add.reduceat(value(cell).astype("f8"), starts) if inside else np.zeros(len(texts))
                bounds = np.append(starts, len(cell))
                split = [t.lower().split() for t in texts]
                if len(logs) > REMEMBER:
                    logs.clear()
                    hashes.clear()
                fresh = list(set().union(*split).difference(logs))
                logs.update(zip(fresh, logs_of(np.array([hashes[w] for w in fresh], "u8").view("i8")).tolist()))
                out: list[list] = [[] for _ in range(10)]
                for i, (doc, words_of) in enumerate(zip(ids, split)):
                    x = np.append(np.fromiter(map(logs.__getitem__, words_of), "f8", len(words_of)), end)
                    now = x < 0
                    tail = Counter(hashes[words_of[k]] if k < len(words_of) else int(END_WORD) for k in np.flatnonzero(~now))
                    row += 1
                    mine: list = []
                    if not inside:
                        u, k = np.unique(cell[bounds[i] : bounds[i + 1]], return_counts=True)
                        mine = list(zip(u.view("i8").tolist(), k.tolist()))
                    signed = [(k - (1 << 64) if k >> 63 == 1 else k, c) for k, c in tail.items()]
                    for column, v in zip(out, (row, doc, held_out(doc), len(x), int((now & (x != unknown)).sum()), float(x[now].sum()), float(sums[i]), int(bounds[i + 1] - bounds[i]), signed, mine)):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], schema=pa.schema(list(zip(names, kinds))))

    pairs = pa.list_(pa.struct([("k", pa.int64()), ("c", pa.int64())]))
    names = ["row", "doc_id", "held_out", "n_tokens", "sure", "base", "sum", "n_bytes", "tail", "cells"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pairs, pairs]
    schema = "row long, doc_id long, held_out boolean, n_tokens long, sure long, base double, sum double, n_bytes long, tail array<struct<k:long,c:long>>, cells array<struct<k:long,c:long>>"
    parts = stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scored, schema), "scored")
    tail = parts.select("row", F.inline("tail")).join(words.where(F.col("n") < least).select(F.col("key").alias("k"), "n"), "k", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    added = tail.groupBy("row").agg(F.sum(F.col("c") * (F.log10(F.col("n") + ADD) - F.lit(float(scale)))).alias("tail_base"), F.sum(F.when(F.col("n") > 0, F.col("c")).otherwise(F.lit(0))).alias("tail_known"))
    out = parts.drop("tail", "cells").join(added, "row", "left")
    if inside:
        out = out.withColumn("by_join", F.lit(0.0))
    else:
        joined = parts.select("row", F.inline("cells")).join(table.withColumnRenamed("cell", "k"), "k")
        out = out.join(joined.groupBy("row").agg(F.sum(F.col("c") * F.col("value").cast("double")).alias("by_join")), "row", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("sure") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"),
        (F.col("sum") + F.coalesce("by_join", F.lit(0.0))).alias("score"),
        "n_bytes",
    ).withColumn("bits_per_byte", -F.col("score") / F.lit(float(np.log10(2.0))) / F.col("n_bytes"))
