"""Best-two-fit packing of tokenized documents into sequences of fixed length.

A document becomes its token ids and one end id; one that is longer than a sequence is
cut into pieces of the full length, the first piece taking what is left over. Only the
lengths decide which pieces share a sequence, so the packing is planned on the
histogram of lengths (at most ``capacity`` rows, whatever the input): the longest
length left opens a sequence, the largest lengths that fit fill it greedily, then its
smallest piece gives way to two others if they fit the gap it leaves more tightly. The
same pattern repeats as often as the histogram allows. Pieces then take the places of
their length by rank; ranks are counted in salted groups, so that copies of one text
don't meet in one task.

Cases: a null or empty text is its end id alone, a piece of length 1; texts of any
length are cut, never truncated; repeated rows are packed each; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage
from .token_counts import byte_symbols

CAPACITY = 2048
#: Chunks whose ids a worker remembers before it starts afresh.
REMEMBER = 300_000
#: Characters of a chunk that is encoded by the library, and that is remembered, at most.
LONG = 20_000
SHORT = 200
#: Pieces that one salted group should hold.
GROUP_ROWS = 20_000

#: Fixed value: how the byte-level tokenizer cuts a text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class ChunkEncoder:
    """Token ids of whole texts by a byte-level BPE file, as little-endian uint32 bytes.

    White space runs only begin pre-tokens of this tokenizer and never end inside one,
    so a text can be cut before any space that follows a non-space, and each chunk
    encoded alone, once per distinct chunk. Plain chunks go to a small encoder that holds the file's own
    vocabulary as ranks, which gives the library's ids at less cost a call; whatever may
    hold a special string, or is longer than ``LONG`` characters without such a place, goes to
    the library, whose stack doesn't grow with a run of white space. Only short chunks are remembered.
    """

    def __init__(self, path: str, remember: int = REMEMBER):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        import tiktoken

        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        self.plain = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks={bytes(byte_of[c] for c in s): i for s, i in vocab.items()}, special_tokens={})
        self.known: dict[str, bytes] = {}
        self.remember = remember
        self.run = regex.compile(r"\s ")
        self.place = regex.compile(r"(?<=\S)(?= )")

    def _encode(self, text: str) -> bytes:
        if len(text) > LONG or "<|" in text:
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return array("I", self.plain.encode_ordinary(text)).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.remember:
            self.known.clear()
        known, parts, fresh = self.known, [], {}
        for text in texts:
            if not text:
                parts.append([])
                continue
            if text[0] == " " or self.run.search(text):
                chunks = self.place.split(text)
            else:
                head, *tail = text.split(" ")
                chunks = [head, *[" " + c for c in tail]]
            parts.append(chunks)
            for c in chunks:
                if c not in known:
                    fresh[c] = None
        if fresh:
            known.update(zip(fresh, map(self._encode, fresh)))
        out = [b"".join(map(known.__getitem__, chunks)) for chunks in parts]
        for c in fresh:
            if len(c) > SHORT:
                del known[c]
        return out


def cut(ids: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``ids`` ids; only the first may be shorter than a full one."""
    if ids <= capacity:
        return [(0, ids)]
    head = ids % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, ids, capacity)]


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    import pyarrow as pa

    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in batches:
            encode = encode or ChunkEncoder(tokenizer)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list] = [[], [], [], [], []]
                for doc, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()])):
                    ids += end
                    for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        for column, value in zip(out, (doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, PIECES)


class Stock:
    """How many pieces of each length are left, with the largest length left up to any bound."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = [0] * (capacity + 1)
        for length, n in counts.items():
            self.left[length] = n
        self.below = list(range(capacity + 1))
        for x in range(1, capacity + 1):
            if not self.left[x]:
                self.below[x] = self.below[x - 1]

    def largest(self, bound: int, used: dict[int, int]) -> int:
        """The largest length up to ``bound`` of which more are left than ``used`` says; 0 if none."""
        while bound > 0:
            at, path = bound, []
            while self.below[at] != at:
                path.append(at)
                at = self.below[at]
            for x in path:
                self.below[x] = at
            if at == 0 or self.left[at] > used.get(at, 0):
                return at
            bound = at - 1
        return 0

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            self.below[length] = length - 1


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Patterns as (repetitions, {length: how many in a sequence}) that use up the histogram ``counts``."""
    stock, out = Stock(counts, capacity), []
    while first := stock.largest(capacity, {}):
        used, gap = {first: 1}, capacity - first
        order = [first]
        while gap and (nxt := stock.largest(gap, used)):
            used[nxt] = used.get(nxt, 0) + 1
            order.append(nxt)
            gap -= nxt
        if gap and len(order) > 1:
            smallest = min(order)
            used[smallest] -= 1
            room, best, pair = gap + smallest, smallest, None
            a = stock.largest(room - 1, used)
            while a and 2 * a > best:
                b = stock.largest(min(a, room - a), used | {a: used.get(a, 0) + 1})
                if b and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == room:
                        break
                a = stock.largest(a - 1, used)
            for x in pair or (smallest,):
                used[x] = used.get(x, 0) + 1
            used = {k: v for k, v in used.items() if v}
        times = min(stock.left[k] // v for k, v in used.items())
        for k, v in used.items():
            stock.take(k, v * times)
        out.append((times, used))
    return out


def places(patterns: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, ...]:
    """Per pattern and length, ordered by length and rank: length, first rank, how many in a sequence, first sequence, offset."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for times, used in patterns:
        offset = 0
        for length, many in sorted(used.items(), reverse=True):
            rows.append((length, rank.get(length, 0), many, sequence, offset))
            rank[length] = rank.get(length, 0) + many * times
            offset += many * length
        sequence += times
    table = np.array(sorted(rows), "i8").reshape(-1, 5)
    return tuple(np.ascontiguousarray(table[:, i]) for i in range(5))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to the pieces; ``pieces`` has to be a staged table, as it is read three times."""
    import pyarrow as pa

    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    length_of, rank_of, many_of, sequence_of, offset_of = places(plan(histogram, capacity))
    salts = max(1, min(1 << 20, -(-sum(histogram.values()) // GROUP_ROWS))) * 4
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.row_number().over(inside) - 1)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.searchsorted(length_of, np.arange(capacity + 2))
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            at = np.empty(len(length), "i8")
            for x in np.unique(length):
                here = length == x
                lo, hi = starts[x], starts[x + 1]
                at[here] = lo + np.searchsorted(rank_of[lo:hi], rank[here], "right") - 1
            q = rank - rank_of[at]
            many = many_of[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence_of[at] + q // many), pa.array(offset_of[at] + q % many * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long")).mapInArrow(put, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    return pack(stage(tokenized_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
