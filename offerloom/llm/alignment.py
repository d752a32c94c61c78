"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often they do.

Both tokenizers cut a text, after one leading space, into byte ranges. A tokens and B tokens
whose ranges overlap are linked; offsets where both have an end cut the tokens into groups.
No token of either vocabulary goes on from another character into a space, so a text can be cut
before each space that follows another character, and each distinct chunk is encoded and aligned
once while a worker remembers it: the new chunks of some texts are encoded end to end, and their
ends are compared in one sorted array. A group never reaches over such a place. A chunk that ends in white space,
as the last of a text may, is the last of its array: tokens do go on from white space into the next chunk's space.

How often a pair of ids is linked in the corpus, and which A ids are linked most with a B id, is
found by a postings cogroup. Each document's pairs and their multiplicities are postings
(document, a, b, m). They are shuffled by their B id and sorted by it and the A id, which spills. Over that
sorted stream the count of each pair and the greatest count of the B id are added up where
they lie, one side at a time, and each posting becomes its document's contribution.
Contributions are added up by document.

B ids with more postings than a cell should hold (an even share of a partition, between ``LEAST_CELL`` and ``MOST_CELL``)
are dealt by document into as many cells as they fill. Their pair counts are added up before
the shuffle, and every cell of the id gets them as further rows of its stream. Which ids those are is
a table of at most one row per B id, that is of the size of the vocabulary.

Cases: a null or empty text, or one whose tokens don't give its bytes back (it holds the
sign that B writes for a space, say), has no tokens: counts of 0 and an empty digest. Strings of special
tokens are plain text. Texts of any length are encoded whole. Repeated rows are documents each,
as are rows without an id. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .packing import ChunkEncoder

#: Postings that a cell of the cogroup holds: an even share of a partition between these.
LEAST_CELL = 20_000
MOST_CELL = 4_000_000
#: Chunks that a worker remembers before it starts afresh.
REMEMBER = 200_000
#: Characters that are encoded at once, about.
LONG = 20_000
#: Bits of an A id, and of the number of a cell, in a key of the cogroup.
BITS = 20

DIGESTS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<a:int,b:int,m:int>>, sides array<struct<b:int,n:long>>"


class Encoder(ChunkEncoder):
    """A's ids with the strings of special tokens as plain text, and the bytes of each id."""

    def __init__(self, path: str):
        super().__init__(path)
        self.bytes = [self.plain.decode_single_token_bytes(i) for i in range(self.plain.max_token_value + 1)]

    def ids(self, text: str) -> list[int]:
        if len(text) <= 2 * LONG:
            return self.plain.encode_ordinary(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.encode_special_tokens = True
        return self.library.encode(text, add_special_tokens=False).ids


class Pieces:
    """B's ids of texts that begin with a space, and the bytes of each id; ``splits`` says that no piece goes on into a space."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        self.splits = not any("\u2581" in p.lstrip("\u2581") for p in pieces)
        # the library adds no space to an empty text
        self.space = self.model.encode("x ")[len(self.model.encode("x")) :]

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text[1:], num_threads=1) if len(text) > 1 else self.space


class Aligned:
    """What is known of chunks, by number: the numbers of A tokens, B tokens and groups, the groups as text, the links as bytes of b << BITS | a."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.sizes = np.zeros((0, 3), "i8")
        self.groups: list[bytes] = []
        self.links: list[bytes] = []


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        import regex

        self.a, self.b = Encoder(path_a), Pieces(path_b)
        assert len(self.a.bytes) <= 1 << BITS
        self.place, self.run = regex.compile(r"(?<=\S)(?= )"), regex.compile(r"^\s|\s ")
        self.length_a, self.length_b = (np.array([len(x) for x in of], "i8") for of in (self.a.bytes, self.b.bytes))
        # the id with the sign behind it: inside a side, at its end
        texts = [b"%d%c" % (i, sign) for of, inside, end in ((self.a.bytes, 44, 124), (self.b.bytes, 44, 59)) for i in range(len(of)) for sign in (inside, end)]
        self.texts = np.array(texts, object)
        self.known = Aligned()

    def _ends(self, chunks: list[str], raw: list[bytes]) -> tuple | None:
        """Ids and byte ends of both sides over chunks laid end to end; None if the bytes are not given back."""
        text = "".join(chunks)
        a, b = self.a.ids(text), self.b.ids(text)
        whole = b"".join(raw)
        if b"".join(map(self.a.bytes.__getitem__, a)) != whole or b"".join(map(self.b.bytes.__getitem__, b)) != whole:
            return None
        a, b = np.array(a, "i8"), np.array(b, "i8")
        return a, b, np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])

    def learn(self, chunks: list[str]) -> None:
        """Align chunks that are not known yet, laid end to end as far as ``LONG`` characters go; nothing follows one that ends in white space."""
        at = 0
        while at < len(chunks):
            stop, size = at, 0
            while stop < len(chunks) and (stop == at or self.b.splits and size + len(chunks[stop]) <= LONG and not chunks[stop - 1][-1].isspace()):
                size += len(chunks[stop])
                stop += 1
            part = chunks[at:stop]
            raw = [c.encode() for c in part]
            found = self._ends(part, raw)
            if found is not None:
                self._keep(part, np.cumsum([len(r) for r in raw]), *found)
            elif len(part) > 1:
                for c in part:
                    self.learn([c])
            else:
                self.known.number[part[0]] = -1
            at = stop

    def _keep(self, chunks: list[str], ends: np.ndarray, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> None:
        known = self.known
        every = np.sort(np.concatenate((ends_a, ends_b)))
        every = every[np.diff(every, prepend=0) > 0]
        of_a, of_b = np.searchsorted(ends_a, every), np.searchsorted(ends_b, every)
        links = b[of_b] << BITS | a[of_a]
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        to_a, to_b = np.searchsorted(ends_a, both) + 1, np.searchsorted(ends_b, both) + 1
        last_a[to_a - 1], last_b[to_b - 1] = True, True
        # each token after those of its side before it, and those of the other side in groups before it
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        code = np.empty(len(a) + len(b), "i8")
        code[np.arange(len(a)) + np.concatenate(([0], to_b))[group_a]] = 2 * a + last_a
        code[np.arange(len(b)) + to_a[group_b]] = 2 * (len(self.a.bytes) + b) + last_b
        texts = self.texts[code].tolist()
        cut_a, cut_b, cut_g, cut_l = (np.searchsorted(x, ends) + 1 for x in (ends_a, ends_b, both, every))
        raw, first = links.tobytes(), len(known.groups)
        known.sizes = np.concatenate((known.sizes, np.diff(np.stack((cut_a, cut_b, cut_g), 1), axis=0, prepend=0)))
        t = l = 0
        for k, (c, to, stop) in enumerate(zip(chunks, (cut_a + cut_b).tolist(), (8 * cut_l).tolist())):
            known.number[c] = first + k
            known.groups.append(b"".join(texts[t:to]))
            known.links.append(raw[l:stop])
            t, l = to, stop

    def chunks(self, text: str) -> list[str]:
        if not self.b.splits:
            return [" " + text]
        if self.run.search(text):
            return self.place.split(" " + text)
        return [" " + c for c in text.split(" ")]

    def __call__(self, texts: list[str | None]) -> list[tuple | None]:
        """For each whole text n_a, n_b, n_groups, the groups, its links; None if it has no tokens."""
        if len(self.known.number) > REMEMBER:
            self.known = Aligned()
        known, parts = self.known, [self.chunks(t) if t else None for t in texts]
        number = known.number
        self.learn(list(dict.fromkeys(c for chunks in parts if chunks for c in chunks if c not in number)))
        out = []
        for chunks in parts:
            if chunks is None:
                out.append(None)
                continue
            at = list(map(number.__getitem__, chunks))
            if min(at) < 0:
                out.append(None)
                continue
            n_a, n_b, n_groups = known.sizes[at].sum(0).tolist()
            out.append((n_a, n_b, n_groups, b"".join(map(known.groups.__getitem__, at))[:-1], b"".join(map(known.links.__getitem__, at))))
        return out


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups) of every text, with the groups as text: ``a1,a2|b1;a3|b2,b3``."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for batch in batches:
            aligner = aligner or Aligner(path_a, path_b)
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [(x or (0, 0, 0, b""))[:4] for x in aligner(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in list(zip(*rows))[:3]), pa.array([r[3].decode() for r in rows], pa.string())], names=["doc_id", "n_a", "n_b", "n_groups", "groups"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, groups string")


def digests(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A staged table of a row per text: its numbers, the digest of its groups, and its pairs with their multiplicities.

    Rows without a ``row`` have in ``sides`` how many postings of each B id a task made.
    """
    import pyarrow as pa

    def nested(ends: list[int], **columns: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns.values()], names=list(columns)))

    schema = pa.schema([(c, pa.int64()) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")] + [("groups_sha256", pa.string()), ("pairs", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("m", pa.int32())]))), ("sides", pa.list_(pa.struct([("b", pa.int32()), ("n", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = made = None
        for batch in batches:
            if aligner is None:
                aligner = Aligner(path_a, path_b)
                made = np.zeros(len(aligner.b.bytes), "i8")
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = aligner(part.column(2).to_pylist())
                rows = [(x[0], x[1], x[2], x[0] + x[1] - x[2], hashlib.sha256(x[3]).hexdigest()) if x else (0, 0, 0, 0, "") for x in found]
                link = np.frombuffer(b"".join(x[4] for x in found if x), "i8")
                doc = np.repeat(np.arange(len(found)), [len(x[4]) // 8 if x else 0 for x in found])
                key = np.sort(doc << 44 | link)  # 64 documents, 2 * BITS below
                new = np.flatnonzero(np.diff(key, prepend=-1))
                m, key = np.diff(new, append=len(key)), key[new]
                b = key >> BITS & (1 << 44 - BITS) - 1
                made += np.bincount(b, minlength=len(made))
                ends = [0, *np.searchsorted(key >> 44, np.arange(len(found)), "right").tolist()]
                *numbers, sha = zip(*rows)
                pairs = nested(ends, a=(key & (1 << BITS) - 1).astype("i4"), b=b.astype("i4"), m=m.astype("i4"))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, pa.int64()) for c in numbers), pa.array(sha, pa.string()), pairs, pa.nulls(len(found), schema.field("sides").type)], schema=schema)
        if made is not None:
            b = np.flatnonzero(made)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in list(schema)[:-1]] + [nested([0, len(b)], b=b.astype("i4"), n=made[b])], schema=schema)

    return stage(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DIGESTS), "digests")


def pair_counts(digest: DataFrame) -> DataFrame:
    """(a, b, count) over all documents."""
    return digest.selectExpr("inline(pairs)").groupBy("a", "b").agg(F.sum("m").alias("count"))


def added_up(key: np.ndarray, row: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n_best, count_sum) of the postings of whole sides, sorted by key; negative rows bring the counts of other cells."""
    pair = np.flatnonzero(np.diff(key, prepend=-1))
    of = np.repeat(np.arange(len(pair)), np.diff(pair, append=len(key)))
    sent = row < 0
    whole = np.maximum.reduceat(np.where(sent, m, 0), pair)
    count = np.where(whole > 0, whole, np.add.reduceat(np.where(sent, 0, m), pair))
    side = np.flatnonzero(np.diff(key[pair] >> BITS, prepend=-1))
    best = count == np.repeat(np.maximum.reduceat(count, side), np.diff(side, append=len(pair)))
    own = ~sent
    of, row, m = of[own], row[own], m[own]
    return row, m * best[of], m * count[of]


def contributions(digest: DataFrame, least_cell: int = LEAST_CELL) -> DataFrame:
    """(row, n_best, count_sum) of every document with links, by the cogroup of postings."""
    import pyarrow as pa

    partitions = int(digest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = stage(digest.selectExpr("inline(sides)").groupBy("b").agg(F.sum("n").alias("n")), "posting-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    cell = min(max(least_cell, total // partitions), MOST_CELL)
    hot = F.broadcast(sizes.where(F.col("n") > cell).select("b", F.ceil(F.col("n") / cell).cast("long").alias("cells")))  # at most a row per B id
    postings = digest.where("row IS NOT NULL").selectExpr("row", "inline(pairs)").join(hot, "b", "left")
    place = lambda of: F.col("b").cast("long") * (1 << 2 * BITS) + of * (1 << BITS) + F.col("a")
    dealt = F.when(F.col("cells").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("row"), "cells"))
    counts = postings.where("cells IS NOT NULL").groupBy("b", "cells", "a").agg(F.sum("m").alias("m")).withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
    stream = postings.select(place(dealt).alias("key"), "row", F.col("m").cast("long").alias("m")).union(counts.select(place(F.col("cell")).alias("key"), F.lit(-1).cast("long").alias("row"), "m"))
    stream = stream.repartition(F.shiftright("key", BITS)).sortWithinPartitions("key")

    def cogroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in added_up(*(np.concatenate(c) for c in zip(*parts)))], names=["row", "n_best", "count_sum"])

        held: list = []
        rows = 0
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            held.append(columns)
            rows += len(columns[0])
            if rows >= 200_000 and columns[0][-1] >> BITS != held[0][0][0] >> BITS:
                # the last side may go on in the next batch
                open_ = columns[0][-1] >> BITS
                whole = [np.concatenate(c) for c in zip(*held)]
                cut = int(np.searchsorted(whole[0] >> BITS, open_))
                yield out([[c[:cut] for c in whole]])
                held, rows = [[c[cut:] for c in whole]], len(whole[0]) - cut
        if rows:
            yield out(held)

    return stream.mapInArrow(cogroup, "row long, n_best long, count_sum long").groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, path_a: str, path_b: str, least_cell: int = LEAST_CELL) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    digest = digests(docs, path_a, path_b)
    sums = contributions(digest, least_cell)
    zero = F.lit(0).cast("long")
    return digest.where("row IS NOT NULL").drop("pairs", "sides").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
