"""Exact top-k search by columnar branch and bound.

Vectors are quantized and packed into blocks in vertical layout: one row per dimension, in the
smallest integer type that holds them. A block of queries meets a block of candidates in one task. Scores are accumulated a few
dimensions at a time, heaviest first; what the dimensions left can add to an inner
product is at most the product of the masses left on both sides. Candidates whose upper
bound is below the k-th best lower bound are dropped, and the survivors are compacted
before the next dimensions are read. The best k of each pair of blocks are merged.

Queries are a stated subset of the rows; neither side is collected or broadcast. Candidate
blocks are numbered where they lie, by task and count, move once, and every block of queries,
the smaller side, is sent to each of them.

Cases: null vectors and vectors with null or non-finite components take no part, nor do
rows without an id; vectors of unequal length are taken as if filled up with zeros;
ties go to the smaller id; rows that share an id are each a candidate, but one query; a
query is never its own candidate, so an only vector gets no row; an empty table gives an
empty result; extra columns are ignored. Vectors too large for exact floating point are scored
in limbs of 21 bits, alone, not with their block; a score beyond +-(2^63 - 1) is that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage

K = 20
SCALE = 64
EVERY = 20
CANDIDATES = 8192
QUERIES = 512
STEP = 16
#: Candidates of a block whose whole scores set the first bound.
SEED = 256

ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {K}
"""

BLOCK = "task int, k int, size int, width int, kind string, ids binary, data binary"
LIMB = 21
PARTS = ("size", "width", "kind", "ids", "data")


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of up to ``size`` rows of (id, vector of double): ids, and the quantized vectors, dimension by dimension."""
    import pyarrow as pa

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        ids, vectors = [], []

        def block() -> pa.RecordBatch:
            width = max(map(len, vectors), default=0)
            data = np.zeros((width, len(vectors)))
            for i, v in enumerate(vectors):
                data[: len(v), i] = v
            data = np.floor(SCALE * data)
            most = np.abs(data).max(initial=0)
            kind = next((t for t in ("i1", "i2", "i4") if most <= np.iinfo(t).max), "f8")
            row = (task, k, len(ids), width, kind, np.array(ids, "i8").tobytes(), data.astype(kind).tobytes())
            ids.clear()
            vectors.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary()))], names=["task", "k", "size", "width", "kind", "ids", "data"])

        for batch in batches:
            offsets, flat = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy(zero_copy_only=False)
            for i, doc in enumerate(batch.column(0).to_pylist()):
                ids.append(doc)
                vectors.append(flat[offsets[i] : offsets[i + 1]])
                if len(ids) == size:
                    yield block()
                    k += 1
        if ids:
            yield block()

    return rows.mapInArrow(pack, BLOCK)


def best(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int = K) -> tuple[np.ndarray, ...]:
    """(query, candidate, score) of the k best candidates of every query; vectors are columns of ``queries`` and ``data``."""
    width = max(len(queries), len(data))
    queries, data = (np.pad(x, ((0, width - len(x)), (0, 0))) for x in (queries, data))
    # products of larger components than this may not be exact in floating point
    exact = (2.0**53 / max(width, 1)) ** 0.5
    large_q, large_x = (np.abs(a).max(0, initial=0) >= exact for a in (queries, data))
    if large_q.any() or large_x.any():
        parts = []
        for a, b, whole in ((~large_q, ~large_x, False), (large_q, np.ones_like(large_x), True), (~large_q, large_x, True)):
            rows, columns = np.flatnonzero(a), np.flatnonzero(b)
            if len(rows) and len(columns):
                x = queries[:, rows], query_ids[rows], data[:, columns], ids[columns]
                at, of, score = in_limbs(*x) if whole else best(*x, k)
                parts.append((rows[at], columns[of], score))
        if not parts:
            return (np.zeros(0, "i8"),) * 3
        at, of, score = (np.concatenate(p) for p in zip(*parts))
        return _first(at, of, score, ids, k)
    order = np.argsort(-(data**2).sum(1), kind="stable")
    queries, data = queries[order], data[order]
    small = max(np.abs(a).max(initial=0) for a in (queries, data)) ** 2 * max(width, 1) < 2.0**24
    q, x = (np.ascontiguousarray(a.astype("f4" if small else "f8")) for a in (queries, data))

    def left(a: np.ndarray) -> np.ndarray:
        """The mass of the dimensions from each step on."""
        squares = np.add.reduceat(a.astype("f8") ** 2, np.arange(0, len(a), STEP), axis=0) if len(a) else np.zeros((0, a.shape[1]))
        return np.sqrt(np.vstack([np.cumsum(squares[::-1], 0)[::-1], np.zeros((1, a.shape[1]))]))

    query_left, data_left = (a.astype(q.dtype) for a in (left(q), left(x)))
    own = query_ids[:, None] == ids[None, :]
    # the bound to beat: the k-th best whole score among the first candidates
    cut = kth(np.where(own[:, :SEED], -np.inf, q.T @ x[:, :SEED]), k)
    total = np.zeros((q.shape[1], x.shape[1]), q.dtype)
    columns, steps = np.arange(x.shape[1]), len(query_left) - 1
    at = of = part = None
    for s in range(steps):
        dims = slice(s * STEP, (s + 1) * STEP)
        if at is None:  # still dense: all queries with the candidates that some query needs
            total += q[dims].T @ x[dims][:, columns]
            if s + 1 == steps:
                break
            reach = np.outer(query_left[s + 1] * q.dtype.type(1 + 1e-5) + q.dtype.type(1e-3), data_left[s + 1][columns])
            reach += total
            alive = reach >= cut[:, None] - 0.5
            share = alive.mean()
            if share < 0.9:
                needed = alive.any(0)
                if needed.mean() < 0.9:
                    columns, total, own, alive = columns[needed], total[:, needed], own[:, needed], alive[:, needed]
            if share < 0.1:
                at, of = np.nonzero(alive & ~own)
                part, of = total[at, of], columns[of]
        else:  # compacted: the pairs that are left
            for d in range(dims.start, min(dims.stop, len(q))):
                part += q[d, at] * x[d, of]
            keep = part + query_left[s + 1][at] * data_left[s + 1][of] * (1 + 1e-5) + 0.5 >= cut[at]
            at, of, part = at[keep], of[keep], part[keep]
    if at is None:
        total[own] = -np.inf
        at, of = np.nonzero((total >= np.maximum(cut, kth(total, k))[:, None]) & ~own)
        part, of = total[at, of], columns[of]
    return _first(at, of, np.rint(part).astype("i8"), ids, k)


def in_limbs(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """All pairs and their exact scores, as sums of products of 21-bit limbs, which floating point holds exactly."""

    def limbs(a: np.ndarray) -> list[np.ndarray]:
        out, left = [], np.abs(a)
        while left.any():
            rest = np.floor(left / 2.0**LIMB)
            out.append((left - rest * 2.0**LIMB) * np.sign(a))
            left = rest
        return out

    total = np.zeros((queries.shape[1], data.shape[1]), object)
    for i, q in enumerate(limbs(queries)):
        for j, x in enumerate(limbs(data)):
            for d in range(0, len(q), 1024):
                total += (q[d : d + 1024].T @ x[d : d + 1024]).astype("i8").astype(object) << LIMB * (i + j)
    score = np.array([min(max(s, 1 - 2**63), 2**63 - 1) for s in total.ravel().tolist()], "i8").reshape(total.shape)
    at, of = np.nonzero(query_ids[:, None] != ids[None, :])
    return at, of, score[at, of]


def kth(score: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; minus infinity if it has fewer."""
    if score.shape[1] < k:
        return np.full(len(score), -np.inf, score.dtype)
    return np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]


def _first(at: np.ndarray, of: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    by = np.lexsort((ids[of], -score, at))
    at, of, score = at[by], of[by], score[by]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[keep], of[keep], score[keep]


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``vectors`` (id, vector) for each row of ``queries`` (id, vector)."""
    import pyarrow as pa

    asked = stage(packed(queries.dropDuplicates(["id"]).repartition(F.col("id")), QUERIES), "queries")
    given = stage(packed(vectors, CANDIDATES), "candidates")
    # one narrow row a task: where its blocks begin in the numbering of all
    tasks = given.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    begins = tasks.select("task", F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    blocks = given.count()
    at = F.broadcast(stage(begins, "begins"))
    numbered = given.join(at, "task").select((F.col("first") + F.col("k")).alias("block"), *(F.col(c).alias(f"c_{c}") for c in PARTS))
    sent = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1)))).select(F.col("block").cast("long").alias("block"), *PARTS)
    parts = max(2 * blocks, 2)
    pairs = sent.repartition(parts, "block").join(numbered.repartition(parts, "block").hint("merge"), "block").select("block", *PARTS, *(f"c_{c}" for c in PARTS))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(batch: pa.RecordBatch, i: int, first: int) -> tuple[np.ndarray, np.ndarray]:
            n, width, kind, ids, data = (batch.column(first + j)[i].as_py() for j in range(5))
            return np.frombuffer(ids, "i8"), np.frombuffer(data, kind).reshape(width, n).astype("f8")

        last = candidates = None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column(0)[i].as_py() != last:
                    last, candidates = batch.column(0)[i].as_py(), read(batch, i, 6)
                q_ids, q = read(batch, i, 1)
                at, of, score = best(q, q_ids, candidates[1], candidates[0], k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(candidates[0][of]), pa.array(score)], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(find, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """The search whose queries are the rows with an id divisible by ``every``."""
    rows = embeddings.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return search(rows, rows.where(F.col("id") % every == 0), k)
