"""Near-duplicate documents by HyperMinHash over word shingles.

A document's set is its distinct 5-word shingles. For each of ``BUCKETS`` seeded buckets
the set's least hash is kept as a register of 16 bits: the count of its leading zeros and
the ten bits after its first one. The first 128 registers are banded four by four, which packs a
band into one integer. Documents that share a band are candidates; their Jaccard
similarity is estimated from all equal registers, corrected for registers that agree by
chance, candidates far below the limit go, and the rest are confirmed on full sets.

Copies are folded first: documents with equal sets form a class, and only its smallest id is
compared. Then every bucket of every band compares its members with its most central one,
and confirmed links make components. What is left are buckets with several components.
The largest component of such a bucket is its hub. Of its members and of those of the
components that meet it, only the documents that lie in such a bucket themselves are laid
out in blocks; documents of two components besides the hub only where a
bucket holds three or more. A pair of blocks is compared by registers alone, 512 bytes a
document. Only documents with a partner in reach of the limit go on, in parts of bounded
size with their partners, and there sets confirm the links by a product of membership
matrices. n documents left over by the first comparison cost n / ``BLOCK_DOCS`` copies of
their registers; their sets move for likely pairs only, and no candidate is dropped.

With 32 bands of 4 registers a pair at the limit of 0.75 is missed with a probability
of 5e-6, less above it; lower limits are refused, as the bands would lose links. The
estimate over 256 registers is cut five standard errors below the limit, at 0.615.

Cases: null, empty and blank texts have the empty set, size 0, and are linked with nothing;
fewer than five words make one shingle; repeated rows with one id are one document, of which
one row stays; rows
without an id are never linked and are kept; an empty table gives an empty result; extra
columns are ignored; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_enough, stage, unstage, utf8
from .components import components

SHINGLE = 5
BUCKETS = 256
#: Bands of four registers, packed into a long each; the registers behind them serve the estimate alone.
BANDS = 32
MANTISSA = 10
LEAST_PERCENT = 75
ERRORS = 5
#: Documents whose registers a block may hold.
BLOCK_DOCS = 1024
#: Sets, and shingles, that a part with likely partners may hold.
BLOCK_SETS = 400
BLOCK_SHINGLES = 1_500_000
REMEMBER = 300_000

ORACLE = """
WITH RECURSIVE text_ AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM text_),
held AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN held x ON x.doc_id = a JOIN held y ON y.doc_id = b WHERE 100 * both_ >= 75 * (x.n + y.n - both_)),
ends AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(node, root) AS (SELECT a, a FROM ends UNION SELECT e.b, r.root FROM reach r JOIN ends e ON e.a = r.node WHERE r.root < e.b),
label AS (SELECT node, least(node, min(root)) AS component FROM reach GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept FROM text_ LEFT JOIN held USING (doc_id) LEFT JOIN label ON node = doc_id
"""

SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, registers array<long>"
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], "u8")


class WordHashes(dict):
    """64-bit hashes of words, computed once per worker."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        value = self[word] = xxh3_64_intdigest(word)
        return value


def stir(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, "u8")
    h = np.fromiter(map(hashes.__getitem__, words), "u8", n)
    if n < SHINGLE:
        return stir(np.array([np.sum(h * ODD[:n], dtype="u8") + np.uint64(n)], "u8"))
    mixed = h[: n - 4] * ODD[0]
    for j in range(1, SHINGLE):
        mixed += h[j : n - 4 + j] * ODD[j]
    return np.unique(stir(mixed))


def registers(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Registers (sets x BUCKETS, 16 bits) of the sets that lie end to end in ``values``."""
    out = np.empty((len(starts), BUCKETS), "u2")
    factors = stir(np.arange(1, BUCKETS + 1, dtype="u8") * ODD[1]) | np.uint64(1)
    for k in range(BUCKETS):
        least = np.minimum.reduceat(values * factors[k], starts)
        top = np.frexp(least.astype("f8"))[1].astype("i8")  # bits in use
        top -= (least >> np.maximum(top - 1, 0).astype("u8")) == 0  # rounding up to a power of two
        zeros = 64 - top
        rest = np.where(top > MANTISSA, least >> np.maximum(top - 1 - MANTISSA, 0).astype("u8"), least << np.maximum(MANTISSA + 1 - top, 0).astype("u8"))
        out[:, k] = zeros.astype("u2") << MANTISSA | (rest & np.uint64((1 << MANTISSA) - 1)).astype("u2")
    return out


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set, registers four in a long; the last three null for the empty set."""
    import pyarrow as pa
    from xxhash import xxh3_128_digest

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sets = [shingles(t or b"", hashes) for t in utf8(part.column(1))]
                if len(hashes) > REMEMBER:
                    hashes.clear()
                size = np.array([len(s) for s in sets], "i8")
                some = np.flatnonzero(size)
                regs: list = [None] * len(sets)
                digest = [(None, None)] * len(sets)
                if len(some):
                    starts = np.cumsum(size[some]) - size[some]
                    for i, r in zip(some, registers(np.concatenate([sets[i] for i in some]), starts)):
                        regs[i] = r.view("i8")
                        digest[i] = tuple(np.frombuffer(xxh3_128_digest(sets[i].tobytes()), "i8").tolist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array([a for a, _ in digest], pa.int64()), pa.array([b for _, b in digest], pa.int64()), pa.array(regs, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_a", "set_b", "registers"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sketch, SKETCH)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id and its set as an array of 64-bit hashes."""
    import pyarrow as pa

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sets = [shingles(t or b"", hashes).view("i8") for t in utf8(part.column(1))]
                if len(hashes) > REMEMBER:
                    hashes.clear()
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype("i4")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], names=["doc_id", "members"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sets_of, "doc_id long, members array<long>")


def spread(n: np.ndarray) -> np.ndarray:
    """For sets of n members, how likely the least hash has each count of leading zeros."""
    z = np.arange(54)
    return np.exp(-np.outer(n, 2.0 ** -(z + 1))) - np.exp(-np.outer(n, 2.0**-z))


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How likely registers of sets of n and m members agree though their least hashes differ."""
    return (spread(n) * spread(m)).sum(1) / (1 << MANTISSA)


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The Jaccard similarity that a share of equal registers tells, without those equal by chance."""
    c = chance(n, m)
    return (equal - c) / (1 - c)


def least_estimate(percent: int) -> float:
    """Where the estimate is cut: so many standard errors below the limit."""
    j = percent / 100
    return j - ERRORS * (j * (1 - j) / BUCKETS) ** 0.5


def estimated(pairs: DataFrame, percent: int = LEAST_PERCENT) -> DataFrame:
    """(u, v) of the pairs (u, v, n, m, ru, rv) whose corrected estimate leaves the limit within reach."""
    import pyarrow as pa

    least = least_estimate(percent)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (batch.column(i).to_numpy().astype("f8") for i in (2, 3))
            a, b = (batch.column(i).flatten().to_numpy().view("u2").reshape(-1, BUCKETS) for i in (4, 5))
            yield batch.select(["u", "v"]).filter(pa.array(estimate((a == b).mean(1), n, m) >= least))

    return pairs.where(f"100 * least(n, m) >= {percent} * greatest(n, m)").select("u", "v", "n", "m", "ru", "rv").mapInArrow(likely, "u long, v long")


def sets_for(needed: DataFrame, docs: DataFrame) -> DataFrame:
    """A staged table of the sets of the documents in ``needed`` (doc_id)."""
    needed = stage(needed.distinct(), "needed")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small_enough(needed), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return stage(shingle_sets(texts), "sets")


def confirmed(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """A staged table of the pairs (u, v) that hold on full sets."""
    a = sketches.select(F.col("rep").alias("u"), F.col("n_shingles").alias("n"), F.col("registers").alias("ru"))
    b = sketches.select(F.col("rep").alias("v"), F.col("n_shingles").alias("m"), F.col("registers").alias("rv"))
    likely = stage(estimated(pairs.join(a, "u").join(b, "v"), percent), "likely")
    sets = sets_for(likely.select(F.col("u").alias("doc_id")).union(likely.select(F.col("v").alias("doc_id"))), docs)
    both = likely.join(sets.select(F.col("doc_id").alias("u"), F.col("members").alias("mu")), "u").join(sets.select(F.col("doc_id").alias("v"), F.col("members").alias("mv")), "v")
    shared = F.size(F.array_intersect("mu", "mv"))
    out = stage(both.withColumn("shared", shared).where(100 * F.col("shared") >= percent * (F.size("mu") + F.size("mv") - F.col("shared"))).select("u", "v"), "links")
    unstage(likely, sets)
    return out


def near_by_registers(regs: np.ndarray, size: np.ndarray, component: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which of ``left`` and ``right`` (positions) are of different components, share a band and may reach the limit by their estimate."""
    bands, least = regs.view("i8")[:, :BANDS], least_estimate(percent)
    theirs, other, theirs_size = bands[right], component[right], size[right]
    by_chance = spread(size[left].astype("f8")) @ spread(theirs_size.astype("f8")).T / (1 << MANTISSA)
    near = np.zeros((len(left), len(right)), bool)
    for i, x in enumerate(left):
        fits = 100 * np.minimum(theirs_size, size[x]) >= percent * np.maximum(theirs_size, size[x])
        met = np.flatnonzero((other != component[x]) & fits)
        met = met[(theirs[met] == bands[x]).any(1)]
        c = by_chance[i, met]
        near[i, met] = ((regs[right[met]] == regs[x]).mean(1) - c) / (1 - c) >= least
    return near


def likely_parts(regs: np.ndarray, size: np.ndarray, component: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, percent: int) -> list[tuple[int, int, int, np.ndarray]]:
    """(i, j, side, positions): the documents with likely partners, cut into parts of bounded size, once for each pair of parts that has some.

    Components lie together, so that partners fall into few pairs of parts. Where a block meets itself, a part meets itself
    without a second side.
    """
    near = near_by_registers(regs, size, component, left, right, percent)

    def parted(these: np.ndarray, some: np.ndarray) -> list[np.ndarray]:
        at = np.flatnonzero(some)
        at = at[np.argsort(component[these[at]], kind="stable")]
        cost = np.maximum(1 / BLOCK_SETS, size[these[at]] / BLOCK_SHINGLES)
        part = (np.cumsum(cost) - cost + 1e-9).astype("i8")
        return [at[part == k] for k in np.unique(part)]

    out = []
    for i, a in enumerate(parted(left, near.any(1))):
        for j, b in enumerate(parted(right, near.any(0))):
            found = near[np.ix_(a, b)]
            if same and i > j or not found.any():
                continue
            out.append((i, j, 0, left[a[found.any(1)]]))
            if not (same and i == j):
                out.append((i, j, 1, right[b[found.any(0)]]))
    return out


def links_between(sets: list[np.ndarray], component: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs (of positions) of linked sets, enough of them to join all components that links between ``left`` and ``right`` join."""
    size = np.array([len(x) for x in sets])
    near = near_by_registers(registers(np.concatenate(sets), np.cumsum(size) - size), size, component, left, right, percent)
    if not near.any():
        return []
    # verification: shared members by products of membership matrices, some columns at a time
    rows, columns = near.any(1), near.any(0)
    left, right, near = left[rows], right[columns], near[np.ix_(rows, columns)]
    used = np.union1d(left, right)
    owner = np.repeat(used, size[used])
    value, index, count = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    keep = count[index] > 1
    owner, column = owner[keep], rank[index[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    place = np.zeros(len(sets), "i8")
    place[left] = np.arange(len(left))
    side = np.zeros(len(sets), "i8")
    side[right] = np.arange(len(right))
    in_left, in_right = np.isin(owner, left), np.isin(owner, right)
    shared = np.zeros((len(left), len(right)), "f4")
    step = 4096
    for at in range(0, int((count > 1).sum()), step):
        lo, hi = np.searchsorted(column, [at, at + step])
        a, b = np.zeros((len(left), step), "f4"), np.zeros((len(right), step), "f4")
        m = slice(lo, hi)
        a[place[owner[m][in_left[m]]], column[m][in_left[m]] - at] = 1
        b[side[owner[m][in_right[m]]], column[m][in_right[m]] - at] = 1
        shared += a @ b.T
    hit = near & (100 * shared >= percent * (size[left][:, None] + size[right][None, :] - shared))
    parent = {c: c for c in component.tolist()}

    def find(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(hit)):
        x, y = find(int(component[left[i]])), find(int(component[right[j]]))
        if x != y:
            parent[x] = y
            out.append((int(left[i]), int(right[j])))
    return out


def links_in_blocks(current: DataFrame, sketches: DataFrame, docs: DataFrame, percent: int) -> DataFrame | None:
    """A staged table of links (u, v) between components that share a bucket; None if none do. ``current``: (rep, band, key, component)."""
    per = current.groupBy("band", "key", "component").agg(F.count(F.lit(1)).alias("n"))
    hubs = per.groupBy("band", "key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", (-F.col("component")).alias("c"))).alias("h")).where("parts > 1")
    met = current.join(hubs.select("band", "key", (F.col("parts") > 2).alias("several"), (-F.col("h.c")).alias("hub")), ["band", "key"])
    met = met.groupBy("hub", "rep", "component").agg(F.max(F.col("several")).alias("several"))
    members = stage(met, "members")
    if members.isEmpty():
        unstage(members)
        return None
    others, own = members.where("component <> hub"), members.where("component = hub")
    blocks = F.ceil(F.count(F.lit(1)) / BLOCK_DOCS)
    counts = stage(others.groupBy("hub").agg(blocks.alias("bo")).join(own.groupBy("hub").agg(blocks.alias("bh")), "hub"), "blocks")

    def laid(rows: DataFrame, mine: str) -> DataFrame:
        return rows.join(counts, "hub").withColumn("block", F.pmod(F.xxhash64("rep"), F.col(mine)))

    def upto(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    o, h = laid(others, "bo"), laid(own, "bh")
    keep = ["hub", "rep", "component"]
    several = o.where("several")  # where a third component shares a bucket
    tasks = o.withColumn("i", upto("bh")).select(*keep, F.lit(0).alias("kind"), "i", F.col("block").alias("j"), F.lit(1).alias("side"))
    tasks = tasks.union(h.withColumn("j", upto("bo")).select(*keep, F.lit(0), F.col("block"), "j", F.lit(0)))
    twin = several.withColumn("with", upto("bo"))
    tasks = tasks.union(twin.select(*keep, F.lit(1), F.least("block", "with"), F.greatest("block", "with"), F.when(F.col("block") <= F.col("with"), 0).otherwise(1)))
    rows = tasks.join(sketches.select("rep", "n_shingles", "registers"), "rep").select("hub", "kind", "i", "j", "side", "rep", "component", "n_shingles", "registers")
    likely = stage(rows.groupBy("hub", "kind", "i", "j").applyInArrow(lambda group: _sift(group, percent), "hub long, kind int, i long, j long, pi int, pj int, side int, rep long, component long"), "block-likely")
    sets = sets_for(likely.select(F.col("rep").alias("doc_id")), docs)
    rows = likely.join(sets.withColumnRenamed("doc_id", "rep"), "rep").select("hub", "kind", "i", "j", "pi", "pj", "side", "rep", "component", "members")
    out = stage(rows.groupBy("hub", "kind", "i", "j", "pi", "pj").applyInArrow(lambda group: _confirm(group, percent), "u long, v long"), "block-links")
    unstage(members, counts, likely, sets)
    return out


def _sift(group, percent: int):
    """The documents of a pair of blocks with likely partners, a row for each pair of parts."""
    import pyarrow as pa

    rep, component, side, size = (group.column(c).to_numpy() for c in ("rep", "component", "side", "n_shingles"))
    regs = group.column("registers").combine_chunks().flatten().to_numpy().view("u2").reshape(-1, BUCKETS)
    hub, kind, i, j = (group.column(c)[0].as_py() for c in ("hub", "kind", "i", "j"))
    same = kind == 1 and i == j
    left, right = (np.arange(len(rep)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    parts = likely_parts(regs, size, component, left, right, same, percent) if len(left) and len(right) else []
    at = np.concatenate([p for *_, p in parts]) if parts else np.empty(0, "i8")
    pi, pj, which = (np.repeat(np.array([p[k] for p in parts], "i4"), np.array([len(p[3]) for p in parts], "i8")) for k in range(3))
    whole = [pa.array(np.full(len(at), v), t) for v, t in ((hub, pa.int64()), (kind, pa.int32()), (i, pa.int64()), (j, pa.int64()))]
    return pa.table([*whole, pa.array(pi), pa.array(pj), pa.array(which), pa.array(rep[at]), pa.array(component[at])], names=["hub", "kind", "i", "j", "pi", "pj", "side", "rep", "component"])


def _confirm(group, percent: int):
    """The links of a pair of parts; a part without a second side meets itself."""
    import pyarrow as pa

    rep, component, side = (group.column(c).to_numpy() for c in ("rep", "component", "side"))
    data = [x.values.to_numpy().view("u8") for x in group.column("members")]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    found = links_between(data, component, left, right if len(right) else left, percent)
    return pa.table({"u": pa.array([int(rep[a]) for a, _ in found], pa.int64()), "v": pa.array([int(rep[b]) for _, b in found], pa.int64())})


def near_duplicates(docs: DataFrame, percent: int = LEAST_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    if percent < LEAST_PERCENT:
        raise ValueError(f"the bands are laid out for limits of {LEAST_PERCENT} percent or more")
    sketch = stage(sketched(docs), "sketch")
    linkable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    classes = stage(sketch.where(linkable).groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")), "classes")
    reps = stage(sketch.where(linkable).join(classes, ["set_a", "set_b"]).where("doc_id = rep").dropDuplicates(["rep"]).select("rep", "n_shingles", "registers"), "reps")

    rows = reps.select("rep", F.posexplode(F.slice("registers", 1, BANDS)).alias("band", "key"))
    shared = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    bands = stage(rows.join(shared, ["band", "key"]).select("rep", "band", "key", "members"), "bands")
    central = bands.groupBy("rep").agg(F.sum("members").alias("weight"))
    centre = bands.join(central, "rep").groupBy("band", "key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("r"))).alias("c"))
    star = bands.join(centre.select("band", "key", (-F.col("c.r")).alias("hub")), ["band", "key"]).where("rep <> hub")
    links = confirmed(star.select(F.least("rep", "hub").alias("u"), F.greatest("rep", "hub").alias("v")).distinct(), reps, docs, percent)
    labels = components(links)

    current = bands.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "band", "key", F.coalesce("component", "rep").alias("component"))
    more = links_in_blocks(current, reps, docs, percent)
    if more is not None:
        all_links = stage(links.union(more), "all-links")
        unstage(labels, more)
        labels = components(all_links)
        unstage(all_links)
    unstage(links, bands, reps)
    of_set = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    linked = sketch.where(linkable).join(of_set, ["set_a", "set_b"]).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = sketch.where(~linkable).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, percent: int = LEAST_PERCENT) -> DataFrame:
    """The rows of ``docs`` that are kept: one document of each component, one row of each kept id and text."""
    by_id = near_duplicates(docs, percent).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    found = stage(by_id.where("kept").select("doc_id", (F.col("rows") > 1).alias("repeated")), "kept")
    more = stage(found.where("repeated").select("doc_id"), "repeated")
    kept = docs.join(small_enough(found.select("doc_id")), "doc_id", "left_semi").select(*docs.columns)
    if not more.isEmpty():  # only rows of repeated ids are shuffled with their texts
        again = kept.join(small_enough(more), "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
        kept = kept.join(small_enough(more), "doc_id", "left_anti").select(*docs.columns).unionByName(again)
    return kept.unionByName(docs.where("doc_id IS NULL"))
