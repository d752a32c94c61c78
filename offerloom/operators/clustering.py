"""Clustering of names: TF-IDF, blocked DBSCAN, splitting, merging, profiles.

Vectors are long tables (doc, term, w); labels are (doc, cluster), -1 for none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import written
from .graph import connected_components
from .relational import both_sides, ranked


def document_frequency(tokens: DataFrame) -> DataFrame:
    """(term, df) over (doc, term) with repeats."""
    return tokens.distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(tokens: DataFrame, most: int, least_df: int) -> DataFrame:
    """The ``most`` terms in most documents, at least ``least_df``; ties by term."""
    return document_frequency(tokens).where(F.col("df") >= least_df).orderBy(F.desc("df"), "term").limit(most)


def tfidf(tokens: DataFrame, n_docs: int, most: int = 900, least_df: int = 3) -> DataFrame:
    """Normalized vectors: tf * (ln((1 + n) / (1 + df)) + 1) over the vocabulary.

    Tokens are counted once, per document and term; vocabulary and vectors are made of the counts.
    """
    tf = written(tokens.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf")), "term-counts")
    vocab = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least_df).orderBy(F.desc("df"), "term").limit(most)
    raw = tf.join(F.broadcast(vocab), "term").select("doc", "term", (F.col("tf") * (F.log(F.lit(1.0 + n_docs) / (1 + F.col("df"))) + 1)).alias("w"))
    return raw.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc"))))


def dot(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Adds ``sim`` to pairs (a, b): the sparse dot product, 0 where no term is shared."""
    va, vb = vectors.select(F.col("doc").alias("a"), "term", F.col("w").alias("wa")), vectors.select(F.col("doc").alias("b"), "term", F.col("w").alias("wb"))
    sims = pairs.select("a", "b").join(va, "a").join(vb, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("sim"))
    return pairs.join(sims, ["a", "b"], "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))


def block_pairs(tokens: DataFrame, n_docs: int, least_df: int = 5, most_share: float = 0.045) -> DataFrame:
    """(a, b, shared) of documents that share tokens neither rare nor frequent, a < b."""
    keys = document_frequency(tokens).where((F.col("df") >= least_df) & (F.col("df") <= most_share * n_docs)).select("term")
    x, y = both_sides(tokens.distinct().join(keys, "term").select("doc", "term"), "term", "doc")
    return x.withColumnRenamed("doc", "a").join(y.withColumnRenamed("doc", "b"), ["term", "_cell"]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def cosine_pairs(vectors: DataFrame, least: float) -> DataFrame:
    """(a, b, sim) of unit vectors (doc, term, w) with a dot product of at least ``least`` > 0, a < b.

    Of each vector only the rarest terms are joined, down to where the rest is shorter than
    ``least``: the rarest term that two such vectors share lies in both heads, so no pair is lost.
    """
    frequency = vectors.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rest = Window.partitionBy("doc").orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
    heads = vectors.join(frequency, "term").withColumn("rest", F.sqrt(F.sum(F.col("w") * F.col("w")).over(rest))).where(F.col("rest") >= least - 1e-9).select("doc", "term")
    x, y = both_sides(heads, "term", "doc")
    pairs = x.withColumnRenamed("doc", "a").join(y.withColumnRenamed("doc", "b"), ["term", "_cell"]).where("a < b").select("a", "b").distinct()
    return dot(pairs, vectors).where(F.col("sim") >= least)


def shared_tokens(pairs: DataFrame, tokens: DataFrame, n_docs: int, least_df: int, most_share: float) -> DataFrame:
    """Adds ``shared`` to pairs: how many tokens neither rare nor frequent both have; pairs with none go."""
    keys = document_frequency(tokens).where((F.col("df") >= least_df) & (F.col("df") <= most_share * n_docs)).select("term")
    x = tokens.distinct().join(keys, "term")
    both = pairs.select("a", "b").join(x.select(F.col("doc").alias("a"), "term"), "a").join(x.select(F.col("doc").alias("b"), "term"), ["b", "term"])
    return pairs.join(both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")), ["a", "b"])


def dbscan(docs: DataFrame, tokens: DataFrame, vectors: DataFrame, n_docs: int, eps: float = 0.26, least: int = 5, least_df: int = 5, most_share: float = 0.045) -> DataFrame:
    """(doc, cluster): neighbours share two block tokens and are within eps, or one and are closer by 0.10.

    Pairs are found by their similarity first, which frequent block tokens can't blow up. Border
    documents go to the cluster of their first core neighbour.
    """
    near = shared_tokens(written(cosine_pairs(vectors, 1 - eps), "close"), tokens, n_docs, least_df, most_share)
    near = written(near.where(((F.col("shared") >= 2) & (F.col("sim") >= 1 - eps)) | (F.col("sim") >= 1 - eps + 0.10)).select("a", "b"), "near")
    both = near.union(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    core = written(both.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") + 1 >= least).select(F.col("a").alias("core")), "core")
    inner = near.join(core.withColumnRenamed("core", "a"), "a", "left_semi").join(core.withColumnRenamed("core", "b"), "b", "left_semi")
    labels = core.join(connected_components(inner).withColumnRenamed("node", "core"), "core", "left").select(F.col("core").alias("doc"), F.coalesce("component", "core").alias("cluster"))
    first = both.join(core.withColumnRenamed("core", "b"), "b", "left_semi").join(core.withColumnRenamed("core", "a"), "a", "left_anti").groupBy("a").agg(F.min("b").alias("core"))
    border = first.join(labels.withColumnRenamed("doc", "core"), "core").select(F.col("a").alias("doc"), "cluster")
    known = written(labels.union(border), "labels")
    return docs.select("doc").join(known, "doc", "left").select("doc", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def cohesion(labels: DataFrame, tokens: DataFrame, sample: int = 40, ahead: int = 7) -> DataFrame:
    """(cluster, size, cohesion): mean Jaccard of the first ``sample`` members, each with the next ``ahead``; 1 for a single member."""
    sets = tokens.groupBy("doc").agg(F.collect_set("term").alias("words"))
    rows = labels.where("cluster >= 0").join(sets, "doc", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("cluster").orderBy("doc")))
    size = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    head = rows.where(F.col("rn") <= sample)
    following = head.select("cluster", F.col("rn").alias("rb"), F.col("words").alias("wb"))
    pairs = head.join(following, "cluster").where((F.col("rb") > F.col("rn")) & (F.col("rb") <= F.col("rn") + ahead))
    union = F.size(F.array_union("words", "wb"))
    j = F.size(F.array_intersect("words", "wb")) / F.greatest(union, F.lit(1))
    return size.join(pairs.groupBy("cluster").agg(F.avg(j).alias("c")), "cluster", "left").select("cluster", "size", F.coalesce("c", F.lit(1.0)).alias("cohesion"))


#: Centre rows that are broadcast to the vectors; more are joined by a shuffle.
BROADCAST_ROWS = 400_000


def seeded_centres(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """(cluster, term, c0, c1): the vectors of the first and the middle document of clusters (doc, cluster, rn, size)."""
    seeds = rows.where("rn = 1 OR rn = size DIV 2 + 1").select("doc", (F.col("rn") > 1).cast("int").alias("side"))
    of = lambda k: F.coalesce(F.sum(F.when(F.col("side") == k, F.col("w"))), F.lit(0.0)).alias(f"c{k}")
    return vectors.join(seeds, "doc").groupBy("cluster", "term").agg(of(0), of(1))


def moved_centres(sides: DataFrame, vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """The normalized means of the sides (doc, cluster, side); a side without documents keeps its centre."""
    sums = vectors.join(sides.select("doc", "side"), "doc").groupBy("cluster", "side", "term").agg(F.sum("w").alias("s"))
    unit = sums.withColumn("w", F.col("s") / F.greatest(F.sqrt(F.sum(F.col("s") * F.col("s")).over(Window.partitionBy("cluster", "side"))), F.lit(1e-12)))
    of = lambda k: F.coalesce(F.sum(F.when(F.col("side") == k, F.col("w"))), F.lit(0.0)).alias(f"m{k}")
    new = unit.groupBy("cluster", "term").agg(of(0), of(1))
    held = sides.groupBy("cluster").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))
    both = centres.join(new, ["cluster", "term"], "full").join(held, "cluster")
    keep = lambda k: F.coalesce(F.when(F.col(f"n{k}") > 0, F.col(f"m{k}")).otherwise(F.col(f"c{k}")), F.lit(0.0)).alias(f"c{k}")
    return both.select("cluster", "term", keep(0), keep(1))


def two_means(rows: DataFrame, vectors: DataFrame, rounds: int = 18) -> DataFrame:
    """(doc, cluster, side) of clusters (doc, cluster, rn, size), all at once: 2-means by cosine, from the first and the middle document.

    A round joins the vectors with their cluster's two centres, adds up both similarities of each document,
    and sums the sides to new centres; it ends as a written table. Similarities count to twelve places, so
    the order of a sum doesn't matter; ties go to the first side, as documents without a vector do.
    """
    inside = written(vectors.join(rows.select("doc", "cluster"), "doc"), "split-vectors")
    few = inside.select("cluster", "term").distinct().count() <= BROADCAST_ROWS  # no centre has other terms than its cluster
    centres = written(seeded_centres(rows, inside), "centres")
    sides = rows.select("doc", "cluster", F.lit(0).alias("side"))
    for k in range(rounds):
        near = inside.join(F.broadcast(centres) if few else centres, ["cluster", "term"])
        score = lambda c: F.round(F.sum(F.col("w") * F.col(c)), 12)
        new = near.groupBy("doc").agg((score("c1") > score("c0")).cast("int").alias("new"))
        after = written(sides.join(new, "doc", "left").select("doc", "cluster", F.coalesce("new", F.lit(0)).alias("side"), F.col("side").alias("before")), "sides")
        sides = after.drop("before")
        if k and not after.where("side <> before").limit(1).count() or k == rounds - 1:
            return sides
        centres = written(moved_centres(sides, inside, centres), "centres")
    return sides


def split_weak(labels: DataFrame, vectors: DataFrame, tokens: DataFrame, n_docs: int, least_size: int = 40, least_cohesion: float = 0.18, most: int | None = None) -> DataFrame:
    """Clusters too large, or large and loose, are split in two until none is; a useless split halves by order.

    Level by level: all weak clusters of a level are split at once, as tables, so a cluster of any size is
    many tasks. New clusters go by their smallest document.
    """
    largest = most or int(max(n_docs * 0.015, 250))
    least = lambda rows, *keys: rows.join(rows.groupBy(*keys).agg(F.min("doc").alias("least")), list(keys)).select("doc", F.col("least").alias("cluster"))
    left, done = written(least(labels.where("cluster >= 0"), "cluster"), "clusters"), labels.where("cluster < 0").select("doc", "cluster")
    while True:
        loose = (F.col("size") >= least_size) & (F.col("cohesion") < least_cohesion)
        weak = written(cohesion(left, tokens).where((F.col("size") >= 8) & ((F.col("size") > largest) | loose)).select("cluster", "size"), "weak")
        done = done.union(left.join(weak, "cluster", "left_anti").select("doc", "cluster"))
        if weak.isEmpty():
            return done
        rows = written(ranked(left.join(weak, "cluster"), ["cluster"], ["doc"], "rn"), "ranked")
        sides = two_means(rows, vectors)
        n1 = F.sum("side")
        small = sides.groupBy("cluster").agg(n1.alias("n1"), F.count(F.lit(1)).alias("n")).withColumn("small", F.least(F.col("n1"), F.col("n") - F.col("n1")))
        useless = small.select("cluster", ((F.col("small") < 2) | (F.col("small") / F.col("n") < 0.05)).alias("useless"))
        half = (F.col("rn") > F.floor(F.col("size") / 2)).cast("int")
        cut = sides.join(rows.select("doc", "rn", "size"), "doc").join(useless, "cluster").select("doc", "cluster", F.when(F.col("useless"), half).otherwise(F.col("side")).alias("side"))
        left = written(least(written(cut, "cut"), "cluster", "side"), "clusters")


def centroids(labels: DataFrame, vectors: DataFrame) -> DataFrame:
    """(doc, term, w) with clusters as doc: normalized mean vectors."""
    size = labels.where("cluster >= 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    mean = vectors.join(labels.where("cluster >= 0"), "doc").groupBy("cluster", "term").agg(F.sum("w").alias("s")).join(size, "cluster").select(F.col("cluster").alias("doc"), "term", (F.col("s") / F.col("n")).alias("w"))
    return mean.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc"))))


#: Documents of a block of ``cell_pairs``, and terms that are multiplied at once.
BLOCK_DOCS, BLOCK_TERMS = 1000, 2000


def multiplied(rows: pd.DataFrame) -> pd.DataFrame:
    """(a, b, sim), a < b, of the documents (_p, _q, _block, doc, terms, ws) of two blocks that share a term; of one block with itself, if both are it."""
    left, right = rows[rows._block == rows._p.iloc[0]], rows[rows._block == rows._q.iloc[0]]
    if not len(left) or not len(right):
        return pd.DataFrame({"a": rows.doc[:0], "b": rows.doc[:0], "sim": np.zeros(0)})
    sims, shared = np.zeros((len(left), len(right))), np.zeros((len(left), len(right)), bool)
    known, codes = np.unique(np.concatenate([*left.terms, *right.terms]), return_inverse=True)
    cut = sum(map(len, left.terms))
    sides = [(np.repeat(np.arange(len(x)), [len(t) for t in x.terms]), c, np.concatenate([*x.ws, []])) for x, c in ((left, codes[:cut]), (right, codes[cut:]))]
    for first in range(0, len(known), BLOCK_TERMS):
        dense = []
        for (doc, code, w), n in zip(sides, sims.shape, strict=True):
            inside = (code >= first) & (code < first + BLOCK_TERMS)
            held, there = np.zeros((n, BLOCK_TERMS)), np.zeros((n, BLOCK_TERMS), np.float32)
            np.add.at(held, (doc[inside], code[inside] - first), w[inside])
            there[doc[inside], code[inside] - first] = 1
            dense.append((held, there))
        sims += dense[0][0] @ dense[1][0].T
        shared |= dense[0][1] @ dense[1][1].T > 0
    a, b = left.doc.to_numpy(), right.doc.to_numpy()
    i, j = np.nonzero(shared & ((a[:, None] < b[None, :]) if rows._p.iloc[0] == rows._q.iloc[0] else True))
    return pd.DataFrame({"a": np.minimum(a[i], b[j]), "b": np.maximum(a[i], b[j]), "sim": sims[i, j]})


def cell_pairs(vectors: DataFrame) -> DataFrame:
    """(a, b, sim) of all vectors (doc, term, w) that share a term, a < b.

    Every two blocks of documents meet in one cell, where their vectors are multiplied, so no pair is moved and a frequent
    term is no task; each vector goes to as many cells as there are blocks.
    """
    whole = written(vectors.where("term IS NOT NULL").groupBy("doc").agg(F.collect_list(F.struct("term", "w")).alias("x")).select("doc", F.col("x.term").alias("terms"), F.col("x.w").alias("ws")), "whole-vectors")
    blocks = -(-whole.count() // BLOCK_DOCS) or 1
    dealt = whole.withColumn("_block", F.pmod(F.xxhash64("doc"), F.lit(blocks)).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = dealt.select(F.least("_block", "_other").alias("_p"), F.greatest("_block", "_other").alias("_q"), "_block", "doc", "terms", "ws")
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks * (blocks + 1) // 8)
    kind = dict(vectors.dtypes)["doc"]
    return cells.repartition(parts, "_p", "_q").groupBy("_p", "_q").applyInPandas(multiplied, f"a {kind}, b {kind}, sim double")


def centroid_pairs(centres: DataFrame, least: float = 0.0) -> DataFrame:
    """(a, b, sim) of clusters that share a term, a < b; above a limit by ``cosine_pairs``."""
    return cosine_pairs(centres, least) if least > 0 else cell_pairs(centres).where(F.col("sim") >= least)


def greedy_union(pairs: DataFrame, sizes: DataFrame, cap: int) -> DataFrame:
    """(cluster, into) after joining pairs (a, b, sim), most similar first, wherever both sides together have at most ``cap``.

    In every round the pairs go that are the first of both their sides; what came before them
    no longer fits, and sizes only grow, so this is what one pass over all pairs in order
    gives. Rounds are written tables; only their numbers of pairs reach the driver.
    """
    root = written(sizes.where(F.col("n") <= cap).select(F.col("cluster").alias("c"), F.col("cluster").alias("root"), "n"), "roots")
    left = written(pairs.select("a", "b", F.struct((-F.round("sim", 9)).alias("s"), "a", "b").alias("order")), "pairs")
    while True:
        size = root.groupBy("root").agg(F.sum("n").alias("size"))
        known = root.join(size, "root").select("c", "root", "size")
        both = left.join(known.select(F.col("c").alias("a"), F.col("root").alias("ra"), F.col("size").alias("na")), "a").join(known.select(F.col("c").alias("b"), F.col("root").alias("rb"), F.col("size").alias("nb")), "b")
        open_ = both.where((F.col("ra") != F.col("rb")) & (F.col("na") + F.col("nb") <= cap))
        left = written(open_.select("a", "b", "order", F.least("ra", "rb").alias("x"), F.greatest("ra", "rb").alias("y")), "pairs")
        if left.isEmpty():
            return root.select(F.col("c").alias("cluster"), F.col("root").alias("into"))
        first = left.select(F.col("x").alias("side"), "order").union(left.select("y", "order")).groupBy("side").agg(F.min("order").alias("first"))
        chosen = left.join(first.select(F.col("side").alias("x"), F.col("first").alias("fx")), "x").join(first.select(F.col("side").alias("y"), F.col("first").alias("fy")), "y")
        joined = chosen.where((F.col("order") == F.col("fx")) & (F.col("order") == F.col("fy"))).select(F.col("y").alias("root"), F.col("x").alias("into"))
        root = written(root.join(joined, "root", "left").select("c", F.coalesce("into", "root").alias("root"), "n"), "roots")
        left = left.select("a", "b", "order")


def morph_merge(labels: DataFrame, vectors: DataFrame, n_docs: int, least: float = 0.92) -> DataFrame:
    """Greedy union of clusters by centroid similarity, most similar first, sizes capped at max(80, 1 %)."""
    sizes = labels.where("cluster >= 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    to = greedy_union(centroid_pairs(centroids(labels, vectors), least), sizes, max(80, int(n_docs * 0.01)))
    return labels.join(to, "cluster", "left").select("doc", F.coalesce("into", "cluster").alias("cluster"))


def settled(labels: DataFrame, tokens: DataFrame, least_size: int = 8, least_cohesion: float = 0.12) -> DataFrame:
    """Single members and incoherent clusters are given up: cluster -1."""
    c = cohesion(labels, tokens).where((F.col("size") == 1) | ((F.col("size") >= least_size) & (F.col("cohesion") < least_cohesion))).select("cluster", F.lit(True).alias("gone"))
    return labels.join(c, "cluster", "left").select("doc", F.when(F.col("gone"), F.lit(-1)).otherwise(F.col("cluster")).alias("cluster"))


def mechanical_labels(labels: DataFrame, tokens: DataFrame) -> DataFrame:
    """(cluster, label): among words in at least 35 % of members the one with most share / ln(2 + df), else the most frequent; ties by word."""
    n = labels.where("cluster >= 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    per = labels.where("cluster >= 0").join(tokens.distinct(), "doc").groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("c")).join(n, "cluster").join(document_frequency(tokens), "term")
    share = F.col("c") / F.col("n")
    order = F.struct((share >= 0.35).alias("ok"), F.when(share >= 0.35, F.round(share / F.log(2.0 + F.col("df")), 9)).otherwise(F.col("c").cast("double")).alias("s"))
    best = per.withColumn("o", order).withColumn("rn", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("o"), "term"))).where("rn = 1").select("cluster", F.col("term").alias("label"))
    return n.join(best, "cluster", "left").select("cluster", F.coalesce("label", F.lit("cluster")).alias("label"))


def profiles(labels: DataFrame, tokens: DataFrame, names: DataFrame, n_docs: int) -> DataFrame:
    """Per cluster: label, size, pct, cohesion, top_tokens (8), examples (5, cut at 90 characters). names: (doc, name)."""
    inside = labels.where("cluster >= 0")
    top = inside.join(tokens.distinct(), "doc").groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("c"))
    top = top.withColumn("rn", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("c"), "term"))).where("rn <= 8").groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "term"))), lambda x: x["term"]), ",").alias("top_tokens"))
    some = inside.join(names, "doc").withColumn("rn", F.row_number().over(Window.partitionBy("cluster").orderBy("doc"))).where("rn <= 5").groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.substring("name", 1, 90).alias("name")))), lambda x: x["name"]), "|").alias("examples"))
    out = cohesion(labels, tokens).join(mechanical_labels(labels, tokens), "cluster").join(top, "cluster", "left").join(some, "cluster", "left")
    return out.select("cluster", "label", "size", F.round(100.0 * F.col("size") / n_docs, 1).alias("pct"), F.round("cohesion", 4).alias("cohesion"), "top_tokens", "examples")


#: The beginnings of product types by which a run is judged.
PROBES = ("mascher", "camice", "fresa", "frese", "bracket", "denti", "gutta", "guant", "corone", "siring")


def probes(names: DataFrame, labels: DataFrame, titles: DataFrame, stems=PROBES, least: int = 3) -> DataFrame:
    """Per stem that at least ``least`` names (doc, norm) hold: n, the share without a cluster, its largest cluster's label and share.

    Of clusters of one size the smallest counts. titles: (cluster, label).
    """
    found = names.select("doc", F.explode(F.filter(F.array(*map(F.lit, stems)), lambda s: F.col("norm").contains(s))).alias("stem"))
    per = found.join(labels.select("doc", "cluster"), "doc").groupBy("stem", "cluster").agg(F.count(F.lit(1)).alias("c")).join(titles, "cluster", "left")
    typed = F.col("cluster") >= 0
    top = F.max(F.when(typed, F.struct("c", (-F.col("cluster")).alias("k"), "label")))
    whole = per.groupBy("stem").agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(~typed, F.col("c"))), F.lit(0)).alias("brand"), top.alias("top")).where(F.col("n") >= least)
    share = lambda c: F.round(100.0 * F.coalesce(c, F.lit(0)) / F.col("n"), 1)
    return whole.select("stem", "n", share(F.col("brand")).alias("in_brand_pct"), F.col("top.label").alias("top_cluster_label"), share(F.col("top.c")).alias("top_cluster_pct"))


def summary(profile: DataFrame, n_docs: int) -> DataFrame:
    n = F.col("size")
    return profile.agg(F.count_if(n >= 25).alias("solid"), F.count_if((n >= 8) & (n < 25)).alias("medium"), F.count_if((n >= 2) & (n < 8)).alias("small"), F.count_if(F.col("cohesion") >= 0.25).alias("homogeneous"), F.round(100.0 * F.coalesce(F.sum(n), F.lit(0)) / n_docs, 1).alias("coverage_pct"))


def cluster_names(docs: DataFrame, tokens: DataFrame, grams: DataFrame, n_docs: int, eps: float = 0.26, merge: float = 0.92, least: int = 5) -> DataFrame:
    """The whole run: DBSCAN on words, splits, merge on character grams, clean-up. (doc, cluster)."""
    words = written(tfidf(tokens, n_docs, 900, 3), "words")
    labels = written(dbscan(docs, tokens, words, n_docs, eps, least), "labels")
    labels = written(split_weak(labels, words, tokens, n_docs), "split")
    labels = written(morph_merge(labels, tfidf(grams, n_docs, 1200, 5), n_docs, merge), "merged")
    return settled(labels, tokens)
