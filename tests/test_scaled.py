"""Operators whose hot keys are cut: against plain versions on random tables, and on one key with very many rows."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from offerloom.functions import shuffle
from offerloom.operators import matching as M
from offerloom.operators import relational as R


def plain_redirects(inactive, active):
    def clusters(rows):
        out = {}
        for slug, score, shop, id_ in rows:
            shops, ids, scores = out.setdefault(slug, (set(), set(), []))
            shops.add(shop)
            ids.add(id_)
            scores.append(score)
        return out

    there = clusters(active)
    for slug, (shops, ids, _) in clusters(inactive).items():
        if len(shops) >= 2 and (met := [(-len(ids & i), -max(s), len(t), target) for target, (t, i, s) in there.items() if shops <= t]):
            yield slug, min(met)[3], -min(met)[0]


def test_redirects_against_a_plain_run(spark):
    rng = random.Random(4)
    schema = "slug string, score double, shop string, id long"
    for shops, clusters in ((6, 30), (12, 60)):
        made = lambda mark: [(f"{mark}{rng.randrange(clusters)}", rng.choice([0.5, 0.7, 0.9]), f"s{rng.randrange(shops)}", rng.randrange(80)) for _ in range(clusters * 4)]
        gone, here = made("g"), made("h")
        got = M.redirects(spark.createDataFrame(gone, schema), spark.createDataFrame(here, schema))
        assert sorted(map(tuple, got.collect())) == sorted(plain_redirects(gone, here))


def test_a_hundred_thousand_clusters_share_a_shop(spark):
    n = 100_000
    pair = F.explode(F.array(F.lit("everywhere"), F.concat(F.lit("s"), (F.col("id") % 20_000).cast("string"))))
    gone = spark.range(n).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("slug"), F.lit(0.8).alias("score"), pair.alias("shop"), (-1 - F.col("id")).alias("id"))
    here = spark.range(n).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("slug"), (F.col("id") % 7 / 10).alias("score"), pair.alias("shop"), F.col("id"))
    began = time.time()
    row = M.redirects(gone, here).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("target").alias("targets"), F.sum("shared").alias("shared")).first()
    assert (row.n, row.targets, row.shared) == (n, 20_000, 0) and time.time() - began < 120


def plain_slugs(rows):
    taken, used = {b for _, b in rows}, {}
    for i, base in sorted(rows):
        k = used.get(base, 0) + 1
        if k > 1:
            while f"{base}-{k}" in taken:
                k += 1
        used[base] = k
        yield i, base if k == 1 else f"{base}-{k}"


def test_slugs_against_a_plain_run(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["x", "x", "x", "y", "y-2", "x-0", "x-1"]) if rng.random() < 0.9 else f"x-{rng.randrange(2, 60)}") for i in range(400)]
    got = R.unique_slugs(spark.createDataFrame(rows, "id int, base string"), "base", ["id"]).select("id", "slug")
    assert sorted(map(tuple, got.collect())) == sorted(plain_slugs(rows))


def test_slugs_of_a_million_rows_of_one_base(spark):
    n = 1_000_000
    rows = spark.range(n).select("id", F.lit("x").alias("base")).union(spark.range(n, n + 1000).select("id", F.concat(F.lit("x-"), (2 + 3 * (F.col("id") - n)).cast("string"))))
    began = time.time()
    slugs = R.unique_slugs(rows, "base", ["id"]).agg(F.countDistinct("slug"), F.max(F.when(F.col("id") < n, F.regexp_extract("slug", r"(\d*)$", 1)).try_cast("long")), F.count_if(F.col("slug") == "x")).first()
    assert tuple(slugs) == (n + 1000, n + 1000, 1) and time.time() - began < 120


def test_shuffle_is_the_sequential_one(spark):
    rng = random.Random(9)
    lists = {s: [f"{rng.randrange(10**6):06d}" for _ in range(n)] for s, n in (("", 1), ("a", 2), ("seme", 40), ("é", 700), ("z", 5000))}
    df = spark.createDataFrame([(s, x) for s, items in lists.items() for x in items], "seed string, item string")
    for scaled in (False, True):
        got = {}
        for r in shuffle.seeded_shuffle(df, scaled).collect():
            got.setdefault(r.seed, {})[r.place] = r.item
        assert {s: [p[k] for k in range(len(p))] for s, p in got.items()} == {s: shuffle.shuffled(sorted(x), s, scaled) for s, x in lists.items()}


def test_shuffle_of_one_long_list(spark):
    n = 200_000
    got = shuffle.seeded_shuffle(spark.range(n).select(F.lit("one").alias("seed"), F.format_string("%07d", "id").alias("item")))
    want = spark.createDataFrame(list(enumerate(shuffle.shuffled([f"{i:07d}" for i in range(n)], "one"))), "place long, item string")
    assert got.join(want, ["place", "item"]).count() == got.count() == n
