"""Operators against plain Python on small fixtures."""

from __future__ import annotations

import random
import unicodedata

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerloom.functions import answers, shuffle, teeth
from offerloom.functions import names as N
from offerloom.functions import scalar as X
from offerloom.operators import clustering as C
from offerloom.operators import graph, matching, mutate
from offerloom.operators import relational as R
from offerloom.sources import files as S


def roots(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [tuple(rng.sample(range(80), 2)) for _ in range(50)] + [(7, 7)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots([e for e in edges if e[0] != e[1]])
    assert got == want
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_grams(s):
    p = f"  {s} "
    return {p[i : i + 3] for i in range(len(p) - 2)} if s else set()


def test_edges_against_all_pairs(spark):
    rng = random.Random(5)
    words = ["lima", "fresa", "écru", "blu", "conica", "set", "grande", "n10"]
    rows = [(i, f"shop{rng.randint(0, 3)}", " ".join(rng.choices(words, k=rng.randint(0, 4)))) for i in range(120)]
    norm = lambda s: " ".join("".join(c if c.isalnum() else " " for c in unicodedata.normalize("NFKD", s).lower()).split())
    products = spark.createDataFrame(rows, "id long, shop string, name string").withColumn("norm", N.normal_spaced(F.col("name")))
    assert {r.id: r.norm for r in products.collect()} == {i: norm(n) for i, _, n in rows}
    got = {(r.a, r.b): round(r.score, 6) for r in matching.edges(products).collect()}
    want = {}
    for i, s, n in rows:
        for j, s2, n2 in rows:
            a, b = plain_grams(norm(n)), plain_grams(norm(n2))
            if i < j and s != s2 and a and b and 2 * len(a & b) / (len(a) + len(b)) >= 0.7:
                want[i, j] = round(2 * len(a & b) / (len(a) + len(b)), 6)
    assert got == want


def test_clusters_have_one_offer_per_shop(spark):
    rows = [(1, "a", "Fresa conica"), (2, "b", "fresa conica"), (3, "b", "fresa conica x"), (4, "c", "FRESA CONICA"), (5, "a", "lima"), (6, "b", "LIMA"), (7, "c", "altro")]
    products = spark.createDataFrame(rows, "id long, shop string, name string").withColumn("norm", N.normal_spaced(F.col("name")))
    got = sorted(matching.match(products).collect(), key=lambda r: r.component)
    assert [r.product_ids for r in got] == [["1", "2", "4"], ["5", "6"]]
    assert got[0].title.endswith("confronto prezzi su 3 shop") and got[1].title.endswith("a vs b") and got[1].slug == "lima"


def test_slugs(spark):
    rows = [(i, b) for i, b in enumerate(["x", "x", "x", "x-2", "y", "y", "x-2"])]
    got = [r.slug for r in R.unique_slugs(spark.createDataFrame(rows, "id int, base string"), "base", ["id"]).orderBy("id").collect()]
    assert got[:4] == ["x", "x-3", "x-4", "x-2"] and got[4:6] == ["y", "y-2"] and len(set(got)) == len(got)


def test_change_points_rebuild_the_series(spark):
    rng = random.Random(2)
    rows = [(k, d, rng.choice([1, 2, None])) for k in range(6) for d in range(15)]
    kept = {(r.k, r.d): r.v for r in R.change_points(spark.createDataFrame(rows, "k int, d int, v int"), ["k"], [F.col("d")], ["v"]).collect()}
    last = {}
    for k, d, v in rows:
        last[k] = kept.get((k, d), last.get(k)) if (k, d) in kept else last[k]
        assert last[k] == v


def test_numbered_and_paged(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(4).sample(range(1000), 300)], "k int")
    got = R.numbered(df, "k", 7).orderBy("k").collect()
    assert [r.place for r in got] == list(range(300))
    assert R.numbered(df.limit(0), "k").count() == 0
    pages = R.paged([df, df], "k", size=100, most=5).groupBy("chunk").count().orderBy("chunk").collect()
    assert [tuple(r) for r in pages] == [(i, 100) for i in range(5)]


def test_numbering_many_rows_with_further_columns(spark):
    n = 2_000_000
    df = spark.range(n, numPartitions=7).select(F.pmod(F.xxhash64("id"), F.lit(n // 2)).alias("k"), F.md5(F.col("id").cast("string")).alias("more"))
    out = R.written(R.numbered(df, "k"), "numbered")
    places = out.agg(F.count(F.lit(1)), F.countDistinct("place"), F.min("place"), F.max("place")).first()
    assert tuple(places) == (n, n, 0, n - 1)
    assert out.groupBy((F.col("place") / 1000).cast("int").alias("c")).agg(F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("c").select((F.col("lo") >= F.lag("hi").over(Window.orderBy("c"))).alias("ok")).where("NOT ok").count() == 0
    hot = R.numbered(df.withColumn("k", F.lit(1)), "k", 16)
    assert hot.agg(F.countDistinct("place")).first()[0] == n


def test_chunk_count():
    assert [R.chunk_count(n) for n in (0, 1, 10_000, 10_001, 10**7)] == [32, 1, 1, 2, 32]


def test_fold(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    changes = spark.createDataFrame([(1, "c", 1, "UPDATE"), (2, "b", 2, "DELETE"), (3, "d", 3, "INSERT"), (1, "e", 4, "UPDATE")], "id int, v string, n int, op string")
    assert sorted(map(tuple, mutate.fold(old, changes, "id", [F.desc("n")]).collect())) == [(1, "e"), (3, "d")]


def test_upsert_with_nulls(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, f int")
    new = spark.createDataFrame([(1, None, 9), (3, "c", 9)], "id int, v string, f int")
    assert sorted(map(tuple, mutate.upsert(old, new, ["id"], keep_old=["f"]).collect())) == [(1, None, 1), (2, "b", 1), (3, "c", 9)]


def test_shuffle():
    items = list("abcdefgh")
    assert sorted(shuffle.shuffled(items, "s")) == items and shuffle.shuffled(items, "s") == shuffle.shuffled(items, "s") != shuffle.shuffled(items, "t")
    assert shuffle.fnv1a("") == 2166136261 and shuffle.fnv1a("a") == 0xE40C292C


def test_answers():
    text = "TAG:\n#[nome tag]\nDESCRIZIONE:\n" + "x" * 50 + "\nTAG:\n#[Lime Endo] #[lime-endo] #[tag]\nFAQ:\nD1: Una domanda lunga?\nR1: Una risposta lunga abbastanza.\nD2: breve\nR2: no\nFINE"
    assert answers.tags(text) == ["lime endo"] and answers.description(text) == "x" * 50
    assert answers.questions(text) == [("Una domanda lunga?", "Una risposta lunga abbastanza.")]
    assert answers.tags(None) == [] and answers.description(None) == "" and answers.questions("") == []
    assert answers.tags("so #bello e #Alto qui") == ["bello e", "alto qui"]


def test_teeth():
    rows = teeth.rows()
    assert len(rows) == 32 and {r[1] for r in rows} == {str(i) for i in range(1, 33)}
    by = {r[0]: r for r in rows}
    assert by["18"][1] == "1" and by["17"][1] == "2" and by["18"][6] == "Terzo molare superiore destro" and by["38"][1] == "17" and by["48"][1] == "32"


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert str(one(X.price(F.lit("1.234,56 €")))) == "1234.56" and one(X.price(F.lit("n/d"))) is None and str(one(X.price(F.lit("5.63")))) == "5.63"
    assert one(X.shop_price(F.lit("1.234,5 €"))) == 1234.5
    assert str(one(X.italian_date(F.lit("15 Luglio 2026")))) == "2026-07-15" and one(X.italian_date(F.lit("31 febbraio 2026"))) is None and str(one(X.italian_date(F.lit("5/7/2026")))) == "2026-07-05"
    assert one(X.path_date(F.lit("/a/12024-01-02/2024-03-04.csv"))) == "2024-03-04"
    assert one(X.asset_type(F.lit("Nuova scheda di sicurezza (it)"))) == "sds" and one(X.asset_type(F.lit("?"))) == "other"
    assert one(X.euro(F.lit(123456))) == "1.234,56 €"
    assert one(N.slug(F.lit("  Écru & Bleu -- 10  "))) == "ecru-bleu-10" and one(N.slug(F.lit("!!"))) == "doc"
    assert one(N.display_name(F.lit(" FRESA 10 "))) == "Fresa 10" and one(N.display_name(F.lit("Fresa X"))) == "Fresa X" and one(N.display_name(F.lit("  "))) == "Prodotto"
    assert one(F.array_join(S.page_plan(F.lit("3,1, 3,x")).cast("array<string>"), ",")) == "1,3"


def test_payload():
    assert S.balanced('f({"a": "}", "b": {"c": 1}}, 2)', "f(") == '{"a": "}", "b": {"c": 1}}' and S.balanced("g()", "f(") is None and S.balanced("f({", "f(") is None


def test_dbscan_and_split(spark):
    docs = {i: ["alfa", "beta", f"x{i}"] for i in range(6)} | {i: ["gamma", "delta", f"y{i}"] for i in range(10, 16)} | {20: ["solo"]}
    tokens = spark.createDataFrame([(d, t) for d, ts in docs.items() for t in ts], "doc long, term string")
    ids = spark.createDataFrame([(d,) for d in docs], "doc long")
    vectors = C.tfidf(tokens, len(docs), 900, 2)
    labels = C.dbscan(ids, tokens, vectors, len(docs), least=5, least_df=2, most_share=0.6)
    got = {r.doc: r.cluster for r in labels.collect()}
    assert got == {d: 0 if d < 6 else 10 if d < 16 else -1 for d in docs}
    merged = labels.withColumn("cluster", F.when(F.col("cluster") >= 0, 0).otherwise(-1).cast("long"))
    parts = {r.doc: r.cluster for r in C.split_weak(merged, vectors, tokens, len(docs), least_size=8, least_cohesion=0.4).collect()}
    assert len({parts[i] for i in range(6)}) == 1 and len({parts[i] for i in range(10, 16)}) == 1 and parts[0] != parts[10] and parts[20] == -1


def test_greedy_union_is_one_pass_in_order(spark):
    from offerloom.operators import clustering as C

    rng = random.Random(12)
    size = {c: rng.randint(1, 30) for c in range(40)}
    pairs = [(a, b, round(rng.uniform(0.9, 1), 3)) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.15]
    parent, total = {c: c for c in size}, dict(size)

    def find(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for a, b, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        x, y = sorted((find(a), find(b)))
        if x != y and total[x] + total[y] <= 80:
            parent[y] = x
            total[x] += total[y]
    got = C.greedy_union(spark.createDataFrame(pairs, "a long, b long, sim double"), spark.createDataFrame(list(size.items()), "cluster long, n long"), 80)
    assert {r.cluster: r["into"] for r in got.collect()} == {c: find(c) for c in size}


def test_queue_gives_each_task_once(spark, tmp_path):
    from offerloom.operators import work

    path = f"file://{tmp_path}/queue"
    work.build(spark.createDataFrame([(1, "a"), (2, ""), (3, "c"), (4, "d"), (None, "x")], "id long, name string"), path)
    one = sorted(r.id for r in work.claim(spark, path, "w1", 2).collect())
    two = [r.id for r in work.claim(spark, path, "w2", 2).collect()]
    assert (one, two) == ([1, 3], [4]) and work.claim(spark, path, "w1").count() == 0
    work.finish(spark, path, spark.createDataFrame([(1, True), (3, False), (9, True)], "id long, ok boolean"))
    assert {r.status: r.n for r in work.counts(work.latest(spark, path)[1]).collect()} == {"done": 1, "claimed": 1, "failed": 3}
    work.build(spark.createDataFrame([(7, "g")], "id long, name string"), path)
    assert [r.id for r in work.claim(spark, path, "w1").collect()] == [7] and len(work.versions(spark, path)) == 7


def test_clusters_by_name_classes_are_those_of_the_edges(spark, small):
    from offerloom.operators import matching as M
    from offerloom.queries.matching import products
    from offerloom.registry import Tables

    own = products(Tables(spark, small))
    rng = random.Random(5)
    some = [r.norm for r in own.collect()][:12]
    more = [(1000 + i, f"shop{rng.randrange(4)}", n, 100, n) for i, n in enumerate(rng.choices(some, k=60))]
    for rows in (own, own.unionByName(spark.createDataFrame(more, own.schema))):
        links = M.edges(rows)
        want = M.described(M.clusters(rows, links), links)
        got = M.match(rows)
        assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_a_popular_name_makes_no_pairs(spark):
    from offerloom.operators import matching as M

    rows = [(i, f"s{i % 3}", "guanti in lattice", 1, "guanti in lattice") for i in range(6000)]
    got = M.match(spark.createDataFrame(rows, "id long, shop string, name string, price int, norm string")).collect()
    assert len(got) == 1 and got[0].members == 3 and got[0].product_ids == ["5997", "5998", "5999"]


def test_cosine_pairs_against_all_pairs(spark):
    from offerloom.operators import clustering as C

    rng = random.Random(7)
    docs = {}
    for d in range(80):
        terms = {rng.choice("abcdefghijklmnopqrstuvwxyz"): rng.random() + 0.1 for _ in range(rng.randint(1, 8))} | {"common": rng.random()}
        norm = sum(w * w for w in terms.values()) ** 0.5
        docs[d] = {t: w / norm for t, w in terms.items()}
    df = spark.createDataFrame([(d, t, w) for d, v in docs.items() for t, w in v.items()], "doc long, term string, w double")
    for least in (0.3, 0.74, 0.92):
        want = {(a, b) for a in docs for b in docs if a < b and sum(w * docs[b].get(t, 0) for t, w in docs[a].items()) >= least}
        assert {(r.a, r.b) for r in C.cosine_pairs(df, least).collect()} == want


def test_dbscan_against_a_plain_run(spark):
    from offerloom.operators import clustering as C

    rng = random.Random(8)
    bases = [rng.sample([f"t{i}" for i in range(60)], 5) for _ in range(12)]
    docs = {d: list(dict.fromkeys(rng.sample(bases[d % 12], rng.randint(3, 5)) + ([f"t{rng.randrange(60)}"] if rng.random() < 0.4 else []))) for d in range(120)}
    tokens = spark.createDataFrame([(d, t) for d, ts in docs.items() for t in ts], "doc long, term string")
    vectors = C.written(C.tfidf(tokens, 120, 900, 1), "v")
    v = {}
    for r in vectors.collect():
        v.setdefault(r.doc, {})[r.term] = r.w
    df = {t: sum(t in ts for ts in docs.values()) for ts in docs.values() for t in ts}
    keys = {t for t, n in df.items() if 5 <= n <= 0.2 * 120}
    near = {d: set() for d in docs}
    for a in docs:
        for b in docs:
            sim = sum(w * v[b].get(t, 0) for t, w in v[a].items())
            shared = len(set(docs[a]) & set(docs[b]) & keys)
            if a != b and ((shared >= 2 and sim >= 0.74) or (shared >= 1 and sim >= 0.84)):
                near[a].add(b)
    core = {d for d in docs if len(near[d]) + 1 >= 5}
    want = {}
    for d in sorted(core):
        if d not in want:
            todo, seen = [d], {d}
            while todo:
                for n in near[todo.pop()] & core - seen:
                    seen.add(n)
                    todo.append(n)
            want |= dict.fromkeys(seen, min(seen))
    border = {d: want[min(near[d] & core)] for d in docs if d not in core and near[d] & core}
    got = C.dbscan(spark.createDataFrame([(d,) for d in docs], "doc long"), tokens, vectors, 120, most_share=0.2)
    assert {r.doc: r.cluster for r in got.collect()} == {d: want.get(d, border.get(d, -1)) for d in docs}


def test_stop_grams_of_few_pages(spark, tmp_path):
    import offerloom.queries  # noqa: F401  (registers)
    from offerloom.registry import QUERIES

    titles = ["abcd"] * 4 + ["abx"] * 3 + ["Ábx"] + [f"{k}" for k in range(11)] + [None]  # 3 of 20 are no more than 15 %
    rows = [(k, f"https://shop{k % 3}.it/p/{k}", t and f"<title>{t}</title>") for k, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    got = {r.gram: r.df for r in QUERIES["j_06_stop_grams"](spark, f"file://{tmp_path}").collect()}
    assert got == {"  a": 8, " ab": 8, "abc": 4, "bcd": 4, "cd ": 4, "abx": 4, "bx ": 4}
