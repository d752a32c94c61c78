"""Matching and clustering. Products are the pages: the host is the shop, the title the name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names as N
from ..operators import clustering as C
from ..operators import graph as G
from ..operators import matching as M
from ..operators.basket import inline_choice
from ..operators.search import Catalog
from ..registry import Tables, query, written
from ..sources.adapters import with_sql

PRODUCT_SQL = r"""product AS (SELECT page_id AS id, lower(regexp_extract(url, '//([^/:]*)', 1)) AS shop, regexp_extract(html, '<title>([^<]*)</title>', 1) AS name, page_id % 97 + 100 AS price FROM pages),
normed AS (SELECT *, trim(regexp_replace(lower(strip_accents(name)), '\s+', ' ', 'g')) AS norm FROM product),
gram AS (SELECT DISTINCT id, shop, price, substr('  ' || norm || ' ', CAST(unnest(range(1, length(norm) + 2)) AS INTEGER), 3) AS gram FROM normed WHERE length(norm) > 0),
size AS (SELECT id, any_value(shop) AS shop, count(*) AS n FROM gram GROUP BY 1)"""
PAIR_SQL = """pair AS (SELECT x.id AS a, y.id AS b, count(*) AS shared, any_value(sx.n) AS size_a, any_value(sy.n) AS size_b FROM gram x JOIN gram y ON x.gram = y.gram AND x.id < y.id AND x.shop <> y.shop JOIN size sx ON sx.id = x.id JOIN size sy ON sy.id = y.id GROUP BY 1, 2)"""
LINK_SQL = "link AS (SELECT a, b, 2.0 * shared / (size_a + size_b) AS score FROM pair WHERE 2.0 * shared / (size_a + size_b) >= 0.7)"
#: Labels spread until they stop: each step keeps only what improves, so the recursion ends.
COMPONENT_SQL = "ends AS (SELECT a, b FROM link UNION SELECT b, a FROM link), reach(node, root) AS (SELECT a, a FROM ends UNION SELECT e.b, r.root FROM reach r JOIN ends e ON e.a = r.node WHERE r.root < e.b), label AS (SELECT node, least(node, min(root)) AS component FROM reach GROUP BY node)"


def products(t: Tables) -> DataFrame:
    name = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    rows = t.pages.select(F.col("page_id").alias("id"), F.lower(F.regexp_extract("url", "//([^/:]*)", 1)).alias("shop"), name.alias("name"), (F.col("page_id") % 97 + 100).alias("price"))
    return written(rows.withColumn("norm", N.normal_plain(F.col("name"))), "products")


def with_grams(p: DataFrame) -> DataFrame:
    return p.withColumn("grams", N.trigrams(F.col("norm")))


@query("x_02_normal_plain", with_sql(PRODUCT_SQL) + "SELECT id, norm FROM normed")
def _(t: Tables) -> DataFrame:
    return products(t).select("id", "norm")


@query("x_03_name_norm", "SELECT n_nationkey, lower(strip_accents(coalesce(n_name, ''))) AS name_norm FROM nation")
def _(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", N.normal_plain(F.coalesce("n_name", F.lit(""))).alias("name_norm"))


@query("x_04_trigrams", with_sql(PRODUCT_SQL) + "SELECT id, CAST(count(*) AS INTEGER) AS n, string_agg(gram, '|' ORDER BY gram) AS grams FROM gram GROUP BY 1")
def _(t: Tables) -> DataFrame:
    g = with_grams(products(t)).where("size(grams) > 0")
    return g.select("id", F.size("grams").alias("n"), F.array_join(F.array_sort("grams"), "|").alias("grams"))


@query("x_05_packed_trigrams", with_sql(PRODUCT_SQL) + "SELECT id, gram, ((ord(substr(gram, 1, 1))::BIGINT << 21) | (ord(substr(gram, 2, 1))::BIGINT << 10) | (ord(substr(gram, 3, 1))::BIGINT & 1023)) & 4294967295 AS packed FROM gram")
def _(t: Tables) -> DataFrame:
    return with_grams(products(t)).select("id", F.explode("grams").alias("gram")).select("id", "gram", N.packed_trigram(F.col("gram")).alias("packed"))


@query("j_05_gram_pairs", with_sql(PRODUCT_SQL, PAIR_SQL) + "SELECT * FROM pair WHERE shared >= 3")
def _(t: Tables) -> DataFrame:
    return M.gram_pairs(with_grams(products(t)), 3)


STOP_SQL = r"""label AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_type) AS norm FROM part),
gram AS (SELECT DISTINCT id, substr('  ' || norm || ' ', CAST(unnest(range(1, length(norm) + 2)) AS INTEGER), 3) AS gram FROM label)"""


@query("j_06_stop_grams", with_sql(PRODUCT_SQL, "stops AS (SELECT gram, count(*) AS df FROM gram GROUP BY 1 HAVING count(*) > 0.15 * (SELECT count(*) FROM product))") + "SELECT gram, df FROM stops")
def _(t: Tables) -> DataFrame:
    """Grams of product names that are too frequent to pair by, over all pages and without a floor."""
    return M.frequent_grams(with_grams(products(t)))


@query("j_06_part_stops", with_sql(STOP_SQL) + "SELECT gram, count(*) AS df FROM gram GROUP BY 1 HAVING count(*) > (SELECT greatest(ceil(0.15 * count(*)), 500) FROM part)")
def _(t: Tables) -> DataFrame:
    """Grams of names and types of parts that are too frequent to pair by; below 3334 parts the floor of 500 rules."""
    return M.stop_grams(t.part.select("p_partkey", N.trigrams(F.lower(F.concat_ws(" ", "p_name", "p_type"))).alias("grams")).withColumnRenamed("p_partkey", "id"))


@query("x_06_dice", with_sql(PRODUCT_SQL, PAIR_SQL) + "SELECT a, b, round(2.0 * shared / (size_a + size_b), 6) AS dice FROM pair WHERE 2.0 * shared / (size_a + size_b) >= 0.4")
def _(t: Tables) -> DataFrame:
    return M.edges(products(t), 0.4).select("a", "b", F.round("score", 6).alias("dice"))


def links(t: Tables) -> DataFrame:
    return written(M.edges(products(t)), "links")


@query("g_01_edges", with_sql(PRODUCT_SQL, PAIR_SQL, LINK_SQL) + "SELECT a, b, round(score, 6) AS score FROM link")
def _(t: Tables) -> DataFrame:
    return links(t).select("a", "b", F.round("score", 6).alias("score"))


@query("g_02_components", with_sql(PRODUCT_SQL, PAIR_SQL, LINK_SQL, COMPONENT_SQL) + "SELECT node, component FROM label")
def _(t: Tables) -> DataFrame:
    return G.connected_components(links(t))


MEMBER_SQL = """mean AS (SELECT id, round(avg(score), 9) AS mean_score FROM (SELECT a AS id, score FROM link UNION ALL SELECT b, score FROM link) GROUP BY 1),
picked AS (SELECT l.component, p.id, p.shop, p.name, p.norm, m.mean_score FROM label l JOIN normed p ON p.id = l.node JOIN mean m ON m.id = p.id QUALIFY row_number() OVER (PARTITION BY l.component, p.shop ORDER BY m.mean_score DESC, p.id DESC) = 1),
member AS (SELECT *, count(*) OVER (PARTITION BY component) AS members FROM picked QUALIFY members >= 2)"""


@query("w_14_one_per_shop", with_sql(PRODUCT_SQL, PAIR_SQL, LINK_SQL, COMPONENT_SQL, MEMBER_SQL) + "SELECT component, id, shop, members FROM member")
def _(t: Tables) -> DataFrame:
    p = products(t)
    return M.clusters(p, M.edges(p)).select("component", "id", "shop", "members")


@query("a_10_mean_edge", with_sql(PRODUCT_SQL, PAIR_SQL, LINK_SQL, COMPONENT_SQL, MEMBER_SQL) + "SELECT id, round(mean_score, 6) AS mean_score FROM mean")
def _(t: Tables) -> DataFrame:
    e = links(t)
    return e.select(F.col("a").alias("id"), "score").union(e.select(F.col("b").alias("id"), "score")).groupBy("id").agg(F.round(F.avg("score"), 6).alias("mean_score"))


@query("a_11_cluster_score", with_sql(PRODUCT_SQL, PAIR_SQL, LINK_SQL, COMPONENT_SQL, MEMBER_SQL) + "SELECT x.component, any_value(x.members) AS members, round(max(l.score), 4) AS score FROM link l JOIN member x ON x.id = l.a JOIN member y ON y.id = l.b AND y.component = x.component GROUP BY 1")
def _(t: Tables) -> DataFrame:
    p = products(t)
    e = written(M.edges(p), "links")
    return M.described(M.clusters(p, e), e).select("component", "members", "score")


@query("w_15_canonical", with_sql(PRODUCT_SQL, PAIR_SQL, LINK_SQL, COMPONENT_SQL, MEMBER_SQL) + "SELECT component, arg_min(CASE WHEN upper(trim(name)) = trim(name) AND regexp_matches(name, '[a-zA-Z]') THEN upper(substr(trim(name), 1, 1)) || lower(substr(trim(name), 2)) ELSE trim(name) END, lpad(CAST(1000 - length(trim(name)) AS VARCHAR), 4, '0') || norm) AS canonical_name FROM member GROUP BY 1")
def _(t: Tables) -> DataFrame:
    p = products(t)
    return M.clusters(p, M.edges(p)).groupBy("component").agg(M.canonical(F.col("name"), F.col("norm")).alias("canonical_name"))


@query("g_01_matcher")
def _(t: Tables) -> DataFrame:
    p = products(t).withColumn("norm", N.normal_spaced(F.col("name")))
    return M.match(p).withColumn("product_ids", F.array_join("product_ids", ","))


REDIRECT_SQL = """mem AS (SELECT 'c' || component AS slug, component, id, shop, mean_score AS score FROM member), gone AS (SELECT * FROM mem WHERE component % 2 = 0),
need AS (SELECT slug, count(DISTINCT shop) AS need FROM gone GROUP BY 1 HAVING count(DISTINCT shop) >= 2), have AS (SELECT slug AS target, count(DISTINCT shop) AS shops, max(score) AS score FROM mem GROUP BY 1),
cover AS (SELECT g.slug, m.slug AS target, count(DISTINCT g.shop) AS common FROM gone g JOIN mem m ON m.shop = g.shop GROUP BY 1, 2), both_ AS (SELECT g.slug, m.slug AS target, count(DISTINCT g.id) AS shared FROM gone g JOIN mem m ON m.id = g.id GROUP BY 1, 2)"""


@query("j_09_redirect_targets", with_sql(PRODUCT_SQL, PAIR_SQL, LINK_SQL, COMPONENT_SQL, MEMBER_SQL, REDIRECT_SQL) + "SELECT slug, target, coalesce(shared, 0) AS shared FROM cover JOIN need USING (slug) JOIN have USING (target) LEFT JOIN both_ USING (slug, target) WHERE common = need QUALIFY row_number() OVER (PARTITION BY slug ORDER BY coalesce(shared, 0) DESC, score DESC, shops, target) = 1")
def _(t: Tables) -> DataFrame:
    p = products(t)
    e = written(M.edges(p), "links")
    m = written(M.clusters(p, e), "members").select(F.concat(F.lit("c"), F.col("component").cast("string")).alias("slug"), F.col("mean_score").alias("score"), "shop", "id", "component")
    return M.redirects(m.where("component % 2 = 0"), m)


@query("g_09_inline", with_sql(PRODUCT_SQL, PAIR_SQL) + "SELECT a, b AS offer_id FROM (SELECT a, b, b % 97 + 100 AS price, 2.0 * shared / (size_a + size_b) AS sim FROM pair) QUALIFY row_number() OVER (PARTITION BY a ORDER BY (sim >= 0.8) DESC, CASE WHEN sim >= 0.8 THEN price END ASC NULLS LAST, round(sim, 9) DESC, b) = 1")
def _(t: Tables) -> DataFrame:
    p = M.gram_pairs(with_grams(products(t)))
    scored = p.select("a", F.col("b").alias("offer_id"), (F.col("b") % 97 + 100).alias("price"), F.round(2.0 * F.col("shared") / (F.col("size_a") + F.col("size_b")), 9).alias("similarity"))
    return inline_choice(scored, ["a"]).select("a", "offer_id")


ASK_SQL = "ask AS (SELECT item_id AS query_index, trim(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g')) AS norm FROM benchmark), qgram AS (SELECT DISTINCT query_index, substr('  ' || norm || ' ', CAST(unnest(range(1, length(norm) + 2)) AS INTEGER), 3) AS gram FROM ask), qsize AS (SELECT query_index, count(*) AS n FROM qgram GROUP BY 1), found AS (SELECT q.query_index, g.id, any_value(g.price) AS price, 2.0 * count(*) / (any_value(qs.n) + any_value(s.n)) AS similarity FROM qgram q JOIN gram g USING (gram) JOIN qsize qs USING (query_index) JOIN size s ON s.id = g.id GROUP BY ALL)"


def asked(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_index"), N.normal_plain(F.col("text")).alias("norm"))


@query("g_16_trigram_batch", with_sql(PRODUCT_SQL, ASK_SQL) + "SELECT query_index, id, row_number() OVER (PARTITION BY query_index ORDER BY round(similarity, 9) DESC, price, id) AS place FROM found WHERE similarity >= 0.15 QUALIFY place <= 1000")
def _(t: Tables) -> DataFrame:
    return Catalog(products(t)).by_grams(with_grams(asked(t))).select("query_index", "id", "place")


LAYER_SQL = """qtok AS (SELECT query_index, list_distinct(string_split(norm, ' ')) AS w FROM ask), ctok AS (SELECT id, price, norm, list_distinct(string_split(norm, ' ')) AS w FROM normed),
every AS (
  SELECT a.query_index, c.id, c.price, 0 AS layer, 1.0 AS score FROM ask a JOIN normed c USING (norm)
  UNION ALL SELECT q.query_index, c.id, c.price, CASE WHEN len(list_intersect(q.w, c.w)) = len(q.w) THEN 1 WHEN 2 * len(list_intersect(q.w, c.w)) >= len(q.w) THEN 2 ELSE 3 END, len(list_intersect(q.w, c.w)) / len(q.w) FROM qtok q JOIN ctok c ON list_has_any(q.w, c.w)
  UNION ALL SELECT * FROM (SELECT query_index, id, price, 4, similarity FROM found WHERE similarity >= 0.15 QUALIFY row_number() OVER (PARTITION BY query_index ORDER BY similarity DESC, price, id) <= 1000)
), once AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY query_index, id ORDER BY layer) = 1)"""


@query("g_15_layers", with_sql(PRODUCT_SQL, ASK_SQL, LAYER_SQL) + "SELECT query_index, id, layer, round(score, 6) AS score FROM once QUALIFY row_number() OVER (PARTITION BY query_index ORDER BY layer, score DESC, price, id) <= 1000")
def _(t: Tables) -> DataFrame:
    return Catalog(products(t)).layered(asked(t)).select("query_index", "id", "layer", F.round("score", 6).alias("score"))


WORD_SQL = r"word AS (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS term FROM documents), df AS (SELECT term, count(DISTINCT doc) AS df FROM word GROUP BY 1), vocab AS (SELECT * FROM df WHERE df >= 3 ORDER BY df DESC, term LIMIT 900)"


def doc_words(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("doc"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{3,}"), F.lit(0))).alias("term"))


@query("a_07_df", with_sql(WORD_SQL) + "SELECT term, df FROM df")
def _(t: Tables) -> DataFrame:
    return C.document_frequency(doc_words(t))


@query("a_08_vocab", with_sql(WORD_SQL) + "SELECT term, df FROM vocab")
def _(t: Tables) -> DataFrame:
    return C.vocabulary(doc_words(t), 900, 3)


@query("a_09_tfidf", with_sql(WORD_SQL, "raw AS (SELECT w.doc, w.term, count(*) * (ln((1.0 + (SELECT count(*) FROM documents)) / (1 + any_value(v.df))) + 1) AS x FROM word w JOIN vocab v USING (term) GROUP BY ALL)") + "SELECT doc, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc)), 5) AS w FROM raw")
def _(t: Tables) -> DataFrame:
    return C.tfidf(doc_words(t), t.documents.count(), 900, 3).withColumn("w", F.round("w", 5))


TITLE_SQL = PRODUCT_SQL + r", tok AS (SELECT id AS doc, unnest(regexp_extract_all(norm, '[a-z0-9]+')) AS term FROM normed), tdf AS (SELECT term, count(DISTINCT doc) AS df FROM tok GROUP BY 1)"


def title_tokens(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Products, their (doc, term) words, their (doc, term) character grams, and their number."""
    p = products(t)
    words = written(p.select(F.col("id").alias("doc"), F.explode(N.tokens(F.col("norm"))).alias("term")), "tokens")
    grams = p.select(F.col("id").alias("doc"), F.explode(N.char_grams(F.col("norm"))).alias("term"))
    return p, words, grams, p.count()


@query("x_21_tokens", with_sql(TITLE_SQL) + "SELECT doc, count(*) AS n FROM tok WHERE length(term) >= 3 AND term NOT IN (" + ", ".join(f"'{w}'" for w in N.STOP_WORDS) + ") AND NOT regexp_matches(term, '^(?:[0-9]+|x[0-9]+|[0-9]+x[0-9]+|iso|fg|hp|ra|ca|eu|tcr|nfc|slb)$') GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return title_tokens(t)[1].groupBy("doc").agg(F.count(F.lit(1)).alias("n"))


def gram_sql() -> str:
    sizes = " UNION ".join(f"SELECT id, 'c{n}:' || substr(p, CAST(unnest(range(1, length(p) - {n} + 2)) AS INTEGER), {n}) AS g FROM padded" for n in (3, 4, 5))
    return f"SELECT id AS doc, count(*) AS n, string_agg(g, '|' ORDER BY g) AS grams FROM ({sizes}) WHERE NOT regexp_full_match(substr(g, 4), '[0-9 ]*') GROUP BY 1"


@query("x_22_char_grams", with_sql(PRODUCT_SQL, "padded AS (SELECT id, ' ' || regexp_replace(norm, '[^a-z0-9]', ' ', 'g') || ' ' AS p FROM normed)") + gram_sql())
def _(t: Tables) -> DataFrame:
    g = products(t).select(F.col("id").alias("doc"), F.array_distinct(N.char_grams(F.col("norm"))).alias("g")).where("size(g) > 0")
    return g.select("doc", F.size("g").cast("long").alias("n"), F.array_join(F.array_sort("g"), "|").alias("grams"))


@query("j_07_block_pairs", with_sql(TITLE_SQL, "keys AS (SELECT term FROM tdf WHERE df >= 2 AND df <= 0.2 * (SELECT count(*) FROM product)), kt AS (SELECT DISTINCT doc, term FROM tok JOIN keys USING (term))") + "SELECT x.doc AS a, y.doc AS b, count(*) AS shared FROM kt x JOIN kt y ON x.term = y.term AND x.doc < y.doc GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    p = products(t)
    tok = p.select(F.col("id").alias("doc"), F.explode(F.regexp_extract_all("norm", F.lit("[a-z0-9]+"), F.lit(0))).alias("term"))
    return C.block_pairs(tok, p.count(), 2, 0.2)


@query("x_23_cosine", with_sql(TITLE_SQL, "tv AS (SELECT * FROM tdf WHERE df >= 2 ORDER BY df DESC, term LIMIT 900), raw AS (SELECT doc, term, count(*) * (ln((1.0 + (SELECT count(*) FROM product)) / (1 + any_value(v.df))) + 1) AS x FROM tok JOIN tv v USING (term) GROUP BY ALL), vec AS (SELECT doc, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc)) AS w FROM raw)") + "SELECT x.doc AS a, y.doc AS b, round(sum(x.w * y.w), 5) AS sim FROM vec x JOIN vec y ON x.term = y.term AND x.doc < y.doc GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    p = products(t)
    tok = p.select(F.col("id").alias("doc"), F.explode(F.regexp_extract_all("norm", F.lit("[a-z0-9]+"), F.lit(0))).alias("term"))
    return C.centroid_pairs(C.tfidf(tok, p.count(), 900, 2)).withColumn("sim", F.round("sim", 5))


def dbscan_labels(t: Tables) -> tuple:
    p, words, grams, n = title_tokens(t)
    vectors = written(C.tfidf(words, n, 900, 2), "vectors")
    labels = written(C.dbscan(p.select(F.col("id").alias("doc")), words, vectors, n, least=3, least_df=2, most_share=0.2), "labels")
    return p, words, grams, n, vectors, labels


@query("g_03_dbscan")
def _(t: Tables) -> DataFrame:
    return dbscan_labels(t)[-1]


@query("g_04_split")
def _(t: Tables) -> DataFrame:
    _, words, _, n, vectors, labels = dbscan_labels(t)
    return C.split_weak(labels, vectors, words, n, least_size=8, least_cohesion=0.5)


@query("g_05_merge")
def _(t: Tables) -> DataFrame:
    _, _, grams, n, _, labels = dbscan_labels(t)
    return C.morph_merge(labels, C.tfidf(grams, n, 1200, 2), n)


@query("g_06_settle")
def _(t: Tables) -> DataFrame:
    _, words, _, _, _, labels = dbscan_labels(t)
    return C.settled(labels, words)


#: A grouping that SQL can state as well, for the measures of clusters: the host of a page.
HOSTED = "hosted AS (SELECT id AS doc, min(id) OVER (PARTITION BY shop) AS cluster FROM product)"


def hosted(t: Tables) -> DataFrame:
    return products(t).select(F.col("id").alias("doc"), F.min("id").over(Window.partitionBy("shop")).alias("cluster"))


def plain_tokens(t: Tables) -> DataFrame:
    return products(t).select(F.col("id").alias("doc"), F.explode(F.regexp_extract_all("norm", F.lit("[a-z0-9]+"), F.lit(0))).alias("term"))


COHESION_SQL = "sets AS (SELECT doc, list(DISTINCT term) AS w FROM tok GROUP BY 1), numbered AS (SELECT h.cluster, h.doc, coalesce(s.w, []) AS w, row_number() OVER (PARTITION BY h.cluster ORDER BY h.doc) AS rn FROM hosted h LEFT JOIN sets s USING (doc)), jac AS (SELECT a.cluster, avg(len(list_intersect(a.w, b.w)) / greatest(len(list_distinct(list_concat(a.w, b.w))), 1)) AS c FROM numbered a JOIN numbered b ON a.cluster = b.cluster AND a.rn <= 40 AND b.rn <= 40 AND b.rn > a.rn AND b.rn <= a.rn + 7 GROUP BY 1)"


@query("a_13_cohesion", with_sql(TITLE_SQL, HOSTED, COHESION_SQL) + "SELECT h.cluster, count(*) AS size, round(coalesce(any_value(c), 1.0), 6) AS cohesion FROM hosted h LEFT JOIN jac j ON j.cluster = h.cluster GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return C.cohesion(hosted(t), plain_tokens(t)).withColumn("cohesion", F.round("cohesion", 6))


LABEL_SQL = "per AS (SELECT h.cluster, k.term, count(*) AS c, any_value(d.df) AS df FROM hosted h JOIN (SELECT DISTINCT doc, term FROM tok) k USING (doc) JOIN tdf d ON d.term = k.term GROUP BY ALL), num AS (SELECT cluster, count(*) AS n FROM hosted GROUP BY 1)"


@query("a_14_labels", with_sql(TITLE_SQL, HOSTED, LABEL_SQL) + "SELECT cluster, term AS label FROM per JOIN num USING (cluster) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY (c / n >= 0.35) DESC, CASE WHEN c / n >= 0.35 THEN round(c / n / ln(2.0 + df), 9) ELSE c END DESC, term) = 1")
def _(t: Tables) -> DataFrame:
    return C.mechanical_labels(hosted(t), plain_tokens(t))


@query("a_15_profiles", with_sql(TITLE_SQL, HOSTED, COHESION_SQL, LABEL_SQL, """lab AS (SELECT cluster, term AS label FROM per JOIN num USING (cluster) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY (c / n >= 0.35) DESC, CASE WHEN c / n >= 0.35 THEN round(c / n / ln(2.0 + df), 9) ELSE c END DESC, term) = 1),
top AS (SELECT cluster, string_agg(term, ',' ORDER BY c DESC, term) AS top_tokens FROM (SELECT * FROM per QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY c DESC, term) <= 8) GROUP BY 1),
ex AS (SELECT cluster, string_agg(substr(name, 1, 90), '|' ORDER BY doc) AS examples FROM (SELECT h.cluster, h.doc, p.name FROM hosted h JOIN product p ON p.id = h.doc QUALIFY row_number() OVER (PARTITION BY h.cluster ORDER BY h.doc) <= 5) GROUP BY 1),
coh AS (SELECT h.cluster, count(*) AS size, coalesce(any_value(c), 1.0) AS cohesion FROM hosted h LEFT JOIN jac j ON j.cluster = h.cluster GROUP BY 1)""") + "SELECT cluster, coalesce(label, 'cluster') AS label, size, round(100.0 * size / (SELECT count(*) FROM product), 1) AS pct, round(cohesion, 4) AS cohesion, top_tokens, examples FROM coh LEFT JOIN lab USING (cluster) LEFT JOIN top USING (cluster) LEFT JOIN ex USING (cluster)")
def _(t: Tables) -> DataFrame:
    p = products(t)
    return C.profiles(hosted(t), plain_tokens(t), p.select(F.col("id").alias("doc"), "name"), p.count())


@query("g_06_settled_hosts", with_sql(TITLE_SQL, HOSTED, COHESION_SQL) + "SELECT h.doc, CASE WHEN n.size = 1 OR (n.size >= 4 AND coalesce(j.c, 1.0) < 0.02) THEN -1 ELSE h.cluster END AS cluster FROM hosted h JOIN (SELECT cluster, count(*) AS size FROM hosted GROUP BY 1) n USING (cluster) LEFT JOIN jac j ON j.cluster = h.cluster")
def _(t: Tables) -> DataFrame:
    return C.settled(hosted(t), plain_tokens(t), 4, 0.02)


@query("a_16_summary", with_sql(TITLE_SQL, HOSTED, COHESION_SQL) + ", prof AS (SELECT h.cluster, count(*) AS size, coalesce(any_value(c), 1.0) AS cohesion FROM hosted h LEFT JOIN jac j ON j.cluster = h.cluster GROUP BY 1) SELECT count(CASE WHEN size >= 25 THEN 1 END) AS solid, count(CASE WHEN size >= 8 AND size < 25 THEN 1 END) AS medium, count(CASE WHEN size >= 2 AND size < 8 THEN 1 END) AS small, count(CASE WHEN round(cohesion, 4) >= 0.25 THEN 1 END) AS homogeneous, round(100.0 * sum(size) / (SELECT count(*) FROM product), 1) AS coverage_pct FROM prof")
def _(t: Tables) -> DataFrame:
    p = products(t)
    return C.summary(C.profiles(hosted(t), plain_tokens(t), p.select(F.col("id").alias("doc"), "name"), p.count()), p.count())


@query("a_17_probes", with_sql(TITLE_SQL, HOSTED, LABEL_SQL, "lab AS (SELECT cluster, term AS label FROM per JOIN num USING (cluster) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY (c / n >= 0.35) DESC, CASE WHEN c / n >= 0.35 THEN round(c / n / ln(2.0 + df), 9) ELSE c END DESC, term) = 1)", "hit AS (SELECT stem, CASE WHEN cluster % 3 = 0 THEN -1 ELSE cluster END AS cluster FROM normed n JOIN hosted h ON h.doc = n.id JOIN (VALUES ('the'), ('ion'), ('ent'), ('ung'), ('mascher'), ('re'), ('th'), ('ou'), ('er'), ('qq')) v(stem) ON contains(norm, stem))", "counted AS (SELECT stem, cluster, count(*) AS c FROM hit GROUP BY ALL)")
    + "SELECT stem, CAST(sum(c) AS BIGINT) AS n, round(100.0 * coalesce(sum(CASE WHEN cluster < 0 THEN c END), 0) / sum(c), 1) AS in_brand_pct, any_value(top_label) AS top_cluster_label, round(100.0 * coalesce(max(CASE WHEN cluster >= 0 THEN c END), 0) / sum(c), 1) AS top_cluster_pct FROM counted LEFT JOIN (SELECT stem, label AS top_label FROM counted JOIN lab USING (cluster) WHERE cluster >= 0 QUALIFY row_number() OVER (PARTITION BY stem ORDER BY c DESC, cluster) = 1) USING (stem) GROUP BY 1 HAVING sum(c) >= 3")
def _(t: Tables) -> DataFrame:
    p, labels = products(t), hosted(t)
    brand = labels.select("doc", F.when(F.col("cluster") % 3 == 0, -1).otherwise(F.col("cluster")).alias("cluster"))
    return C.probes(p.select(F.col("id").alias("doc"), "norm"), brand, C.mechanical_labels(labels, plain_tokens(t)), ["the", "ion", "ent", "ung", "mascher", "re", "th", "ou", "er", "qq"])


@query("a_12_centroids", with_sql(TITLE_SQL, HOSTED, "tv AS (SELECT * FROM tdf WHERE df >= 2 ORDER BY df DESC, term LIMIT 900), raw AS (SELECT doc, term, count(*) * (ln((1.0 + (SELECT count(*) FROM product)) / (1 + any_value(v.df))) + 1) AS x FROM tok JOIN tv v USING (term) GROUP BY ALL), vec AS (SELECT doc, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc)) AS w FROM raw), cen AS (SELECT cluster, term, sum(w) AS s FROM vec JOIN hosted USING (doc) GROUP BY ALL)") + "SELECT cluster AS doc, term, round(s / sqrt(sum(s * s) OVER (PARTITION BY cluster)), 5) AS w FROM cen")
def _(t: Tables) -> DataFrame:
    return C.centroids(hosted(t), C.tfidf(plain_tokens(t), products(t).count(), 900, 2)).withColumn("w", F.round("w", 5))


@query("j_08_centroid_pairs", with_sql(TITLE_SQL, HOSTED, "tv AS (SELECT * FROM tdf WHERE df >= 2 ORDER BY df DESC, term LIMIT 900), raw AS (SELECT doc, term, count(*) * (ln((1.0 + (SELECT count(*) FROM product)) / (1 + any_value(v.df))) + 1) AS x FROM tok JOIN tv v USING (term) GROUP BY ALL), vec AS (SELECT doc, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc)) AS w FROM raw), cen AS (SELECT cluster, term, sum(w) AS s FROM vec JOIN hosted USING (doc) GROUP BY ALL)", "unit AS (SELECT cluster, term, s / sqrt(sum(s * s) OVER (PARTITION BY cluster)) AS w FROM cen)") + "SELECT x.cluster AS a, y.cluster AS b, round(sum(x.w * y.w), 5) AS sim FROM unit x JOIN unit y ON x.term = y.term AND x.cluster < y.cluster GROUP BY ALL HAVING sum(x.w * y.w) >= 0.3")
def _(t: Tables) -> DataFrame:
    return C.centroid_pairs(C.centroids(hosted(t), C.tfidf(plain_tokens(t), products(t).count(), 900, 2)), 0.3).withColumn("sim", F.round("sim", 5))


@query("g_00_cluster_run")
def _(t: Tables) -> DataFrame:
    p, words, grams, n = title_tokens(t)
    return C.cluster_names(p.select(F.col("id").alias("doc")), words, grams, n)
