"""Ranking shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import relational as R
from ..registry import Tables, query
from ..sources.adapters import OFFER_SQL, SHOP_SQL, offers, shops, with_sql


@query("w_03_price_rank", with_sql(OFFER_SQL) + "SELECT product_id, shop_id, CASE WHEN p IS NOT NULL THEN row_number() OVER (PARTITION BY product_id, p IS NULL ORDER BY p, shop_id) END AS rank FROM (SELECT *, CASE WHEN shop_id % 6 > 0 THEN price END AS p FROM offer)")
def _(t: Tables) -> DataFrame:
    p = F.when(F.col("shop_id") % 6 > 0, F.col("price"))
    n = F.row_number().over(Window.partitionBy("product_id", F.col("p").isNull()).orderBy("p", "shop_id"))
    return offers(t).withColumn("p", p).select("product_id", "shop_id", F.when(F.col("p").isNotNull(), n).alias("rank"))


@query("w_04_latest_version", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY date_trunc('year', o_orderdate) DESC, (o_orderstatus = 'O') DESC, o_orderkey DESC) = 1")
def _(t: Tables) -> DataFrame:
    return R.first_by(t.orders, ["o_custkey"], [F.date_trunc("year", "o_orderdate").desc(), (F.col("o_orderstatus") == "O").desc(), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("w_06_newest_10", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate END DESC NULLS LAST, o_orderkey) <= 10")
def _(t: Tables) -> DataFrame:
    return R.first_by(t.orders, ["o_custkey"], [F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderdate")).desc_nulls_last(), F.col("o_orderkey")], 10).select("o_custkey", "o_orderkey")


@query("w_07_round_robin", with_sql(OFFER_SQL) + "SELECT product_id, shop_id FROM (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY price, product_id) AS turn FROM offer) ORDER BY turn, shop_id LIMIT 6")
def _(t: Tables) -> DataFrame:
    return R.round_robin(offers(t), "shop_id", [F.col("price"), F.col("product_id")], [F.col("shop_id")], 6).select("product_id", "shop_id")


@query("w_09_best_duplicate", "SELECT name, size FROM (SELECT lower(trim(p_name)) AS name, max(p_size) AS size FROM part GROUP BY 1) ORDER BY size DESC, name LIMIT 10")
def _(t: Tables) -> DataFrame:
    best = R.first_by(t.part.select(F.lower(F.trim("p_name")).alias("name"), F.col("p_size").alias("size")), ["name"], [F.desc("size")])
    return best.orderBy(F.desc("size"), "name").limit(10)


@query("w_10_recent_names", "WITH recent AS (SELECT o_custkey, o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 50) SELECT o_custkey FROM recent GROUP BY 1 ORDER BY max(o_orderkey) DESC LIMIT 10")
def _(t: Tables) -> DataFrame:
    recent = t.orders.orderBy(F.desc("o_orderkey")).limit(50)
    return recent.groupBy("o_custkey").agg(F.max("o_orderkey").alias("k")).orderBy(F.desc("k")).limit(10).select("o_custkey")


@query("w_11_flatten_first", "SELECT lower(n) AS name, min(k * 10 + pos) AS at FROM (SELECT -o_orderkey AS k, unnest(string_split(o_orderpriority, '-')) AS n, unnest(range(len(string_split(o_orderpriority, '-')))) AS pos FROM orders) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    flat = t.orders.select((-F.col("o_orderkey")).alias("k"), F.posexplode(F.split("o_orderpriority", "-")).alias("pos", "n"))
    return R.first_by(flat.withColumn("name", F.lower("n")).withColumn("at", F.col("k") * 10 + F.col("pos")), ["name"], [F.col("at")]).select("name", "at")


ISLANDS = """fresh AS (SELECT user_id, event_id, CAST(event_type IN ('purchase', 'signup') AS INTEGER) AS new FROM events),
isl AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM fresh),
str AS (SELECT *, sum(1 - new) OVER (PARTITION BY user_id, island ORDER BY event_id) AS streak FROM isl)"""


@query("w_12_streak_stop", with_sql(ISLANDS) + "SELECT user_id, event_id FROM (SELECT *, coalesce(max(CAST(streak >= 3 AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past FROM str) WHERE past = 0")
def _(t: Tables) -> DataFrame:
    return R.upto_streak(t.events.select("user_id", "event_id", "event_type"), ["user_id"], [F.col("event_id")], F.col("event_type").isin("purchase", "signup"), 3).select("user_id", "event_id")


@query("w_13_empty_pages", with_sql(ISLANDS) + "SELECT user_id, CAST(max(streak) AS BIGINT) AS longest, coalesce(max(streak) >= 10, false) AS stops FROM str GROUP BY 1")
def _(t: Tables) -> DataFrame:
    s = R.streaks(t.events.select("user_id", "event_id", "event_type"), ["user_id"], [F.col("event_id")], F.col("event_type").isin("purchase", "signup"))
    return s.groupBy("user_id").agg(F.max("streak").alias("longest"), (F.max("streak") >= 10).alias("stops"))


@query("w_16_first_row", "SELECT l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) = 1")
def _(t: Tables) -> DataFrame:
    return R.first_by(t.lineitem, ["l_partkey"], [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")]).select("l_partkey", "l_suppkey")


SLUG_SQL = "base AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN replace(p_name, ' ', '-') || '-2' ELSE replace(p_name, ' ', '-') END AS base FROM part)"


@query("w_20_slugs", "WITH " + SLUG_SQL + """, n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS k FROM base),
taken AS (SELECT regexp_replace(base, '-[0-9]+$', '') AS base, CAST(regexp_extract(base, '-([0-9]+)$', 1) AS INTEGER) AS t FROM (SELECT DISTINCT base FROM base) WHERE regexp_matches(base, '-[0-9]{1,9}$')),
free AS (SELECT b.base, i, row_number() OVER (PARTITION BY b.base ORDER BY i) + 1 AS k FROM (SELECT base, count(*) AS n FROM base GROUP BY 1) b, LATERAL (SELECT unnest(range(2, b.n + 3 + (SELECT count(*) FROM taken t WHERE t.base = b.base))) AS i) WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.base = b.base AND t.t = i))
SELECT p_partkey, CASE WHEN n.k = 1 THEN n.base ELSE n.base || '-' || f.i END AS slug FROM n LEFT JOIN free f ON f.base = n.base AND f.k = n.k""")
def _(t: Tables) -> DataFrame:
    name = F.replace("p_name", F.lit(" "), F.lit("-"))
    base = t.part.select("p_partkey", F.when(F.col("p_partkey") % 11 == 0, F.concat(name, F.lit("-2"))).otherwise(name).alias("base"))
    return R.unique_slugs(base, "base", ["p_partkey"]).select("p_partkey", "slug")


SHUFFLE_SQL = """WITH RECURSIVE l AS (SELECT p_brand AS seed, list(CAST(p_partkey AS VARCHAR) ORDER BY CAST(p_partkey AS VARCHAR)) AS items FROM part GROUP BY 1),
hash(seed, k, h) AS (SELECT seed, 0, CAST(2166136261 AS BIGINT) FROM l UNION ALL SELECT seed, k + 1, (xor(h, CAST(ord(seed[k + 1]) AS BIGINT)) * 16777619) % 4294967296 FROM hash WHERE k < length(seed)),
step(seed, i, state, items) AS (SELECT l.seed, len(items) - 1, h, items FROM l JOIN hash ON hash.seed = l.seed AND k = length(l.seed) UNION ALL
SELECT seed, i - 1, s, list_transform(range(1, len(items) + 1), lambda k: items[CASE k WHEN i + 1 THEN s % (i + 1) + 1 WHEN s % (i + 1) + 1 THEN i + 1 ELSE k END]) FROM (SELECT seed, i, items, (state * 1664525 + 1013904223) % 4294967296 AS s FROM step WHERE i > 0))
SELECT seed, unnest(items) AS item, unnest(range(len(items))) AS place FROM step WHERE i = 0"""


@query("o_13_shuffle", SHUFFLE_SQL)
def _(t: Tables) -> DataFrame:
    from ..functions.shuffle import seeded_shuffle

    return seeded_shuffle(t.part.select(F.col("p_brand").alias("seed"), F.col("p_partkey").cast("string").alias("item")))
