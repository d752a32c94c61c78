"""Filters, joins, aggregates, ordering, paging and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import relational as R
from ..operators.search import Contains
from ..registry import Tables, query
from ..sources.adapters import OFFER_SQL, REQUEST_SQL, SHOP_SQL, TIER_SQL, offers, requests, shops, tiers, with_sql

#: The device classes in scope.
CND_PREFIXES = [
    "Q010101", "Q010102", "Q010103", "Q010104", "Q010201", "Q010202", "Q010203", "Q010301", "Q010302", "Q010303",
    "Q010401", "Q010402", "Q010403", "Q010404", "Q010501", "Q010502", "Q010503", "Q019001", "T010101", "T020101",
    "T030102", "T030201", "D0101", "D0102", "D0201",
]

DAY = "strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d')"


@query("s_01_scan", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def _(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_partkey", "l_quantity")


@query("f_01_lookup", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_name = 'Customer#7' OR c_custkey = 7")
def _(t: Tables) -> DataFrame:
    return t.customer.where((F.col("c_name") == "Customer#7") | (F.col("c_custkey") == 7)).select("c_custkey", "c_name", "c_mktsegment")


@query("f_02_in_list", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))")
def _(t: Tables) -> DataFrame:
    wanted = t.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(wanted, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("f_03_not_null", "SELECT doc_id, nullif(source, 'src1') AS source FROM documents WHERE nullif(source, 'src1') IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.nullif(F.col("source"), F.lit("src1")).alias("source")).where(F.col("source").isNotNull())


@query("f_04_json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events WHERE json_extract_string(props, '$.k') = '69'")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k")).where("k = '69'")


@query("f_05_contains", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%blue%'")
def _(t: Tables) -> DataFrame:
    return t.part.where(R.contains_any([F.col("p_name")], "%blue,_")).select("p_partkey", "p_name")


@query("f_06_any_contains", "SELECT p_partkey FROM part WHERE p_name ILIKE '%bolt%' OR p_type ILIKE '%bolt%' OR p_brand ILIKE '%bolt%' OR CAST(p_size AS VARCHAR) ILIKE '%bolt%'")
def _(t: Tables) -> DataFrame:
    return t.part.where(R.contains_any([F.col("p_name"), F.col("p_type"), F.col("p_brand"), F.col("p_size").cast("string")], "bolt")).select("p_partkey")


@query("f_05_index_contains", "SELECT needle, p_partkey FROM (SELECT DISTINCT substr(unnest(string_split(p_name, ' ')), 2, 4) AS needle FROM part) JOIN part ON p_name ILIKE '%' || needle || '%' OR p_type ILIKE '%' || needle || '%' WHERE needle <> ''")
def _(t: Tables) -> DataFrame:
    """Every inner part of a word of a part's name, against all names and types, through the stored index."""
    needles = t.part.select(F.explode(F.split("p_name", " ")).alias("word")).select(F.substring("word", 2, 4).alias("needle"))
    return Contains(t.part, "p_partkey", ["p_name", "p_type"]).search(needles).select("needle", F.col("id").alias("p_partkey"))


@query("f_07_visible", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (CASE WHEN l_returnflag = 'R' THEN true WHEN l_returnflag = 'A' THEN false END) IS NOT TRUE")
def _(t: Tables) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False)
    return t.lineitem.where(R.visible(flag)).select("l_orderkey", "l_linenumber")


@query("f_08_range", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1995-09-01'")
def _(t: Tables) -> DataFrame:
    return t.orders.where("o_orderdate >= timestamp_ntz'1995-03-01' AND o_orderdate < timestamp_ntz'1995-09-01'").select("o_orderkey")


MATCH_SQL = "matched AS (SELECT l_orderkey AS basket_id, l_linenumber - 1 AS query_index, l_partkey AS offer_id, l_suppkey AS shop_id, CAST(floor(l_extendedprice * 100.0 / l_quantity + 0.5) AS BIGINT) AS price, 1 - l_discount * 10 AS similarity FROM lineitem)"


def matched(t: Tables) -> DataFrame:
    """Lines as match rows, with a similarity that the discount stands in for."""
    return t.lineitem.select(
        F.col("l_orderkey").alias("basket_id"), (F.col("l_linenumber") - 1).alias("query_index"), F.col("l_partkey").alias("offer_id"), F.col("l_suppkey").alias("shop_id"),
        F.floor(F.col("l_extendedprice") * 100.0 / F.col("l_quantity") + 0.5).cast("long").alias("price"), (1 - F.col("l_discount") * 10).alias("similarity"),
    )


@query("f_09_threshold", with_sql(MATCH_SQL) + "SELECT basket_id, query_index, offer_id FROM matched WHERE similarity >= 0.15")
def _(t: Tables) -> DataFrame:
    return matched(t).where("similarity >= 0.15D").select("basket_id", "query_index", "offer_id")


@query("f_10_index_guard", with_sql(MATCH_SQL) + "SELECT m.basket_id, m.query_index FROM matched m JOIN orders o ON o.o_orderkey = m.basket_id WHERE m.query_index >= 0 AND m.query_index < length(o.o_orderpriority) // 3")
def _(t: Tables) -> DataFrame:
    sizes = t.orders.select(F.col("o_orderkey").alias("basket_id"), F.expr("length(o_orderpriority) div 3").alias("n"))
    return matched(t).join(sizes, "basket_id").where("query_index >= 0 AND query_index < n").select("basket_id", "query_index")


CND_VALUES = ", ".join(f"('{p}')" for p in CND_PREFIXES)
CND_CODE = "CASE p_partkey % 4 WHEN 0 THEN 'q0101' WHEN 1 THEN ' T0302' WHEN 2 THEN 'D0' ELSE 'X9' END || lpad(CAST(p_size AS VARCHAR), 4, '0')"


@query("f_11_prefix", f"WITH code AS (SELECT p_partkey, {CND_CODE} AS code FROM part), pre(prefix) AS (VALUES {CND_VALUES}) SELECT p_partkey, code, (SELECT max_by(prefix, length(prefix)) FROM pre WHERE starts_with(upper(trim(code)), prefix)) AS prefix FROM code")
def _(t: Tables) -> DataFrame:
    head = F.when(F.col("p_partkey") % 4 == 0, "q0101").when(F.col("p_partkey") % 4 == 1, " T0302").when(F.col("p_partkey") % 4 == 2, "D0").otherwise("X9")
    return R.longest_prefix(t.part.select("p_partkey", F.concat(head, F.lpad(F.col("p_size").cast("string"), 4, "0")).alias("code")), "code", CND_PREFIXES)


BATCH_SQL = "batch AS (SELECT l_partkey AS product_id, list(struct_pack(q := CAST(l_quantity AS BIGINT), expiry := CAST(l_shipdate AS DATE))) AS batches, CAST(sum(l_quantity) AS BIGINT) AS total FROM lineitem GROUP BY 1)"


def batches(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_partkey").alias("product_id")).agg(F.collect_list(F.struct(F.col("l_quantity").cast("long").alias("q"), F.col("l_shipdate").cast("date").alias("expiry"))).alias("batches"))


@query("f_13_expiring", with_sql(BATCH_SQL) + "SELECT product_id FROM batch WHERE len(list_filter(batches, lambda b: b.expiry - DATE '1998-06-01' <= 10)) > 0")
def _(t: Tables) -> DataFrame:
    return batches(t).where(F.exists("batches", lambda b: F.datediff(b["expiry"], F.lit("1998-06-01").cast("date")) <= 10)).select("product_id")


@query("f_14_stock_state", with_sql(BATCH_SQL) + "SELECT b.product_id, CASE WHEN total = 0 THEN 'exhausted' WHEN total <= 500 THEN 'low' ELSE 'ok' END AS state FROM batch b JOIN part p ON p.p_partkey = b.product_id WHERE p.p_name ILIKE '%a%'")
def _(t: Tables) -> DataFrame:
    total = F.aggregate("batches", F.lit(0).cast("long"), lambda a, b: a + b["q"])
    named = t.part.where(R.contains_any([F.col("p_name")], "a")).select(F.col("p_partkey").alias("product_id"))
    return batches(t).withColumn("total", total).join(named, "product_id", "left_semi").select("product_id", F.when(F.col("total") == 0, "exhausted").when(F.col("total") <= 500, "low").otherwise("ok").alias("state"))


@query("f_15_open_rows", "SELECT o_orderkey, (CASE WHEN o_orderstatus = 'F' THEN 1 END) IS NULL AS open FROM orders")
def _(t: Tables) -> DataFrame:
    return t.orders.withColumn("completed", F.when(F.col("o_orderstatus") == "F", F.lit(1))).select("o_orderkey", F.col("completed").isNull().alias("open"))


@query("f_16_crawler", "SELECT page_id, regexp_matches(lower(url), 'bot|crawl|spider|feed') AS crawler FROM pages")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.lower("url").rlike("bot|crawl|spider|feed").alias("crawler"))


@query("f_17_hub_search", "SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand)), 'brand#1')")
def _(t: Tables) -> DataFrame:
    return t.part.where(F.lower(F.concat_ws(" ", "p_name", "p_brand")).contains("brand#1")).select("p_partkey")


@query("f_18_validators", "SELECT page_id, regexp_matches(regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1), '^[a-z0-9]+(?:-[a-z0-9]+)*$') AND length(url) <= 60 AS ok FROM pages")
def _(t: Tables) -> DataFrame:
    last = F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1)
    return t.pages.select("page_id", (last.rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$") & (F.length("url") <= 60)).alias("ok"))


@query("f_19_publishable", "SELECT p_brand, count(CASE WHEN p_retailprice > 990 THEN 1 END) AS priced FROM part GROUP BY 1 HAVING count(CASE WHEN p_retailprice > 990 THEN 1 END) >= 5 AND count(p_name) >= 1")
def _(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.count_if(F.col("p_retailprice") > 990).alias("priced"), F.count("p_name").alias("samples")).where("priced >= 5 AND samples >= 1").drop("samples")


@query("f_20_date_clamp", "SELECT o_orderkey, CAST(least(coalesce(try_cast(d AS DATE), DATE '1997-01-01'), DATE '1997-01-01') AS VARCHAR) AS day FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'not a day' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders)")
def _(t: Tables) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 7 == 0, "not a day").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    today = F.lit("1997-01-01").cast("date")
    return t.orders.select("o_orderkey", F.least(F.coalesce(raw.try_cast("date"), today), today).cast("string").alias("day"))


@query("j_01_embed", "SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def _(t: Tables) -> DataFrame:
    return t.supplier.join(t.nation.withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey", "left").select("s_suppkey", "s_name", "n_name")


@query("j_02_snowflake", "SELECT l_orderkey, l_linenumber, p_name, c_name, n_name, r_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _(t: Tables) -> DataFrame:
    out = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(t.part, F.col("l_partkey") == F.col("p_partkey"), "left")
    out = out.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("l_orderkey", "l_linenumber", "p_name", "c_name", "n_name", "r_name")


@query("j_03_fallback", with_sql(SHOP_SQL, OFFER_SQL) + "SELECT product_id, o.shop_id, coalesce(CASE WHEN o.shop_id % 3 > 0 THEN shop_name END, CAST(o.shop_id AS VARCHAR)) AS shop_name FROM offer o LEFT JOIN shop s ON s.shop_id = o.shop_id")
def _(t: Tables) -> DataFrame:
    known = shops(t).where("shop_id % 3 > 0").select("shop_id", "shop_name")
    return R.with_fallback(offers(t).select("product_id", "shop_id"), known, "shop_id", {"shop_name": F.col("shop_id").cast("string")}).select("product_id", "shop_id", "shop_name")


@query("j_04_enrich", "SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN p_size > 10 THEN p_name END, 'part ' || l_partkey) AS name FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def _(t: Tables) -> DataFrame:
    ids = t.lineitem.select(F.col("l_partkey").alias("p_partkey")).dropDuplicates()
    detail = t.part.join(ids, "p_partkey", "left_semi").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") > 10, F.col("p_name")).alias("found"))
    return t.lineitem.join(detail, "l_partkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("found", F.concat(F.lit("part "), F.col("l_partkey").cast("string"))).alias("name"))


COMBO_SQL = "combo AS (SELECT o_orderkey AS id, 'c-' || o_orderkey AS slug, o_orderstatus <> 'F' AS active, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'c-' || (o_orderkey - 1) END AS redirect FROM orders)"


@query("j_10_redirect", with_sql(COMBO_SQL) + "SELECT a.slug, CASE WHEN b.active THEN b.slug WHEN c.active THEN c.slug END AS target FROM combo a LEFT JOIN combo b ON b.slug = a.redirect LEFT JOIN combo c ON c.slug = b.redirect WHERE NOT a.active")
def _(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    c = t.orders.select(F.concat(F.lit("c-"), key).alias("slug"), (F.col("o_orderstatus") != "F").alias("active"), F.when((F.col("o_orderstatus") == "F") & (key % 2 == 0), F.concat(F.lit("c-"), key - 1)).alias("redirect"))
    b = c.select(F.col("slug").alias("redirect"), F.col("active").alias("b_active"), F.col("redirect").alias("b_redirect"))
    d = c.select(F.col("slug").alias("b_redirect"), F.col("active").alias("c_active"))
    hops = c.where("NOT active").join(b, "redirect", "left").join(d, "b_redirect", "left")
    return hops.select("slug", F.when(F.col("b_active"), F.col("redirect")).when(F.col("c_active"), F.col("b_redirect")).alias("target"))


@query("j_11_hydrate", "SELECT l_orderkey, string_agg(coalesce(CASE WHEN p_size > 25 THEN p_name END, 'snapshot ' || l_partkey), '|' ORDER BY l_linenumber, l_partkey, CASE WHEN p_size > 25 THEN p_name END) AS names FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1")
def _(t: Tables) -> DataFrame:
    snap = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("products")).select("l_orderkey", F.posexplode("products").alias("pos", "p"))
    live = t.part.where("p_size > 25").select("p_partkey", "p_name")
    rows = snap.join(live, F.col("p.l_partkey") == F.col("p_partkey"), "left").withColumn("name", F.coalesce("p_name", F.concat(F.lit("snapshot "), F.col("p.l_partkey").cast("string"))))
    return rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), "|").alias("names"))


@query("j_13_missing", "SELECT p_partkey FROM part WHERE p_size > 5 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.08 AND l_quantity > 40)")
def _(t: Tables) -> DataFrame:
    return t.part.where("p_size > 5").join(t.lineitem.where("l_discount > 0.08D AND l_quantity > 40").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey")


@query("j_14_new_refs", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def _(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


NAMES_SQL = "names(wanted) AS (SELECT DISTINCT n_name FROM nation UNION SELECT DISTINCT substr(n_name, 2) FROM nation)"


@query("j_15_resolve_names", with_sql(NAMES_SQL) + ", exact AS (SELECT wanted, min(n_nationkey) AS id, 1 AS stage FROM names JOIN nation ON n_name = wanted GROUP BY 1), fuzzy AS (SELECT wanted, min(n_nationkey) AS id, 2 AS stage FROM names JOIN nation ON contains(lower(n_name), lower(wanted)) WHERE wanted NOT IN (SELECT wanted FROM exact) GROUP BY 1) SELECT * FROM exact UNION ALL SELECT * FROM fuzzy".replace(") , exact", "), exact"))
def _(t: Tables) -> DataFrame:
    wanted = t.nation.select(F.col("n_name").alias("wanted")).union(t.nation.select(F.substring("n_name", 2, 100))).distinct()
    exact = wanted.join(t.nation, F.col("n_name") == F.col("wanted")).groupBy("wanted").agg(F.min("n_nationkey").alias("id")).withColumn("stage", F.lit(1))
    rest = wanted.join(exact, "wanted", "left_anti")
    # a contains search has no key; both sides are rows of a dimension, and the planner knows their size
    fuzzy = t.nation.join(rest, F.lower("n_name").contains(F.lower("wanted"))).groupBy("wanted").agg(F.min("n_nationkey").alias("id")).withColumn("stage", F.lit(2))
    return exact.unionByName(fuzzy)


@query("j_16_matrix", "WITH seen AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), req AS (SELECT l_orderkey, l_linenumber, l_suppkey AS own FROM lineitem) SELECT r.l_orderkey, r.l_linenumber, s.l_suppkey, r.own = s.l_suppkey AS present FROM req r JOIN seen s ON r.l_orderkey = s.l_orderkey")
def _(t: Tables) -> DataFrame:
    seen = t.lineitem.select("l_orderkey", "l_suppkey").distinct()
    return t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("own")).join(seen, "l_orderkey").select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("own") == F.col("l_suppkey")).alias("present"))


@query("j_17_cart_lines", with_sql(MATCH_SQL) + "SELECT o.o_orderkey, m.query_index, m.offer_id FROM orders o JOIN matched m ON m.basket_id = o.o_orderkey AND m.query_index = o.o_orderkey % 3")
def _(t: Tables) -> DataFrame:
    rows = matched(t).groupBy("basket_id").agg(F.collect_list(F.struct("query_index", "offer_id")).alias("matches"))
    refs = t.orders.select("o_orderkey", F.col("o_orderkey").alias("basket_id"), F.array((F.col("o_orderkey") % 3).cast("int")).alias("refs")).withColumn("query_index", F.explode("refs"))
    lines = rows.select("basket_id", F.inline("matches"))
    return refs.join(lines, ["basket_id", "query_index"]).select("o_orderkey", "query_index", "offer_id")


@query("j_18_valid_assignments", "SELECT a.l_orderkey, a.l_linenumber FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem s WHERE s.l_orderkey = a.l_orderkey AND s.l_partkey = a.l_partkey AND s.l_suppkey = a.l_suppkey AND s.l_linestatus = 'O')")
def _(t: Tables) -> DataFrame:
    return t.lineitem.join(t.lineitem.where("l_linestatus = 'O'"), ["l_orderkey", "l_partkey", "l_suppkey"], "left_semi").select("l_orderkey", "l_linenumber")


@query("j_19_facets", "SELECT n_name AS facet, n_nationkey * 3 AS expected, count(c_custkey) AS got, CASE WHEN n_nationkey > 0 THEN round(count(c_custkey) / (n_nationkey * 3), 4) END AS ratio FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey")
def _(t: Tables) -> DataFrame:
    got = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("got"))
    out = t.nation.join(got, "n_nationkey", "left").select(F.col("n_name").alias("facet"), (F.col("n_nationkey") * 3).alias("expected"), F.coalesce("got", F.lit(0)).alias("got"))
    return out.withColumn("ratio", F.when(F.col("expected") > 0, F.round(F.col("got") / F.col("expected"), 4)))


@query("j_20_siblings", "SELECT a.n_name AS name, b.n_name AS sibling FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name")
def _(t: Tables) -> DataFrame:
    b = t.nation.select("n_regionkey", F.col("n_name").alias("sibling"))
    return t.nation.select("n_regionkey", F.col("n_name").alias("name")).join(b, "n_regionkey").where("name <> sibling").select("name", "sibling")


@query("a_01_count", "SELECT count(*) AS n FROM part WHERE p_size > 10")
def _(t: Tables) -> DataFrame:
    return t.part.where("p_size > 10").agg(F.count(F.lit(1)).alias("n"))


EV = "ev AS (SELECT *, strftime(timezone('Europe/Rome', CAST(ts AS TIMESTAMP) AT TIME ZONE 'UTC'), '%Y-%m-%d') AS day FROM events)"


def rome_day(ts: str = "ts"):
    """The calendar day in Rome of a time in UTC."""
    return F.to_date(F.from_utc_timestamp(F.col(ts).cast("timestamp"), "Europe/Rome"))


@query("a_04_day_counts", with_sql(EV) + ", days AS (SELECT strftime(d, '%Y-%m-%d') AS day FROM (SELECT unnest(generate_series(CAST(min(day) AS DATE), CAST(max(day) AS DATE), INTERVAL 1 DAY)) AS d FROM ev)) SELECT d.day, count(CASE WHEN event_type = 'click' THEN 1 END) AS closed, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS booked FROM days d LEFT JOIN ev USING (day) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    per = t.events.groupBy(rome_day().alias("day")).agg(F.count_if(F.col("event_type") == "click").alias("closed"), F.count_if(F.col("event_type") == "purchase").alias("booked"))
    spine = per.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return spine.join(per, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("closed", F.lit(0)).alias("closed"), F.coalesce("booked", F.lit(0)).alias("booked"))


@query("a_05_kpi", with_sql(EV) + "SELECT count(CASE WHEN event_type = 'click' THEN 1 END) AS closed, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS booked FROM ev WHERE day = '2024-01-15'")
def _(t: Tables) -> DataFrame:
    return t.events.where(rome_day() == F.lit("2024-01-15").cast("date")).agg(F.count_if(F.col("event_type") == "click").alias("closed"), F.count_if(F.col("event_type") == "purchase").alias("booked"))


@query("a_06_sessions", "SELECT user_id, count(*) AS n, CAST(max(event_id) AS BIGINT) AS newest FROM events GROUP BY 1 ORDER BY user_id DESC LIMIT 3")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("newest")).orderBy(F.desc("user_id")).limit(3)


@query("a_18_label_rollup", "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS size, max(p_retailprice) AS top, count(DISTINCT p_type) AS subs FROM part GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand", "p_type").agg(F.sum("p_size").alias("size"), F.max("p_retailprice").alias("top")).groupBy("p_brand").agg(F.sum("size").alias("size"), F.max("top").alias("top"), F.count(F.lit(1)).alias("subs"))


@query("a_19_cluster_sizes", "SELECT l_suppkey AS cluster, count(*) AS size, arg_max(l_shipmode, k) AS label FROM (SELECT l_suppkey, l_returnflag || l_linestatus AS l_shipmode, l_orderkey * 100 + l_linenumber AS k FROM lineitem) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_suppkey").alias("cluster")).agg(F.count(F.lit(1)).alias("size"), F.max_by(F.concat("l_returnflag", "l_linestatus"), F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("label"))


@query("a_20_histogram", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("a_21_completeness", "SELECT round(count(DISTINCT o_custkey) / (SELECT count(*) FROM customer), 4) AS ratio, count(DISTINCT o_custkey) / (SELECT count(*) FROM customer) >= 0.95 AS passed FROM orders")
def _(t: Tables) -> DataFrame:
    got = t.orders.select("o_custkey").distinct().agg(F.count(F.lit(1)).alias("got"))
    both = got.join(t.customer.agg(F.count(F.lit(1)).alias("want")))  # one row each
    return both.select(F.round(F.col("got") / F.col("want"), 4).alias("ratio"), (F.col("got") / F.col("want") >= 0.95).alias("passed"))


@query("a_22_stock", with_sql(BATCH_SQL) + "SELECT product_id, total FROM batch")
def _(t: Tables) -> DataFrame:
    return batches(t).select("product_id", F.aggregate("batches", F.lit(0).cast("long"), lambda a, b: a + b["q"]).alias("total"))


@query("a_23_open_quantity", "SELECT o_custkey, CAST(coalesce(sum(CASE WHEN o_orderstatus <> 'F' THEN coalesce(CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 9 END, 1) END), 0) AS BIGINT) AS open_quantity, max(CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END) AS newest_open, bool_and(o_orderstatus = 'F') AS completed_only FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    q = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey") % 9)
    is_open = F.col("o_orderstatus") != "F"
    return t.orders.groupBy("o_custkey").agg(
        F.coalesce(F.sum(F.when(is_open, F.coalesce(q, F.lit(1)))), F.lit(0)).alias("open_quantity"), F.max(F.when(is_open, F.col("o_orderkey"))).alias("newest_open"), F.bool_and(~is_open).alias("completed_only")
    )


@query("a_24_spread", with_sql(OFFER_SQL) + "SELECT product_id, CASE WHEN count(price) >= 2 THEN CAST(max(price) - min(price) AS BIGINT) END AS spread FROM offer GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return offers(t).groupBy("product_id").agg(F.count("price").alias("n"), F.max("price").alias("hi"), F.min("price").alias("lo")).select("product_id", F.when(F.col("n") >= 2, F.col("hi") - F.col("lo")).alias("spread"))


@query("a_25_lander", "SELECT p_brand AS lander, count(*) AS products, count(CASE WHEN p_retailprice > 0 THEN 1 END) AS priced, round(avg(p_retailprice), 2) AS avg_price, min(p_retailprice) AS min_price, max(p_retailprice) AS max_price FROM part GROUP BY 1")
def _(t: Tables) -> DataFrame:
    p = F.col("p_retailprice")
    return t.part.groupBy(F.col("p_brand").alias("lander")).agg(F.count(F.lit(1)).alias("products"), F.count_if(p > 0).alias("priced"), F.round(F.avg(p), 2).alias("avg_price"), F.min(p).alias("min_price"), F.max(p).alias("max_price"))


@query("a_27_winners", with_sql(OFFER_SQL) + "SELECT product_id, shop_id FROM (SELECT product_id, min(shop_id) AS shop_id FROM offer GROUP BY 1 UNION SELECT product_id, arg_min(shop_id, price * 100000 + shop_id) FROM offer GROUP BY 1)")
def _(t: Tables) -> DataFrame:
    o = offers(t)
    return o.groupBy("product_id").agg(F.min("shop_id").alias("shop_id")).union(o.groupBy("product_id").agg(F.min_by("shop_id", F.struct("price", "shop_id")))).distinct()


@query("a_28_analysed", "SELECT count(*) * 789 AS analysed FROM lineitem")
def _(t: Tables) -> DataFrame:
    return t.lineitem.agg((F.count(F.lit(1)) * 789).alias("analysed"))


@query("a_31_run_totals", "SELECT count(*) AS rows, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS inserted, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS skipped, count(CASE WHEN o_totalprice < 1000 THEN 1 END) AS issues FROM orders")
def _(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    return t.orders.agg(F.count(F.lit(1)).alias("rows"), F.count_if(s == "O").alias("inserted"), F.count_if(s == "F").alias("skipped"), F.count_if(F.col("o_totalprice") < 1000).alias("issues"))


@query("a_32_per_shop", with_sql(SHOP_SQL, OFFER_SQL) + "SELECT shop_name, count(*) AS n FROM offer JOIN shop USING (shop_id) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return offers(t).join(shops(t), "shop_id").groupBy("shop_name").agg(F.count(F.lit(1)).alias("n"))


@query("o_01_nulls_last", "SELECT row_number() OVER (ORDER BY x ASC NULLS LAST, c_custkey) AS n, c_custkey FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS x FROM customer)")
def _(t: Tables) -> DataFrame:
    x = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    return t.customer.select("c_custkey", x.alias("x")).withColumn("n", F.row_number().over(Window.orderBy(F.asc_nulls_last("x"), "c_custkey"))).select("n", "c_custkey")


@query("o_02_top_nulls_last", "SELECT o_orderkey FROM orders ORDER BY CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END DESC NULLS LAST, o_orderkey LIMIT 20")
def _(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).desc_nulls_last(), "o_orderkey").limit(20).select("o_orderkey")


@query("o_03_newest", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def _(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1).select("o_orderkey")


@query("o_05_similarity_price", with_sql(MATCH_SQL) + "SELECT basket_id, query_index, row_number() OVER (PARTITION BY basket_id ORDER BY similarity DESC, price, query_index) AS n FROM matched")
def _(t: Tables) -> DataFrame:
    return matched(t).select("basket_id", "query_index", F.row_number().over(Window.partitionBy("basket_id").orderBy(F.desc("similarity"), "price", "query_index")).alias("n"))


@query("o_06_member_order", with_sql(SHOP_SQL, OFFER_SQL) + "SELECT product_id, string_agg(CAST(shop_id AS VARCHAR), ',' ORDER BY lower(shop_name), shop_id) AS members FROM offer JOIN shop USING (shop_id) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    rows = offers(t).join(shops(t), "shop_id").groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct(F.lower("shop_name").alias("a"), "shop_id"))).alias("m"))
    return rows.select("product_id", F.array_join(F.transform("m", lambda x: x["shop_id"].cast("string")), ",").alias("members"))


@query("o_07_output_order", "SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_name, p_partkey) AS n FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.row_number().over(Window.orderBy(F.desc("p_size"), "p_name", "p_partkey")).alias("n"))


@query("o_08_window", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1000 OFFSET 1000")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey").orderBy("o_orderkey").offset(1000).limit(1000)


@query("o_09_paging", "SELECT segment, slug, (row_number() OVER (ORDER BY segment, slug) - 1) // 10000 AS chunk FROM (SELECT 0 AS segment, 'p' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS slug FROM part UNION ALL SELECT 1, 'o' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') FROM orders UNION ALL SELECT 2, 'c' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') FROM customer) QUALIFY chunk < 32")
def _(t: Tables) -> DataFrame:
    def slug(mark: str, key: str):
        return F.concat(F.lit(mark), F.lpad(F.col(key).cast("string"), 9, "0")).alias("slug")

    parts = [t.part.select(slug("p", "p_partkey")), t.orders.select(slug("o", "o_orderkey")), t.customer.select(slug("c", "c_custkey"))]
    return R.paged(parts, "slug").select("segment", "slug", "chunk")


@query("o_10_cap", "SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 40")
def _(t: Tables) -> DataFrame:
    return t.documents.orderBy(F.desc("n_chars"), "doc_id").limit(40).select("doc_id")


@query("o_11_medals", with_sql(SHOP_SQL, OFFER_SQL) + "SELECT shop_id FROM offer GROUP BY 1 ORDER BY count(*) DESC, shop_id LIMIT 3")
def _(t: Tables) -> DataFrame:
    return offers(t).groupBy("shop_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "shop_id").limit(3).select("shop_id")


@query("o_12_display", "SELECT s_suppkey, row_number() OVER (ORDER BY coalesce(CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey END, 999), s_name) AS n FROM supplier")
def _(t: Tables) -> DataFrame:
    rank = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey"))
    return t.supplier.select("s_suppkey", F.row_number().over(Window.orderBy(F.coalesce(rank, F.lit(999)), "s_name")).alias("n"))


@query("o_14_random", "SELECT p_partkey, p_name FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 120) ORDER BY md5('7-' || p_partkey), p_partkey LIMIT 15")
def _(t: Tables) -> DataFrame:
    key = F.md5(F.concat(F.lit("7-"), F.col("p_partkey").cast("string")))  # the same for any partitioning
    return t.part.orderBy("p_partkey").limit(120).orderBy(key, "p_partkey").limit(15).select("p_partkey", "p_name")


@query("o_15_numeric_key", "SELECT c_custkey, coalesce(try_cast(nullif(regexp_replace(CASE WHEN c_custkey % 4 = 0 THEN 'none' ELSE c_name END, '[^0-9]', '', 'g'), '') AS BIGINT), -1) AS k FROM customer")
def _(t: Tables) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 4 == 0, "none").otherwise(F.col("c_name"))
    return t.customer.select("c_custkey", F.coalesce(F.regexp_replace(raw, "[^0-9]", "").try_cast("long"), F.lit(-1)).alias("k"))


@query("o_16_best_file", "WITH f AS (SELECT s_nationkey AS g, s_name || CASE WHEN s_suppkey % 5 = 0 THEN '_lista.csv' WHEN s_suppkey % 5 = 1 THEN '.csv' ELSE '.txt' END AS name FROM supplier) SELECT g, arg_min(name, lpad(CAST(100 - score AS VARCHAR), 4, '0') || name) AS name FROM (SELECT *, CASE WHEN contains(name, 'lista') THEN 10 ELSE 0 END + CASE WHEN ends_with(name, '.csv') THEN 5 ELSE 0 END AS score FROM f) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    k = F.col("s_suppkey") % 5
    f = t.supplier.select(F.col("s_nationkey").alias("g"), F.concat("s_name", F.when(k == 0, "_lista.csv").when(k == 1, ".csv").otherwise(".txt")).alias("name"))
    score = F.when(F.col("name").contains("lista"), 10).otherwise(0) + F.when(F.col("name").endswith(".csv"), 5).otherwise(0)
    return R.first_by(f.withColumn("score", score), ["g"], [F.desc("score"), F.col("name")]).select("g", "name")


@query("u_01_priority_union", "SELECT k, who FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY src) AS n FROM (SELECT c_nationkey AS k, 'customer ' || min(c_custkey) AS who, 0 AS src FROM customer WHERE c_nationkey > 12 GROUP BY 1 UNION ALL SELECT s_nationkey, 'supplier ' || min(s_suppkey), 1 FROM supplier GROUP BY 1)) WHERE n = 1")
def _(t: Tables) -> DataFrame:
    a = t.customer.where("c_nationkey > 12").groupBy(F.col("c_nationkey").alias("k")).agg(F.concat(F.lit("customer "), F.min("c_custkey").cast("string")).alias("who"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.concat(F.lit("supplier "), F.min("s_suppkey").cast("string")).alias("who"))
    return R.priority_union([a, b], ["k"], [F.col("who")])


@query("u_02_keep_add", "SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey > 12 GROUP BY 1 UNION ALL SELECT s_nationkey, count(*) FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey > 12) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    a = t.customer.where("c_nationkey > 12").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return R.keep_and_add(a, t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n")), ["k"])


TOK = "tok AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(p_type, ' ')) AS b FROM part)"


@query("u_03_overlap", with_sql(TOK) + "SELECT p_partkey, len(list_intersect(a, b)) AS shared, len(list_distinct(list_concat(a, b))) AS every FROM tok")
def _(t: Tables) -> DataFrame:
    a, b = F.split("p_name", " "), F.split("p_type", " ")
    return t.part.select("p_partkey", F.size(F.array_intersect(a, b)).alias("shared"), F.size(F.array_union(a, b)).alias("every"))


@query("u_04_all_keys", "SELECT l_partkey FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3")
def _(t: Tables) -> DataFrame:
    return t.lineitem.where("l_returnflag IN ('A', 'N', 'R')").groupBy("l_partkey").agg(F.count_distinct("l_returnflag").alias("n")).where("n = 3").select("l_partkey")


@query("u_05_difference", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def _(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("k")).join(t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("k")), "k", "left_anti").distinct()


@query("u_06_subset", "SELECT l_orderkey, list_has_all(['A', 'R'], list(DISTINCT l_returnflag)) AS subset FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f")).select("l_orderkey", (F.size(F.array_except("f", F.array(F.lit("A"), F.lit("R")))) == 0).alias("subset"))


@query("u_07_distinct", "SELECT DISTINCT p_brand, p_size FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_brand", "p_size").distinct()


@query("u_08_bag", "SELECT 'part' AS kind, p_partkey AS id, p_size AS extra FROM part UNION ALL SELECT 'customer', c_custkey, NULL FROM customer")
def _(t: Tables) -> DataFrame:
    a = t.part.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_size").alias("extra"))
    return a.unionByName(t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id")), allowMissingColumns=True)
