"""Mutations, imports and the change feed over snapshots that the test tables give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import mutate as M
from ..operators import relational as R
from ..registry import Tables, query
from ..sources.adapters import with_sql

OLD_SQL = "old AS (SELECT c_custkey AS id, c_name AS name, c_nationkey AS version, true AS active FROM customer WHERE c_custkey % 3 > 0)"
NEW_SQL = "new AS (SELECT c_custkey AS id, upper(c_name) AS name, CASE WHEN c_custkey % 7 > 0 THEN (c_nationkey + c_custkey) % 25 END AS version, true AS active FROM customer WHERE c_custkey % 4 > 0)"
MERGED = "SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.name ELSE o.name END AS name, CASE WHEN n.id IS NOT NULL THEN n.version ELSE o.version END AS version, CASE WHEN n.id IS NOT NULL THEN n.active ELSE o.active END AS active FROM old o FULL JOIN new n ON o.id = n.id"


def old(t: Tables) -> DataFrame:
    return t.customer.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("version"), F.lit(True).alias("active"))


def new(t: Tables) -> DataFrame:
    version = F.when(F.col("c_custkey") % 7 > 0, (F.col("c_nationkey") + F.col("c_custkey")) % 25)
    return t.customer.where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("id"), F.upper("c_name").alias("name"), version.alias("version"), F.lit(True).alias("active"))


@query("m_01_upsert", with_sql(OLD_SQL, NEW_SQL) + MERGED)
def _(t: Tables) -> DataFrame:
    return M.upsert(old(t), new(t), ["id"])


@query("m_02_upsert_batches", "SELECT l_partkey, l_suppkey, max_by(l_quantity, l_orderkey * 1000000 + l_linenumber * 100 + l_quantity) AS quantity FROM lineitem GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("k", F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100 + F.col("l_quantity")).select("l_partkey", "l_suppkey", F.col("l_quantity").alias("quantity"), "k")
    early, late = rows.where("quantity <= 25"), rows.where("quantity > 25")
    keys = ["l_partkey", "l_suppkey"]
    first, second = (M.last_wins(x, keys, [F.desc("k")]) for x in (early, late))
    # the later batch wins only where it is later in the feed
    return M.upsert_newer(first, second, keys, "k").drop("k")


@query("m_03_newer_only", with_sql(OLD_SQL, NEW_SQL, "fresh AS (SELECT n.* FROM new n LEFT JOIN old o ON o.id = n.id WHERE o.id IS NULL OR o.version IS NULL OR n.version IS NULL OR n.version >= o.version)") + MERGED.replace("JOIN new n", "JOIN fresh n"))
def _(t: Tables) -> DataFrame:
    return M.upsert_newer(old(t), new(t), ["id"], "version")


@query("m_04_backfill", with_sql(OLD_SQL, NEW_SQL) + "SELECT * FROM old UNION ALL SELECT * FROM new WHERE id NOT IN (SELECT id FROM old)")
def _(t: Tables) -> DataFrame:
    return M.backfill(old(t), new(t), ["id"])


@query("m_05_first_seen", with_sql(OLD_SQL, NEW_SQL) + "SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.name ELSE o.name END AS name, coalesce(o.version, n.version) AS version, coalesce(n.active, o.active) AS active FROM old o FULL JOIN new n ON o.id = n.id")
def _(t: Tables) -> DataFrame:
    return M.upsert(old(t), new(t), ["id"], keep_old=["version"])


@query("m_06_deactivate", with_sql(OLD_SQL, NEW_SQL) + "SELECT id, name, version, id IN (SELECT id FROM new) AS active FROM old")
def _(t: Tables) -> DataFrame:
    return M.deactivate_missing(old(t), new(t), ["id"])


@query("m_07_delete_present", with_sql(OLD_SQL, NEW_SQL) + "SELECT id, name, version, active, id IN (SELECT id FROM new WHERE version > 12) AS deleted FROM old")
def _(t: Tables) -> DataFrame:
    left, gone = M.delete_present(old(t), new(t).where("version > 12"), ["id"])
    return left.withColumn("deleted", F.lit(False)).unionByName(gone.withColumn("deleted", F.lit(True)))


@query("m_08_replace_links", "SELECT l_orderkey AS parent, l_partkey AS child FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P'")
def _(t: Tables) -> DataFrame:
    links = t.lineitem.select(F.col("l_orderkey").alias("parent"), F.col("l_partkey").alias("child"))
    return M.replace_children(links, t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("parent"), F.col("o_custkey").alias("child")), "parent")


@query("m_09_replace_run", "SELECT CASE WHEN p_size > 25 THEN 'b' ELSE 'a' END AS run_key, p_partkey, CASE WHEN p_size > 25 THEN 2 ELSE 1 END AS version FROM part")
def _(t: Tables) -> DataFrame:
    """Two runs are written, then one is replaced: only its partition is overwritten."""
    path = t.scratch("runs")
    rows = t.part.select(F.when(F.col("p_size") > 25, "b").otherwise("a").alias("run_key"), "p_partkey")
    rows.withColumn("version", F.lit(1)).write.partitionBy("run_key").parquet(path)
    rows.where("run_key = 'b'").withColumn("version", F.lit(2)).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("run_key").parquet(path)
    return t.spark.read.parquet(path)


@query("m_10_patch", "SELECT c_custkey AS id, 'x' AS a, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS b, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS c FROM customer")
def _(t: Tables) -> DataFrame:
    o = t.customer.select(F.col("c_custkey").alias("id"), F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("old")).alias("other"))
    p = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.create_map(F.lit("b"), F.lit("new"), F.lit("c"), F.col("c_name")).alias("other"))
    return M.patched(o, p, ["id"], "other").select("id", *(F.try_element_at("other", F.lit(k)).alias(k) for k in "abc"))


@query("m_11_soft_delete", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_totalprice < 5000 THEN '2000-01-01' END AS removed_at FROM orders")
def _(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("removed_at"))
    return M.stamped(rows, F.col("o_totalprice") < 5000, "removed_at", F.lit("2000-01-01")).select("o_orderkey", "removed_at")


@query("m_12_get_or_create", "SELECT slug, max(label) AS label FROM (SELECT lower(n_name) AS slug, n_name AS label FROM nation WHERE n_nationkey < 10 UNION ALL SELECT lower(n_name), 'created' FROM nation WHERE n_nationkey >= 10) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    dimension = t.nation.where("n_nationkey < 10").select(F.lower("n_name").alias("slug"), F.col("n_name").alias("label"))
    return M.get_or_create(dimension, t.nation.select(F.lower("n_name").alias("slug")), "slug", {"label": F.lit("created")})


@query("m_13_validated_append", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase') AND user_id IS NOT NULL")
def _(t: Tables) -> DataFrame:
    path = t.scratch("log")
    for kind in ("click", "purchase", "unknown"):
        ok = F.col("event_type").isin("click", "purchase") & F.col("user_id").isNotNull()
        t.events.where(ok & (F.col("event_type") == kind)).select("event_id", "event_type").write.mode("append").parquet(path)
    return t.spark.read.parquet(path)


@query("m_14_checksum_skip", "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 5 = 0)")
def _(t: Tables) -> DataFrame:
    stored = t.documents.where("doc_id % 5 = 0").select(F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))
    files = t.documents.select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return M.unchanged(files, stored).select("doc_id", "sha256")


@query("m_15_patch_labels", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'hub' WHEN 1 THEN 'enrich' ELSE 'skip' END AS action FROM part")
def _(t: Tables) -> DataFrame:
    labels = t.spark.createDataFrame([(0, "hub"), (1, "enrich")], "k int, action string")
    return t.part.withColumn("k", F.col("p_size") % 4).join(labels, "k", "left").select("p_partkey", F.coalesce("action", F.lit("skip")).alias("action"))


FEED = "CASE WHEN event_type IN ('view', 'signup') THEN 'INSERT' WHEN event_type = 'error' THEN 'DELETE' ELSE 'UPDATE' END"


def feed(t: Tables) -> DataFrame:
    op = F.when(F.col("event_type").isin("view", "signup"), "INSERT").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    return t.events.select("user_id", "event_id", "value", op.alias("op"))


@query("t_01_change_fold", f"SELECT user_id, event_id, value FROM (SELECT *, {FEED} AS op FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE op <> 'DELETE'")
def _(t: Tables) -> DataFrame:
    empty = feed(t).select("user_id", "event_id", "value").limit(0)
    return M.fold(empty, feed(t), "user_id", [F.desc("event_id")])


@query("m_16_crud", f"SELECT user_id, event_id, value FROM (SELECT *, {FEED} AS op FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE op <> 'DELETE' UNION ALL SELECT -1, -1, 0.0")
def _(t: Tables) -> DataFrame:
    base = t.spark.createDataFrame([(-1, -1, 0.0)], "user_id long, event_id long, value double")
    return M.fold(base, feed(t), "user_id", [F.desc("event_id")])


@query("t_05_owner", "SELECT p_partkey, CAST(('0x' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 8))::BIGINT % 4 AS BIGINT) AS worker FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", (F.conv(F.substring(F.md5(F.col("p_partkey").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 4).alias("worker"))


@query("t_06_day_windows", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    w = F.window(F.col("ts").cast("timestamp"), "1 day")
    return t.events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


HISTORY_SQL = "priced AS (SELECT l_partkey AS aic, CAST(l_shipdate AS DATE) AS published, CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS price, l_returnflag AS note, l_orderkey * 100 + l_linenumber AS k FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, CAST(l_shipdate AS DATE) ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) = 1)"


def priced(t: Tables) -> DataFrame:
    """The price state of each part on each day it shipped: the last line of the day."""
    rows = t.lineitem.select(F.col("l_partkey").alias("aic"), F.col("l_shipdate").cast("date").alias("published"), F.floor(F.col("l_discount") * 100 + 0.5).cast("long").alias("price"), F.col("l_returnflag").alias("note"), "l_orderkey", "l_linenumber", "l_suppkey")
    return R.first_by(rows, ["aic", "published"], [F.desc("l_orderkey"), F.desc("l_linenumber"), F.desc("l_suppkey")]).select("aic", "published", "price", "note")


@query("w_05_sparse_history", with_sql(HISTORY_SQL) + "SELECT aic, CAST(published AS VARCHAR) AS published, price, note FROM priced WINDOW w AS (PARTITION BY aic ORDER BY published) QUALIFY lag(price) OVER w IS NULL OR lag(price) OVER w <> price OR lag(note) OVER w <> note")
def _(t: Tables) -> DataFrame:
    return R.change_points(priced(t), ["aic"], [F.col("published")], ["price", "note"]).withColumn("published", F.col("published").cast("string"))


@query("w_08_last_before", with_sql(HISTORY_SQL) + "SELECT aic, CAST(max(published) AS VARCHAR) AS published, arg_max(price, published) AS price FROM priced WHERE published < DATE '1997-01-01' GROUP BY 1")
def _(t: Tables) -> DataFrame:
    before = priced(t).where(F.col("published") < F.lit("1997-01-01").cast("date"))
    return before.groupBy("aic").agg(F.max("published").cast("string").alias("published"), F.max_by("price", "published").alias("price"))


@query("w_19_series", with_sql(HISTORY_SQL) + "SELECT aic, CAST(published AS VARCHAR) AS published, coalesce(CASE WHEN price % 2 = 0 THEN price END, CASE WHEN note <> 'N' THEN price END) AS reference, coalesce(CASE WHEN note <> 'N' THEN price END, CASE WHEN price % 2 = 0 THEN price END) AS public FROM priced")
def _(t: Tables) -> DataFrame:
    a, b = F.when(F.col("price") % 2 == 0, F.col("price")), F.when(F.col("note") != "N", F.col("price"))
    return priced(t).select("aic", F.col("published").cast("string").alias("published"), F.coalesce(a, b).alias("reference"), F.coalesce(b, a).alias("public"))


@query("t_04_claim", "SELECT p_partkey AS id, CASE WHEN n <= 8 THEN 'claimed' ELSE 'pending' END AS status, CASE WHEN n <= 5 THEN 'w1' WHEN n <= 8 THEN 'w2' END AS worker FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS n FROM part)")
def _(t: Tables) -> DataFrame:
    from ..operators import work

    path = t.scratch("queue")
    work.build(t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), path)
    work.claim(t.spark, path, "w1", 5)
    work.claim(t.spark, path, "w2", 3)
    return work.latest(t.spark, path)[1].select("id", "status", "worker")
