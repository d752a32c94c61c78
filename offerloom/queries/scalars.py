"""Scalar functions over columns that the test tables give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import names as N
from ..functions import scalar as X
from ..functions import teeth as T
from ..registry import Tables, query

P = "SELECT p_partkey, "
EURO = "CASE WHEN p_partkey % 3 = 0 THEN replace(printf('%.2f', p_retailprice), '.', ',') || ' €' WHEN p_partkey % 3 = 1 THEN '1.' || printf('%03d', p_size) || ',5' ELSE 'n/d' END"


def euro_text():
    k, p = F.col("p_partkey") % 3, F.col("p_retailprice")
    return F.when(k == 0, F.concat(F.replace(F.format_string("%.2f", p), F.lit("."), F.lit(",")), F.lit(" €"))).when(k == 1, F.concat(F.lit("1."), F.format_string("%03d", F.col("p_size")), F.lit(",5"))).otherwise("n/d")


@query("x_01_normal_spaced", "SELECT n_nationkey, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS norm FROM nation")
def _(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", N.normal_spaced(F.col("n_name")).alias("norm"))


@query("x_07_slug", "SELECT page_id, coalesce(nullif(regexp_replace(substr(trim(regexp_replace(lower(strip_accents(url)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40), '-+$', ''), ''), 'doc') AS slug FROM pages")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", N.slug(F.col("url"), 40).alias("slug"))


@query("x_08_display", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) ELSE lower(c_mktsegment) END AS name FROM customer")
def _(t: Tables) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), F.upper("c_mktsegment"))).otherwise(F.lower("c_mktsegment"))
    return t.customer.select("c_custkey", N.display_name(raw).alias("name"))


@query("x_09_price", P + f"CAST(try_cast(CASE WHEN contains(e, ',') AND contains(e, '.') THEN replace(replace(e, '.', ''), ',', '.') ELSE replace(e, ',', '.') END AS DECIMAL(18, 2)) AS DOUBLE) AS price FROM (SELECT p_partkey, regexp_replace({EURO}, '[^0-9,.]', '', 'g') AS e FROM part)")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.price(euro_text()).cast("double").alias("price"))


@query("x_10_discount", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN 100 > 100 - l_discount * 100 THEN round(l_discount * 100, 1) END AS pct FROM lineitem")
def _(t: Tables) -> DataFrame:
    new = 100 - F.round(F.col("l_discount") * 100)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(X.discount(F.lit(100.0), new), 1).alias("pct"))


@query("x_11_dates", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) END AS VARCHAR) AS day FROM orders")
def _(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 2, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise("31/02/2020")
    return t.orders.select("o_orderkey", X.parsed_date(raw).cast("string").alias("day"))


@query("x_12_italian", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def _(t: Tables) -> DataFrame:
    months = F.array(*(F.lit(m) for m in X.MONTHS))
    raw = F.concat_ws(" ", F.dayofmonth("o_orderdate").cast("string"), F.initcap(F.element_at(months, F.month("o_orderdate"))), F.year("o_orderdate").cast("string"))
    return t.orders.select("o_orderkey", X.italian_date(raw).cast("string").alias("day"))


@query("x_13_path_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def _(t: Tables) -> DataFrame:
    tail = F.when(F.col("o_orderkey") % 2 == 0, "_v1.csv").otherwise("7.csv")
    return t.orders.select("o_orderkey", X.path_date(F.concat(F.lit("/in/lista_"), F.date_format("o_orderdate", "yyyy-MM-dd"), tail)).alias("day"))


@query("x_14_rome_day", "SELECT event_id, strftime(timezone('Europe/Rome', CAST(ts AS TIMESTAMP) AT TIME ZONE 'UTC'), '%Y-%m-%d') AS day FROM events")
def _(t: Tables) -> DataFrame:
    from .plain import rome_day

    return t.events.select("event_id", rome_day().cast("string").alias("day"))


@query("x_15_update_day", "SELECT event_id, strftime(CAST(r AS DATE) - CASE WHEN hour(r) < 12 THEN 1 ELSE 0 END, '%Y-%m-%d') AS day FROM (SELECT event_id, timezone('Europe/Rome', CAST(ts AS TIMESTAMP) AT TIME ZONE 'UTC') AS r FROM events)")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", X.update_day(F.col("ts").cast("timestamp")).cast("string").alias("day"))


@query("x_16_short_date", "SELECT o_orderkey, day(o_orderdate) || ' ' || ['gen','feb','mar','apr','mag','giu','lug','ago','set','ott','nov','dic'][month(o_orderdate)] || ' ' || year(o_orderdate) AS label FROM orders")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", X.short_date(F.col("o_orderdate")).alias("label"))


@query("x_17_canonical_url", "SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN contains(url, 'spam') THEN '?download=true' ELSE '' END AS url FROM pages")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.canonical_url(F.col("url"), "spam").alias("url"))


@query("x_18_absolute", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'https://x.org/' || page_id END AS url FROM pages")
def _(t: Tables) -> DataFrame:
    raw = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("/"), F.col("page_id").cast("string")))
    return t.pages.select("page_id", X.absolute_url(raw, "https://x.org").alias("url"))


@query("x_19_hashes", "SELECT doc_id, substr(sha1(text), 1, 8) AS short FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.short_hash(F.col("text")).alias("short"))


@query("x_20_asset_type", "SELECT event_id, CASE event_type WHEN 'view' THEN 'ifu' WHEN 'click' THEN 'sds' WHEN 'purchase' THEN 'brochure' ELSE 'other' END AS kind FROM events")
def _(t: Tables) -> DataFrame:
    e = F.col("event_type")
    raw = F.when(e == "view", " Instructions for Use ").when(e == "click", "new safety data sheet, 2020").when(e == "purchase", "Opuscolo").otherwise("something")
    return t.events.select("event_id", X.asset_type(raw).alias("kind"))


@query("x_24_values", "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS name, CASE WHEN c_custkey % 4 > 0 THEN CAST(c_nationkey AS DOUBLE) END AS n FROM customer")
def _(t: Tables) -> DataFrame:
    name = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("  "), "c_name")).otherwise("   ")
    n = F.when(F.col("c_custkey") % 4 > 0, F.col("c_nationkey").cast("string")).otherwise("NaN")
    return t.customer.select("c_custkey", X.trimmed(name).alias("name"), X.finite(n).alias("n"))


@query("x_27_json_array", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def _(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("here you are: ["), "props", F.lit("] as asked"))
    return t.events.select("event_id", X.first_array(raw, "array<struct<k:bigint>>")[0]["k"].alias("k")).where("k IS NOT NULL")


@query("x_28_escape", "SELECT p_partkey, replace(replace('%' || p_name || '_x', '%', '\\%'), '_', '\\_') AS pattern FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.escaped(F.concat(F.lit("%"), "p_name", F.lit("_x"))).alias("pattern"))


def answer():
    """A generated answer for each part, with placeholders before the real sections."""
    return F.concat(
        F.lit("DESCRIZIONE:\n<tre o quattro frasi sul prodotto>\nTAG:\n#[nome tag]\n\nDESCRIZIONE:\n"), F.lit("Un prodotto di qualità per lo studio, adatto a ogni uso: "), "p_name",
        F.lit(".\nTAG:\n#["), "p_brand", F.lit("] #["), "p_type", F.lit("] #[salute dentale]\n\nFAQ:\nD1: A che cosa serve "), "p_name",
        F.lit("?\nR1: Serve a lavorare bene, ogni giorno.\nD2: no\nR2: corta\nFINE\n"),
    )


def answers(t: Tables) -> DataFrame:
    """Answers of five shapes, by the part's number: whole; without a description mark; with a page's tail; unfinished; a page of results."""
    p, short = F.col("p_name"), F.col("p_brand")
    told = F.concat(F.lit("Un prodotto di qualità per lo studio e per il laboratorio, adatto a ogni uso quotidiano: "), p, F.lit("."))
    tag_line = F.concat(F.lit("TAG: #["), short, F.lit("] #["), F.col("p_type"), F.lit("] #[salute dentale]\n"))
    ask = lambda n: F.concat(F.lit(f"D{n}: A che cosa serve al {n} "), p, F.lit(f"?\nR{n}: Serve a lavorare bene, ogni giorno {n}."))
    faq = F.concat(F.lit("\nFAQ:\n"), ask(1), F.lit("\n"), ask(2), F.lit("\n"), ask(3))
    hint = F.lit("DESCRIZIONE:\n<tre o quattro frasi sul prodotto>\nTAG:\n#[nome tag]\n\n")
    shapes = [
        F.concat(hint, F.lit("DESCRIZIONE:\n"), told, F.lit("\n"), tag_line, faq, F.lit("\nD4: no\nR4: corta\nFINE\n")),
        F.concat(F.lit("MISSIONE: rispondi\n"), told, F.lit("\n"), tag_line, faq, F.lit("\nFINE")),
        F.concat(F.lit("DESCRIZIONE:\n"), told, F.lit("\n\nAltro paragrafo.\n"), tag_line, faq, F.lit(" Le risposte dell'AI possono contenere errori.\nFINE\n")),
        F.concat(F.lit("DESCRIZIONE:\n"), told, F.lit("\n"), tag_line, F.lit("AI Mode sta pensando")),
        F.concat(F.lit("Ha cercato 12 siti\nRisultati: www.x.it "), p),
    ]
    return t.part.select("p_partkey", "p_name", F.element_at(F.array(*shapes), F.col("p_partkey").cast("int") % 5 + 1).alias("text"))


@query("x_29_tags", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN '' ELSE replace(lower(CASE WHEN replace(p_brand, '-', ' ') = replace(p_type, '-', ' ') THEN p_brand ELSE p_brand || '|' || p_type END), '-', ' ') END AS tags FROM part")
def _(t: Tables) -> DataFrame:
    return answers(t).select("p_partkey", F.array_join(A.parsed(F.col("text"))["tags"], "|").alias("tags"))


@query("x_30_description", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN '' ELSE 'Un prodotto di qualità per lo studio e per il laboratorio, adatto a ogni uso quotidiano: ' || p_name || '.' END AS text FROM part")
def _(t: Tables) -> DataFrame:
    return answers(t).select("p_partkey", A.parsed(F.col("text"))["description"].alias("text"))


@query("x_31_faq", "SELECT p_partkey, CASE WHEN p_partkey % 5 < 3 THEN 3 ELSE 0 END AS pairs, CASE WHEN p_partkey % 5 < 3 THEN 'A che cosa serve al 3 ' || p_name || '?' END AS question, CASE WHEN p_partkey % 5 < 3 THEN 'Serve a lavorare bene, ogni giorno 3.' END AS answer FROM part")
def _(t: Tables) -> DataFrame:
    faq = A.parsed(F.col("text"))["faq"]
    last = F.get(F.col("faq"), F.lit(2))
    return answers(t).select("p_partkey", faq.alias("faq")).select("p_partkey", F.size("faq").alias("pairs"), last["question"].alias("question"), last["answer"].alias("answer"))


@query("x_32_complete", "SELECT p_partkey, p_partkey % 5 < 3 AS ended, p_partkey % 5 = 3 AS generating, p_partkey % 5 = 4 AS results, p_partkey % 5 < 3 AS complete FROM part")
def _(t: Tables) -> DataFrame:
    text = F.col("text")
    return answers(t).select("p_partkey", A.ended(text).alias("ended"), A.generating(text).alias("generating"), A.result_page(text).alias("results"), A.complete(text).alias("complete"))


@query("x_33_card_key", "SELECT l_orderkey, (l_linenumber - 1) || '-' || l_suppkey || '-' || l_partkey AS card FROM lineitem")
def _(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", X.card_key(F.col("l_linenumber") - 1, F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")).alias("card"))


@query("x_34_quantity", "SELECT l_orderkey, CAST(greatest(1, floor(l_quantity / 10)) AS BIGINT) AS q FROM lineitem")
def _(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", X.quantity(F.col("l_quantity") / 10).cast("long").alias("q"))


@query("x_35_euro", "SELECT p_partkey, replace(replace(replace(format('{:,.2f}', p_size * 12345 / 100.0), ',', '#'), '.', ','), '#', '.') || chr(160) || '€' AS price FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.euro(F.col("p_size") * 12345).alias("price"))


@query("x_36_title", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name || ' — risparmi ' || p_size || ' su ' || p_brand ELSE p_name END AS title FROM part")
def _(t: Tables) -> DataFrame:
    gain = F.concat_ws("", "p_name", F.lit(" — risparmi "), F.col("p_size").cast("string"), F.lit(" su "), "p_brand")
    return t.part.select("p_partkey", F.when(F.col("p_size") > 25, gain).otherwise(F.col("p_name")).alias("title"))


@query("x_37_emoji", "SELECT p_partkey, p_name AS name FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.stripped(F.concat(F.lit("🔥 "), F.replace("p_name", F.lit(" "), F.lit("  ")), F.lit(" ✅️"))).alias("name"))


@query("x_38_megabytes", "SELECT doc_id, printf('%.2f Mb', n_chars * 1000 / 1048576.0) AS size FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.megabytes(F.col("n_chars") * 1000).alias("size"))


@query("x_39_teeth", "SELECT CAST(q * 10 + n AS VARCHAR) AS fdi, CAST(CASE q WHEN 1 THEN 9 - n WHEN 2 THEN 8 + n WHEN 3 THEN 25 - n ELSE 24 + n END AS VARCHAR) AS universal, n || ['┘', '└', '┌', '┐'][q] AS palmer_label, n = 8 AS wisdom FROM range(1, 5) a(q), range(1, 9) b(n)")
def _(t: Tables) -> DataFrame:
    x = T.teeth(t.spark)
    return x.select("fdi", "universal", T.palmer(x).alias("palmer_label"), "wisdom")


@query("a_29_quadrants", "SELECT q AS quadrant, string_agg(CAST(q * 10 + n AS VARCHAR), ',' ORDER BY n) AS teeth FROM range(1, 5) a(q), range(1, 9) b(n) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return T.by_quadrant(T.teeth(t.spark))


@query("x_40_round_cut", "SELECT p_partkey, round(CAST(p_size AS DOUBLE) / 7, 1) AS r, substr(p_name, 1, 5) AS name FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(F.col("p_size") / 7.0, 1).alias("r"), F.substring("p_name", 1, 5).alias("name"))


KIND = "CASE p_size % 6 WHEN 0 THEN 'type' WHEN 1 THEN 'brand_line' WHEN 2 THEN 'sku' WHEN 3 THEN 'type_weak' WHEN 4 THEN 'type_or_line' ELSE 'unknown' END"


@query("x_41_classify", f"SELECT p_partkey, CASE WHEN k IN ('sku', 'attr', 'weak') THEN 'skip' WHEN k = 'type_weak' THEN CASE WHEN n >= 200 THEN 'enrich' ELSE 'skip' END WHEN hub AND n >= 50 AND c >= 0.25 THEN 'hub' WHEN hub AND n >= 25 THEN 'enrich' WHEN k = 'brand_line' THEN CASE WHEN n >= 200 AND c >= 0.45 THEN 'hub' ELSE 'enrich' END WHEN k IN ('type', 'type_or_line') AND n >= 40 AND c >= 0.3 THEN 'hub' ELSE 'enrich' END AS action FROM (SELECT p_partkey, {KIND} AS k, p_partkey % 300 AS n, p_size / 50.0 AS c, contains(p_name, 'blue') AS hub FROM part)")
def _(t: Tables) -> DataFrame:
    kinds = F.array(*(F.lit(k) for k in ("type", "brand_line", "sku", "type_weak", "type_or_line", "unknown")))
    label = F.when(F.col("p_name").contains("blue"), "frese").otherwise(F.col("p_name"))
    return t.part.select("p_partkey", X.hub_action(label, F.col("p_partkey") % 300, F.col("p_size") / 50.0, F.element_at(kinds, F.col("p_size") % 6 + 1), ["frese"]).alias("action"))


@query("x_42_title_family", "SELECT p_partkey, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_size DESC, p_partkey) = 1 AS hub FROM part")
def _(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    return t.part.select("p_partkey", (F.row_number().over(Window.partitionBy(F.lower("p_name")).orderBy(F.desc("p_size"), "p_partkey")) == 1).alias("hub"))


@query("x_43_fingerprint", "SELECT l_orderkey, printf('%.2f', sum(CAST(l_quantity AS BIGINT)) / 100.0) || '::' || string_agg(l_linenumber || ':' || l_suppkey, '|' ORDER BY l_linenumber || ':' || l_suppkey) AS print FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    row = F.concat_ws(":", F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string"))
    return t.lineitem.groupBy("l_orderkey").agg(X.fingerprint(F.collect_list(row), F.sum(F.col("l_quantity").cast("long"))).alias("print"))


@query("x_44_attachments", "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS first, len(string_split(o_orderpriority, '-')) - 1 AS rest FROM orders")
def _(t: Tables) -> DataFrame:
    parts = F.split("o_orderpriority", "-")
    return t.orders.select("o_orderkey", F.element_at(parts, 1).alias("first"), F.size(F.slice(parts, F.lit(2), F.size(parts))).alias("rest"))
