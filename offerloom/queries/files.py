"""Sources and sinks by round trips through the shared folder; imports; streams against their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import relational as R
from ..plans import imports as I
from ..registry import Tables, query
from ..sources import files as S
from ..sources.adapters import LINE_SQL, OFFER_SQL, REQUEST_SQL, SHOP_SQL, TIER_SQL, lines, with_sql
from ..sources.lists import list_rows, lists
from ..sources.sitemaps import opened, read_sitemap, write_sitemap
from ..streaming import feed as FEED
from .mutations import feed
from .plain import CND_CODE, CND_PREFIXES, CND_VALUES


@query("s_02_json_lines", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS product_name, p_brand AS brand FROM part WHERE p_size % 5 > 0")
def _(t: Tables) -> DataFrame:
    path = t.scratch("products")
    rows = t.part.select(F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_size") % 5 > 0, F.col("p_name")).otherwise(" ").alias("product_name"), F.col("p_brand").alias("brand"), F.lit("e1").alias("ecommerce_id"))
    rows.write.json(path)
    return S.json_lines(t.spark, path).select("id", "product_name", "brand")


@query("s_03_shop_lookup", "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name FROM supplier")
def _(t: Tables) -> DataFrame:
    path = t.scratch("shops")
    row = F.to_json(F.struct(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name")))
    t.supplier.agg(F.concat(F.lit("["), F.array_join(F.collect_list(row), ","), F.lit("]")).alias("value")).write.text(path)
    return S.lookup(t.spark, path)


def lay_out_lists(part: DataFrame, path: str) -> None:
    """Price lists of parts under ``path``, by day, as files, folders and archives in several encodings; each day's poorer lists hold other rows."""
    import datetime
    import io
    import zipfile

    store, at = opened(path)
    wrong = "AIC;Farmaco;Prezzo Pubblico\n0;WRONG;0\n".encode()

    def put(name: str, raw: bytes) -> None:
        store.create_dir(f"{at}/{name}".rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(f"{at}/{name}") as out:
            out.write(raw)

    def zipped(**members: bytes) -> bytes:
        box = io.BytesIO()
        with zipfile.ZipFile(box, "w", zipfile.ZIP_DEFLATED) as z:
            for name, raw in members.items():
                z.writestr(f"{name}.csv", raw)
        return box.getvalue()

    head = "AIC;Farmaco;Prezzo Pubblico"
    line = F.concat_ws(";", F.col("p_partkey").cast("string"), "p_name", F.concat(F.col("p_size").cast("string"), F.lit(",50 €")))
    for k in range(5):
        day = datetime.date(2026, 7, 1) + datetime.timedelta(k)
        text = lambda first=head: "\n".join([first, *(r.v for r in part.where(F.col("p_partkey") % 5 == k).select(line.alias("v")).toLocalIterator())])  # noqa: B023, E731
        if k == 0:
            put(f"{day}_liste/Lista_farmaci_equivalenti.csv", text().encode("cp1252"))
            put(f"{day}_liste/altro_equivalenti.csv", wrong)
            put(f"{day}_liste/lista_per_principio_attivo.csv", wrong)
        elif k == 1:
            put(f"{day}.zip", zipped(elenco=wrong, trasparenza_nome_commerciale=wrong, elenco_trasparenza=text().encode("utf-8-sig")))
        elif k == 2:
            put(f"a-{day}.zip", zipped(lista_farmaci_equivalenti=wrong))
            put(f"b_{day}/x.csv", text().encode("cp1252"))
        elif k == 3:
            put(f"y/{day}/due.csv", wrong)
            put(f"z/{day}/equivalenti.csv", text().encode("cp1252"))
        else:
            put("zz/elenco.csv", text(f"AIC;Farmaco;Prezzo Pubblico {day.day} luglio {day.year}").encode("cp1252"))


@query("s_04_json_array", "SELECT o_orderkey AS k, o_orderstatus || ', [' || o_orderpriority || '}' AS name FROM orders")
def _(t: Tables) -> DataFrame:
    """Orders as files that are one array each, read back by byte ranges."""
    path = t.scratch("orders")
    name = F.concat("o_orderstatus", F.lit(", ["), "o_orderpriority", F.lit("}"))
    row = F.to_json(F.struct(F.col("o_orderkey").alias("k"), name.alias("name")))
    arrays = t.orders.groupBy(F.floor(F.col("o_orderkey") / 8000).alias("file")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(row), ",\n"), F.lit("]")).alias("value"))
    arrays.write.partitionBy("file").text(path)
    return S.json_array(t.spark, f"{path}/*", "k long, name string")


@query("s_05_dated_list", "SELECT CAST(p_partkey AS VARCHAR) AS aic, p_name AS medicine, CAST(p_size AS VARCHAR) || ',50' AS public_price FROM part")
def _(t: Tables) -> DataFrame:
    path = t.scratch("list")
    rows = t.part.select(F.col("p_partkey").alias("AIC"), F.col("p_name").alias("Farmaco"), F.concat(F.col("p_size").cast("string"), F.lit(",50")).alias("Prezzo Pubblico 15 luglio 2026"))
    rows.write.csv(path, sep=";", header=True, encoding="iso-8859-1")
    return S.delimited(t.spark, path).select("aic", "medicine", "public_price")


@query("s_06_resolve", "SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n, min(p_name) AS least, max(euro) AS price FROM (SELECT *, DATE '2026-07-01' + CAST(p_partkey % 5 AS INTEGER) AS day, CAST(p_size AS VARCHAR) || ',50 €' AS euro FROM part) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Five days of lists, each with another best place: a folder beside poorer names, an archive, a loose file, a later path, a header."""
    path = t.scratch("lists")
    lay_out_lists(t.part, path)
    rows = list_rows(lists(t.spark, path))
    return rows.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("medicine").alias("least"), F.max("public_price").alias("price"))


@query("s_07_cards", """SELECT page_id, href, label FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)) AS href, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)<', 1)) AS label, unnest(range(len(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)))) AS pos FROM pages) QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY pos) = 1""")
def _(t: Tables) -> DataFrame:
    return S.link_cards(t.pages).select("page_id", "href", "label")


@query("s_08_payload", "SELECT event_id, props FROM events WHERE props IS NOT NULL AND starts_with(props, '{')")
def _(t: Tables) -> DataFrame:
    onclick = F.concat(F.lit("go(1); setGoogleTagManagerProductClick( "), "props", F.lit(", 'x}'); return"))
    return t.events.select("event_id", S.payload(onclick, "setGoogleTagManagerProductClick(").alias("props")).where("props IS NOT NULL")


@query("s_09_jsonp", "SELECT event_id, props FROM events WHERE length(props) > 0")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", S.jsonp(F.concat(F.lit("cb_1("), "props", F.lit(");"))).alias("props")).where("props IS NOT NULL")


@query("s_11_page_plan", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN array_to_string(range(p_size, p_size + 4), ',') ELSE CASE WHEN p_size = 3 THEN '3' WHEN p_size < 3 THEN p_size || ',3' ELSE '3,' || p_size END END AS pages FROM part")
def _(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("string")
    plan = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws("-", size, (F.col("p_size") + 3).cast("string"))).otherwise(F.concat(size, F.lit(", 3, "), size))
    return t.part.select("p_partkey", F.array_join(F.transform(S.page_plan(plan), lambda x: x.cast("string")), ",").alias("pages"))


@query("s_12_dump", "SELECT p_partkey, p_name FROM part")
def _(t: Tables) -> DataFrame:
    return S.dump(t.part.select("p_partkey", "p_name"), t.scratch("dump"), "p_partkey")


@query("s_13_json_sink", "SELECT o_orderkey, o_orderpriority FROM orders")
def _(t: Tables) -> DataFrame:
    path, rows = t.scratch("sink"), t.orders.select("o_orderkey", "o_orderpriority")
    S.json_sink(rows.where("o_orderkey % 2 = 0"), path)
    return S.json_sink(rows.where("o_orderkey % 2 <> 0"), path, add=True)


@query("s_14_report", "SELECT p_brand AS section, count(*) AS n FROM part GROUP BY 1")
def _(t: Tables) -> DataFrame:
    sections = t.part.groupBy(F.col("p_brand").alias("section")).agg(F.count(F.lit(1)).alias("n"))
    assigned = t.part.select("p_partkey", F.col("p_brand").alias("section"))
    written_ = S.report({"sections": sections, "assignments": assigned}, t.scratch("report"))
    return written_["assignments"].groupBy("section").agg(F.count(F.lit(1)).alias("n")).join(written_["sections"], ["section", "n"])


@query("s_15_text_export", with_sql(REQUEST_SQL) + "SELECT basket_id, string_agg(quantity || ' x product ' || product_id || ' ' || printf('%.2f', quantity * 100 / 100.0), chr(10) ORDER BY query_index) || chr(10) || 'Totale ' || printf('%.2f', sum(quantity * 100)::BIGINT / 100.0) AS text FROM request GROUP BY 1")
def _(t: Tables) -> DataFrame:
    from ..sources.adapters import requests

    r = requests(t).withColumn("name", F.concat(F.lit("product "), F.col("product_id").cast("string"))).withColumn("line", F.col("quantity") * 100)
    return S.basket_text(r)


@query("s_18_sitemap", "SELECT CAST(chunk AS INTEGER) AS chunk, CAST(count(*) AS INTEGER) AS n, true AS listed FROM (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 10000 AS chunk FROM orders) WHERE chunk < 32 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    path = t.scratch("sitemap")
    urls = R.paged([t.orders.select("o_orderkey")], "o_orderkey").select("chunk", F.concat(F.lit("https://x.org/o?a=1&id=<"), F.col("o_orderkey").cast("string")).alias("loc"))
    write_sitemap(urls, path, "https://x.org")
    return read_sitemap(t.spark, path)


@query("f_12_size_scope", "SELECT doc_id, n_chars >= 2000 AS full_dump FROM documents WHERE n_chars < 2000 OR lang = 'en'")
def _(t: Tables) -> DataFrame:
    return t.documents.where((F.col("n_chars") < 2000) | (F.col("lang") == "en")).select("doc_id", (F.col("n_chars") >= 2000).alias("full_dump"))


RELEASES = """rel AS (SELECT p_partkey AS aic, p_brand AS ingredient, p_type AS company, p_size AS price, 1 AS r FROM part WHERE p_partkey % 3 > 0
UNION ALL SELECT p_partkey, p_brand, p_type, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE p_size + 1 END, 2 FROM part WHERE p_partkey % 4 > 0)"""


def two_releases(t: Tables) -> dict[str, DataFrame]:
    none = {
        "ingredients": t.spark.createDataFrame([], "ingredient string, first_release int"),
        "medicines": t.spark.createDataFrame([], "aic long, ingredient string, company string, price int, note string, first_release int, active boolean"),
        "history": t.spark.createDataFrame([], "aic long, published date, price int, note string"),
    }
    base = t.part.select(F.col("p_partkey").alias("aic"), F.col("p_brand").alias("ingredient"), F.col("p_type").alias("company"), F.col("p_size").alias("price"), F.lit("n").alias("note"))
    one = I.import_release(none, base.where("aic % 3 > 0"), 1, "2024-01-15", True)
    return I.import_release(one, base.where("aic % 4 > 0").withColumn("price", F.when(F.col("aic") % 2 == 0, F.col("price")).otherwise(F.col("price") + 1)), 2, "2024-02-15", True)


@query("g_17_import", with_sql(RELEASES) + "SELECT aic, arg_max(price, r) AS price, CAST(min(r) AS INTEGER) AS first_release, max(r) = 2 AS active FROM rel GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return two_releases(t)["medicines"].select("aic", "price", "first_release", "active")


@query("g_17_history", with_sql(RELEASES) + "SELECT aic, CASE r WHEN 1 THEN '2024-01-15' ELSE '2024-02-15' END AS published, price FROM (SELECT *, lag(price) OVER (PARTITION BY aic ORDER BY r) AS p FROM rel) WHERE p IS NULL OR p <> price")
def _(t: Tables) -> DataFrame:
    return two_releases(t)["history"].select("aic", F.col("published").cast("string").alias("published"), "price")


@query("g_18_devices", f"WITH src AS (SELECT p_partkey AS key, {CND_CODE} AS code, p_size AS begins FROM part WHERE p_partkey % 5 > 0), pre(prefix) AS (VALUES {CND_VALUES}), ok AS (SELECT s.*, EXISTS (SELECT 1 FROM pre WHERE starts_with(upper(trim(code)), prefix)) AS inside FROM src s), old AS (SELECT p_partkey AS key, 'old' AS code, 25 AS begins FROM part WHERE p_partkey % 2 = 0) SELECT coalesce(o.key, n.key) AS key, CASE WHEN n.inside AND (o.key IS NULL OR n.begins >= 25) THEN n.code ELSE o.code END AS code FROM old o FULL JOIN ok n ON o.key = n.key WHERE (n.key IS NULL) OR n.inside")
def _(t: Tables) -> DataFrame:
    head = F.when(F.col("p_partkey") % 4 == 0, "q0101").when(F.col("p_partkey") % 4 == 1, " T0302").when(F.col("p_partkey") % 4 == 2, "D0").otherwise("X9")
    day = lambda c: F.date_add(F.lit("2024-01-01").cast("date"), c)
    rows = t.part.where("p_partkey % 5 > 0").select(F.col("p_partkey").alias("key"), F.concat(head, F.lpad(F.col("p_size").cast("string"), 4, "0")).alias("code"), day(F.col("p_size")).alias("begins"), F.lit(None).cast("date").alias("ends"), F.lit(0).alias("seq"))
    old = t.part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("key"), F.lit("old").alias("code"), day(F.lit(25)).alias("begins"))
    return I.import_devices(old, rows, CND_PREFIXES, 1000).select("key", "code")


@query("s_19_feed_stream", "SELECT user_id, event_id FROM (SELECT *, CASE WHEN event_type IN ('view', 'signup') THEN 'INSERT' WHEN event_type = 'error' THEN 'DELETE' ELSE 'UPDATE' END AS op FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE op <> 'DELETE'")
def _(t: Tables) -> DataFrame:
    source, target = t.scratch("feed"), t.scratch("folded")
    feed(t).repartition(4).write.parquet(source)
    changes = t.spark.readStream.schema("user_id long, event_id long, value double, op string").option("maxFilesPerTrigger", 2).parquet(source)
    q = FEED.fold_stream(changes, target, t.scratch("state"), "user_id", "event_id", ["user_id", "event_id", "value"])
    q.awaitTermination()
    return FEED.folded(t.spark, target, "user_id", "event_id").select("user_id", "event_id")


@query("t_06_stream_days", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    """All days, those that are not over among them, as the sums of what each batch adds."""
    source, out = t.scratch("events"), t.scratch("days")
    t.events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type").write.parquet(source)
    FEED.added_days(t.spark.readStream.schema("ts timestamp, event_type string").parquet(source), out, t.scratch("state")).awaitTermination()
    return FEED.all_days(t.spark, out).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("s_07_products", "SELECT page_id, 'S' || p_partkey AS sku, p_name AS name, p_brand AS brand, CAST(p_size * 10 + 0.5 AS DOUBLE) AS price, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size * 20 AS DOUBLE) END AS old_price, 'https://shop.it/p/' || p_partkey AS url FROM (SELECT *, p_partkey // 8 AS page_id FROM part) WHERE p_partkey % 5 > 0")
def _(t: Tables) -> DataFrame:
    """Pages of eight cards each, some of them twice, some without a payload, prices in the payload or in the card."""
    from ..sources.shops import product_cards

    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    odd = F.col("p_partkey") % 2 == 1
    special = F.when(odd, F.concat(F.lit(', "specialPrice": "'), (size * 10).cast("string"), F.lit(',50"'))).otherwise(F.lit(""))
    told = F.concat(F.lit('{"sku": "S'), key, F.lit('", "name": "'), "p_name", F.lit('", "brand": "'), "p_brand", F.lit('"'), special, F.lit("}"))
    shown = F.when(odd, F.lit("")).otherwise(F.concat(F.lit("<b>Da "), (size * 10).cast("string"), F.lit(",50 €</b>")))
    was = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('<s class="product-card__final-price-with-save">'), (size * 20).cast("string"), F.lit(",00 €</s>"))).otherwise(F.lit(""))
    call = F.when(F.col("p_partkey") % 5 > 0, F.concat(F.lit("<i onclick='setGoogleTagManagerProductClick("), told, F.lit(")'></i>"))).otherwise(F.lit(""))
    card = F.concat(F.lit('<li><a class="product-card__product-link" href="/p/'), key, F.lit('">'), "p_name", F.lit("</a>"), call, shown, was, F.lit("</li>"))
    pages = t.part.groupBy(F.floor(F.col("p_partkey") / 8).alias("page_id")).agg(F.array_join(F.collect_list(F.concat(card, card)), "").alias("html"))
    got = product_cards(pages, "https://shop.it")
    return got.select("page_id", "sku", "name", "brand", F.col("price").cast("double").alias("price"), F.col("old_price").cast("double").alias("old_price"), "url")


PAGES_SQL = "item AS (SELECT p_brand AS source, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part)"


@query("s_10_paged", "WITH RECURSIVE " + PAGES_SQL + ", page AS (SELECT source, 1 + k // 4 AS page, id, n FROM item UNION SELECT source, 2 + k // 4, id, n FROM item WHERE k % 4 = 3), stop AS (SELECT source, n, CASE WHEN source LIKE '%1' THEN 5 ELSE n END AS total FROM item GROUP BY ALL), ok AS (SELECT source, 1 AS page, total, (SELECT count(DISTINCT id) FROM page p WHERE p.source = s.source AND p.page <= 1) AS known FROM stop s UNION ALL SELECT o.source, o.page + 1, o.total, (SELECT count(DISTINCT id) FROM page p WHERE p.source = o.source AND p.page <= o.page + 1) FROM ok o WHERE o.known < o.total AND EXISTS (SELECT 1 FROM page p WHERE p.source = o.source AND p.page = o.page + 1)) SELECT p.source, min(p.page) AS page, p.id FROM page p JOIN (SELECT source, max(page) AS last FROM ok GROUP BY 1) USING (source) WHERE p.page <= last GROUP BY p.source, p.id")
def _(t: Tables) -> DataFrame:
    """Recorded pages of four ids, each with the last id of the page before; some sources announce five ids only."""
    from pyspark.sql.window import Window

    from ..sources.shops import paged_items

    w = Window.partitionBy("p_brand")
    item = t.part.select(F.col("p_brand").alias("source"), F.col("p_partkey").alias("id"), (F.row_number().over(w.orderBy("p_partkey")) - 1).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    own = item.select("source", (1 + F.floor(F.col("k") / 4)).alias("page"), "id", "n")
    again = item.where("k % 4 = 3").select("source", (2 + F.floor(F.col("k") / 4)).alias("page"), "id", "n")
    total = F.when(F.col("source").endswith("1"), 5).otherwise(F.max("n"))
    return paged_items(own.union(again).groupBy("source", "page").agg(total.alias("total"), F.collect_list("id").alias("ids")))


@query("s_17_markdown", "WITH l AS (SELECT p_type AS title, max(p_size) AS n, CASE max(p_size) % 3 WHEN 0 THEN 'hub' WHEN 1 THEN 'enrich' ELSE 'skip' END AS action FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY action ORDER BY n DESC, title) AS k FROM l) SELECT '# Shortlist' || chr(10) || chr(10) || (SELECT 'hub **' || count(CASE WHEN action = 'hub' THEN 1 END) || '** · enrich **' || count(CASE WHEN action = 'enrich' THEN 1 END) || '** · skip **' || count(CASE WHEN action = 'skip' THEN 1 END) || '**' FROM l) || coalesce((SELECT string_agg(line, '' ORDER BY CASE action WHEN 'hub' THEN 0 WHEN 'enrich' THEN 1 ELSE 2 END, k) FROM (SELECT action, 0 AS k, chr(10) || chr(10) || '## ' || action || chr(10) || chr(10) || '| # | title | n |' || chr(10) || '|---|---|---:|' AS line FROM r GROUP BY action UNION ALL SELECT action, k, chr(10) || '| ' || k || ' | ' || title || ' | ' || n || ' |' FROM r WHERE k <= 20)), '') AS text")
def _(t: Tables) -> DataFrame:
    action = F.element_at(F.array(F.lit("hub"), F.lit("enrich"), F.lit("skip")), F.col("n").cast("int") % 3 + 1)
    labels = t.part.groupBy(F.col("p_type").alias("title")).agg(F.max("p_size").alias("n")).withColumn("action", action)
    return S.markdown_report(labels, "Shortlist", ["hub", "enrich", "skip"], 20)
