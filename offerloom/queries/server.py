"""The server functions by name, over products of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import server as D
from ..registry import Tables, query
from ..sources.adapters import with_sql
from .matching import PRODUCT_SQL


def landed(t: Tables) -> DataFrame:
    """Parts as products of the lander of their brand."""
    return t.part.select(F.col("p_partkey").alias("id"), F.lower("p_brand").alias("slug"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 7 > 0, F.col("p_size") * 100).otherwise(0).alias("price"), F.col("p_partkey").alias("created"))


@query("d_02_hub_list", "SELECT lower(p_brand) AS slug, count(*) AS product_count, count(CASE WHEN p_size % 7 > 0 THEN 1 END) AS priced_count, round(avg(CASE WHEN p_size % 7 > 0 THEN p_size * 100 END), 4) AS avg_price FROM part GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return D.type_lander_hub_list(landed(t)).withColumn("avg_price", F.round("avg_price", 4))


@query("d_02_slugs", "SELECT DISTINCT lower(p_brand) AS slug FROM part")
def _(t: Tables) -> DataFrame:
    return D.type_lander_slugs(landed(t))


@query("d_02_lander", "SELECT slug, count(*) AS product_count, count(CASE WHEN price > 0 THEN 1 END) AS priced_count, CAST(min(CASE WHEN price > 0 THEN price END) AS INTEGER) AS min_price, max(price) AS max_price FROM (SELECT lower(p_brand) AS slug, CASE WHEN p_size % 7 > 0 THEN p_size * 100 ELSE 0 END AS price FROM part) WHERE slug = (SELECT min(lower(p_brand)) FROM part) GROUP BY 1 HAVING count(CASE WHEN price > 0 THEN 1 END) >= 5")
def _(t: Tables) -> DataFrame:
    first = landed(t).agg(F.min("slug")).first()[0]
    return D.type_lander_by_slug(landed(t), first).select("slug", "product_count", "priced_count", "min_price", "max_price")


def named(t: Tables) -> str:
    """The name of a view of the products by lander, in a session that has the table functions."""
    D.register(t.spark)
    landed(t).createOrReplaceTempView("offerloom_landed")
    return "offerloom_landed"


@query("d_02_sql_hub_list", "SELECT lower(p_brand) AS slug, count(*) AS product_count, count(CASE WHEN p_size % 7 > 0 THEN 1 END) AS priced_count, round(avg(CASE WHEN p_size % 7 > 0 THEN p_size * 100 END), 4) AS avg_price FROM part GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.spark.sql(f"SELECT slug, product_count, priced_count, round(avg_price, 4) AS avg_price FROM type_lander_hub_list(TABLE({named(t)}))")


@query("d_02_sql_slugs", "SELECT DISTINCT lower(p_brand) AS slug FROM part")
def _(t: Tables) -> DataFrame:
    return t.spark.sql(f"SELECT slug FROM type_lander_slugs(TABLE({named(t)}))")


@query("d_02_sql_lander", "SELECT slug, count(*) AS product_count, count(CASE WHEN price > 0 THEN 1 END) AS priced_count, CAST(min(CASE WHEN price > 0 THEN price END) AS BIGINT) AS min_price, CAST(max(price) AS BIGINT) AS max_price FROM (SELECT lower(p_brand) AS slug, CASE WHEN p_size % 7 > 0 THEN p_size * 100 ELSE 0 END AS price FROM part) WHERE slug = 'brand#11' GROUP BY 1 HAVING count(CASE WHEN price > 0 THEN 1 END) >= 5")
def _(t: Tables) -> DataFrame:
    return t.spark.sql(f"SELECT * FROM type_lander_by_slug(TABLE({named(t)}), 'brand#11')")


BATCH_SQL = PRODUCT_SQL + """, ask AS (SELECT query_index, trim(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g')) AS norm FROM (VALUES (0, 'the and of'), (1, 'La règle'), (2, '')) v(query_index, text)),
qgram AS (SELECT DISTINCT query_index, substr('  ' || norm || ' ', CAST(unnest(range(1, length(norm) + 2)) AS INTEGER), 3) AS gram FROM ask WHERE length(norm) > 0), qsize AS (SELECT query_index, count(*) AS n FROM qgram GROUP BY 1),
found AS (SELECT q.query_index, g.id, any_value(g.price) AS price, 2.0 * count(*) / (any_value(qs.n) + any_value(s.n)) AS similarity FROM qgram q JOIN gram g USING (gram) JOIN qsize qs USING (query_index) JOIN size s ON s.id = g.id GROUP BY ALL)"""


@query("d_02_trigram_batch", with_sql(BATCH_SQL) + "SELECT query_index, id, row_number() OVER (PARTITION BY query_index ORDER BY round(similarity, 9) DESC, price, id) AS place FROM found WHERE similarity >= 0.15 QUALIFY place <= 1000")
def _(t: Tables) -> DataFrame:
    from .matching import products

    return D.match_products_trgm_batch(products(t).select("id", "price", "norm"), ["the and of", "La règle", ""]).select("query_index", "id", "place")
