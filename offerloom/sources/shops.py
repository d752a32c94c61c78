"""Shop pages and recorded pages of paged sources as relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as X
from .files import payload

#: How a shop marks its cards, prices and the payload of a click.
CARD = r"(?=<a\b[^>]*\bproduct-card__product-link\b)"
CLICK = "setGoogleTagManagerProductClick("
PAYLOAD = "sku string, name string, brand string, url string, specialPrice string, minimumPrice string, minRegularPrice string, regularPrice string, savePercent string"
OLD_PRICE = r"(?s)product-card__final-price-with-save[^>]*>([^<]*)<"
SHOWN_PRICES = (r"Da\s+([\d.,]+)\s*€", r"(?i)A soli\s+([\d.,]+)\s*€")


def product_cards(pages: DataFrame, origin: str, source: Sequence[str] = ("page_id",)) -> DataFrame:
    """The products of pages (page_id, html): pos, sku, name, brand, price, old_price, discount, url.

    A card begins with its link; what the click's payload lacks is read from the card. Cards
    without SKU, name, price or address are left out; of one SKU on a page the first card stays.
    """

    def found(pattern: str):
        return F.nullif(F.regexp_extract("card", pattern, 1), F.lit(""))

    cards = pages.select(*source, F.posexplode(F.split("html", CARD)).alias("pos", "card")).where("pos > 0")
    tag = F.regexp_extract("card", r"(?s)^(<a\b[^>]*>)", 1)
    j = F.from_json(payload(F.col("card"), CLICK), PAYLOAD)
    cards = cards.select("*", j.alias("j"), tag.alias("tag"), F.trim(F.regexp_replace(F.regexp_extract("card", r"(?s)^<a\b[^>]*>(.*?)</a>", 1), r"(?s)<[^>]*>|\s+", " ")).alias("shown"))
    href = F.nullif(F.regexp_extract("tag", r'\bhref="([^"]*)"', 1), F.lit(""))
    path = F.ltrim(F.coalesce(X.trimmed(F.col("j.url")), X.trimmed(href)), F.lit("/"))
    price = F.coalesce(X.price(F.coalesce("j.specialPrice", "j.minimumPrice", "j.minRegularPrice")), *(X.price(found(p)) for p in SHOWN_PRICES))
    old = F.coalesce(X.price(F.coalesce("j.regularPrice", "j.minRegularPrice")), X.price(found(OLD_PRICE)))
    out = cards.select(
        *source, "pos", X.trimmed(F.col("j.sku")).alias("sku"), F.coalesce(X.trimmed(F.col("j.name")), X.trimmed(F.col("shown"))).alias("name"), X.trimmed(F.col("j.brand")).alias("brand"),
        price.alias("price"), old.alias("old_price"), F.concat(F.lit(origin + "/"), F.nullif(path, F.lit(""))).alias("url"), F.col("j.savePercent").try_cast("double").alias("saves"),
    )
    whole = out.where("sku IS NOT NULL AND name IS NOT NULL AND price IS NOT NULL AND url IS NOT NULL")
    first = whole.withColumn("n", F.row_number().over(Window.partitionBy(*source, "sku").orderBy("pos"))).where("n = 1").drop("n")
    return first.withColumn("discount", F.coalesce("saves", X.discount(F.col("old_price"), F.col("price")).cast("double"))).drop("saves")


def paged_items(pages: DataFrame) -> DataFrame:
    """What a reader of paged sources gathers: (source, page, id) of new ids, from pages (source, page, total, ids).

    A source is read until as many ids are known as its first page announces, or a page is empty
    or brings no new id; an id counts for the first page that has it.
    """
    first = pages.select("source", "page", F.explode("ids").alias("id")).where("id IS NOT NULL").groupBy("source", "id").agg(F.min("page").alias("page"))
    gains = pages.select("source", "page", "total").join(first.groupBy("source", "page").agg(F.count(F.lit(1)).alias("gain")), ["source", "page"], "left").withColumn("gain", F.coalesce("gain", F.lit(0)))
    before = Window.partitionBy("source").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    announced = F.first("total").over(Window.partitionBy("source").orderBy("page"))
    known, dry = F.coalesce(F.sum("gain").over(before), F.lit(0)), F.coalesce(F.max((F.col("gain") == 0) & (F.col("page") > 1)).over(before), F.lit(False))
    read = gains.select("source", "page", ((F.col("page") == 1) | ((known < announced) & ~dry)).alias("read")).where("read")
    return first.join(read, ["source", "page"], "left_semi").select("source", "page", "id")
