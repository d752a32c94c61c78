"""Basket comparison: best offers, shop tables, the cheapest mix and the best single shop.

Lines are (basket_id, query_index, shop_id, price, quantity, available); money in cents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

MOST_CANDIDATES = 20
LEAST_SIMILARITY = 0.15


def best_offer(matches: DataFrame, keys: list[str], least: float = LEAST_SIMILARITY) -> DataFrame:
    """The first match per key by similarity down, price up, then id."""
    w = Window.partitionBy(*keys).orderBy(F.desc("similarity"), "price", "offer_id")
    return matches.where(F.col("similarity") >= least).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def candidates(matches: DataFrame, keys: list[str], most: int = MOST_CANDIDATES, least: float = LEAST_SIMILARITY) -> DataFrame:
    """Up to ``most`` distinct offers per key, in the order of best_offer, with their place from 1."""
    order = [F.desc("similarity"), F.col("price"), F.col("offer_id")]
    once = matches.where(F.col("similarity") >= least).withColumn("n", F.row_number().over(Window.partitionBy(*keys, "offer_id").orderBy(*order))).where("n = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= most).drop("n")


def tier_lists(tiers: DataFrame) -> DataFrame:
    """A row per tier set: its tiers as an array in list order."""
    return tiers.groupBy("tier_set").agg(F.array_sort(F.collect_list(F.struct("pos", "min_value", "max_value", "cost"))).alias("tiers"))


def shipping(subtotal: Column, tiers: Column) -> Column:
    """The cost of the first tier that holds the subtotal; nothing for no subtotal, no tiers and gaps."""
    fits = F.filter(tiers, lambda x: (subtotal >= x["min_value"]) & (x["max_value"].isNull() | (subtotal <= x["max_value"])))
    return F.when((subtotal > 0) & tiers.isNotNull(), F.coalesce(F.get(fits, F.lit(0))["cost"], F.lit(0))).otherwise(F.lit(0)).cast("long")


#: Shops, or sets of tiers, that are broadcast to what they are joined with; more are joined by a shuffle.
BROADCAST_SHOPS = 400_000


def with_tiers(df: DataFrame, shops: DataFrame, tiers: DataFrame) -> DataFrame:
    """Adds the tiers array of each row's shop; an unknown shop has none and goes by its id."""
    known, lists = shops.select("shop_id", "shop_name", "tier_set"), tier_lists(tiers)
    if known.count() <= BROADCAST_SHOPS and lists.count() <= BROADCAST_SHOPS:  # df stays where it is
        out = df.join(F.broadcast(known), "shop_id", "left").join(F.broadcast(lists), "tier_set", "left").drop("tier_set")
    else:
        out = df.join(known.join(lists, "tier_set", "left").drop("tier_set"), "shop_id", "left")
    return out.withColumn("shop_name", F.coalesce("shop_name", F.col("shop_id").cast("string")))


def shop_tables(lines: DataFrame, shops: DataFrame, tiers: DataFrame) -> DataFrame:
    """Per basket and shop: coverage, products, shipping, total. Unavailable lines count for nothing but keep the shop listed."""
    on = F.col("available")
    sums = lines.where("quantity > 0").groupBy("basket_id", "shop_id").agg(F.count(F.when(on, 1)).alias("coverage"), F.coalesce(F.sum(F.when(on, F.col("price") * F.col("quantity"))), F.lit(0)).alias("products"))
    out = with_tiers(sums, shops, tiers).withColumn("shipping", F.when(F.col("coverage") > 0, shipping(F.col("products"), F.col("tiers"))).otherwise(F.lit(0)))
    return out.select("basket_id", "shop_id", "shop_name", "coverage", "products", "shipping", (F.col("products") + F.col("shipping")).alias("total"))


def ranked_shops(tables: DataFrame) -> DataFrame:
    """Adds the place of each shop in its basket: most coverage, least total, smallest id."""
    return tables.withColumn("place", F.row_number().over(Window.partitionBy("basket_id").orderBy(F.desc("coverage"), "total", "shop_id")))


def single_shop(tables: DataFrame) -> DataFrame:
    return ranked_shops(tables.where("coverage > 0")).where("place = 1").drop("place")


def cheapest_mix(lines: DataFrame, shops: DataFrame, tiers: DataFrame) -> DataFrame:
    """Each request in turn goes to the shop that adds least: its line and the change of its shipping.

    Ties go by shop name, then id. Every choice changes later ones, so a basket is folded in
    order of its requests over a map of subtotals, inside the JVM; a basket is as
    long as its list of requests. What a line adds at a shop without a subtotal is known before the
    fold and orders the choices, so a step prices only shops that have one and takes the first of the others.
    """
    line, no_tiers = F.col("price") * F.col("quantity"), F.array().cast("array<struct<pos:int,min_value:bigint,max_value:bigint,cost:bigint>>")
    ready = with_tiers(lines.where("available AND quantity > 0"), shops, tiers)
    ready = ready.select("basket_id", "query_index", "shop_name", "shop_id", line.alias("line"), F.coalesce("tiers", no_tiers).alias("tiers"), (line + shipping(line, F.col("tiers"))).alias("added"))
    choice = F.struct("added", "shop_name", "shop_id", "line", "tiers")
    requests = ready.groupBy("basket_id", "query_index").agg(F.array_sort(F.collect_list(choice)).alias("choices"))
    baskets = requests.groupBy("basket_id").agg(F.array_sort(F.collect_list(F.struct("query_index", "choices"))).alias("requests"))
    shop_type = dict(lines.dtypes)["shop_id"]
    state = f"struct<spent:map<{shop_type},bigint>,chosen:array<struct<query_index:int,shop_id:{shop_type},line:bigint,added:bigint>>>"

    def added(spent: Column, c: Column) -> Column:
        before = F.coalesce(F.try_element_at(spent, c["shop_id"]), F.lit(0).cast("long"))
        return c["line"] + shipping(before + c["line"], c["tiers"]) - shipping(before, c["tiers"])

    def step(acc: Column, r: Column) -> Column:
        def known(c: Column) -> Column:
            return F.map_contains_key(acc["spent"], c["shop_id"])

        def offer(c: Column, adds: Column) -> Column:
            return F.struct(adds.alias("added"), c["shop_name"].alias("shop_name"), c["shop_id"].alias("shop_id"), c["line"].alias("line"))

        priced = F.transform(F.filter(r["choices"], known), lambda c: offer(c, added(acc["spent"], c)))
        others = F.slice(F.filter(r["choices"], lambda c: ~known(c)), 1, 1)
        best = F.array_min(F.concat(priced, F.transform(others, lambda c: offer(c, c["added"]))))

        def after(best: Column) -> Column:
            spent = F.coalesce(F.try_element_at(acc["spent"], best["shop_id"]), F.lit(0).cast("long")) + best["line"]
            rest = F.map_filter(acc["spent"], lambda k, _: k != best["shop_id"])
            row = F.struct(r["query_index"].cast("int").alias("query_index"), best["shop_id"].alias("shop_id"), best["line"].alias("line"), best["added"].alias("added"))
            return F.struct(F.map_concat(rest, F.create_map(best["shop_id"], spent)).alias("spent"), F.concat(acc["chosen"], F.array(row)).alias("chosen"))

        # bound by a lambda, so that the best is found once a step
        return F.get(F.transform(F.array(best), after), F.lit(0)).cast(state)

    start = F.struct(F.create_map().alias("spent"), F.array().alias("chosen")).cast(state)
    return baskets.select("basket_id", F.explode(F.aggregate("requests", start, step)["chosen"]).alias("c")).select("basket_id", "c.*")


def scenario_totals(chosen: DataFrame, shops: DataFrame, tiers: DataFrame) -> DataFrame:
    """Per basket: coverage, products, shipping over its shops' subtotals, total."""
    per = chosen.groupBy("basket_id", "shop_id").agg(F.sum("line").alias("subtotal"), F.count(F.lit(1)).alias("n"))
    per = with_tiers(per, shops, tiers).withColumn("shipping", shipping(F.col("subtotal"), F.col("tiers")))
    return per.groupBy("basket_id").agg(F.sum("n").alias("coverage"), F.sum("subtotal").alias("products"), F.sum("shipping").alias("shipping"), F.sum(F.col("subtotal") + F.col("shipping")).alias("total"))


def shipping_hints(tables: DataFrame, shops: DataFrame, tiers: DataFrame) -> DataFrame:
    """Per basket and shop: what is missing to each cheaper tier, the least gap for each target cost."""
    x = with_tiers(tables.drop("shop_name"), shops, tiers).withColumn("now", shipping(F.col("products"), F.col("tiers"))).withColumn("tier", F.explode("tiers"))
    x = x.where((F.col("products") > 0) & (F.col("tier.cost") < F.col("now")) & (F.col("tier.min_value") > F.col("products")))
    return x.groupBy("basket_id", "shop_id", F.col("tier.cost").alias("target")).agg(F.min(F.col("tier.min_value") - F.col("products")).alias("gap"))


def pending_changes(committed: DataFrame, optimal: DataFrame) -> DataFrame:
    """Requests whose committed shop or line differs from the optimal one, with what the change saves."""
    a = committed.select("basket_id", "query_index", F.col("shop_id").alias("from_shop"), F.col("line").alias("from_line"))
    b = optimal.select("basket_id", "query_index", F.col("shop_id").alias("to_shop"), F.col("line").alias("to_line"))
    out = a.join(b, ["basket_id", "query_index"], "full").where(~(F.col("from_shop").eqNullSafe(F.col("to_shop")) & F.col("from_line").eqNullSafe(F.col("to_line"))))
    kind = F.when(F.col("from_shop").isNull(), "add").when(F.col("to_shop").isNull(), "drop").otherwise("move")
    return out.withColumn("kind", kind).withColumn("saves", F.coalesce("from_line", F.lit(0)) - F.coalesce("to_line", F.lit(0)))


def reconciled(committed: DataFrame, lines: DataFrame, optimal: DataFrame) -> DataFrame:
    """Commitments that are still on offer stay; others take the optimal shop; requests without either go."""
    valid = lines.where("available AND quantity > 0").select("basket_id", "query_index", "shop_id", (F.col("price") * F.col("quantity")).alias("line"))
    kept = committed.select("basket_id", "query_index", "shop_id").join(valid, ["basket_id", "query_index", "shop_id"]).withColumn("origin", F.lit("kept"))
    lost = committed.select("basket_id", "query_index").join(kept.select("basket_id", "query_index"), ["basket_id", "query_index"], "left_anti")
    replaced = lost.join(optimal.select("basket_id", "query_index", "shop_id", "line"), ["basket_id", "query_index"]).withColumn("origin", F.lit("replaced"))
    return kept.unionByName(replaced)


def insert_request(rows: DataFrame, after: int) -> DataFrame:
    """Make room for a request after index ``after``: later indexes move up by one."""
    return rows.withColumn("query_index", F.when(F.col("query_index") > after, F.col("query_index") + 1).otherwise(F.col("query_index")))


def remove_request(rows: DataFrame, index: int) -> DataFrame:
    return rows.where(F.col("query_index") != index).withColumn("query_index", F.when(F.col("query_index") > index, F.col("query_index") - 1).otherwise(F.col("query_index")))


def inline_choice(scored: DataFrame, keys: list[str], threshold: float = 0.80) -> DataFrame:
    """Among candidates at or over the threshold the cheapest (ties: more similar), else the most similar."""
    good = F.col("similarity") >= threshold
    w = Window.partitionBy(*keys).orderBy(good.desc(), F.when(good, F.col("price")).asc_nulls_last(), F.desc("similarity"), "offer_id")
    return scored.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def compared(inside: DataFrame, shops: DataFrame, tiers: DataFrame, least: float = LEAST_SIMILARITY) -> dict[str, DataFrame]:
    """What ``compare`` gives, from matches that hold their requests' quantities; those that are dealt by basket stay where they are."""
    top = candidates(inside, ["basket_id", "query_index", "shop_id"], least=least)
    lines = best_offer(inside, ["basket_id", "query_index", "shop_id"], least).withColumn("available", F.lit(True))
    tables = shop_tables(lines, shops, tiers)
    mix = cheapest_mix(lines, shops, tiers)
    return {"candidates": top, "tables": ranked_shops(tables), "mix": mix, "mix_totals": scenario_totals(mix, shops, tiers), "single": single_shop(tables)}


def compare(requests: DataFrame, matches: DataFrame, shops: DataFrame, tiers: DataFrame, least: float = LEAST_SIMILARITY) -> dict[str, DataFrame]:
    """The whole comparison: candidates, shop tables, cheapest mix, single shop. ``requests``: (basket_id, query_index, quantity)."""
    return compared(matches.join(requests, ["basket_id", "query_index"]), shops, tiers, least)  # drops matches of requests that don't exist


INPUT = """struct<prodotti_richiesti:array<string>,risultati_db:array<struct<query_index:int,id:string,product_name:string,final_price:double,ecommerce_id:string,similarity:double>>,
catalogo_ecommerce:array<struct<id:string,name:string,shipping_tiers:array<struct<min_value:double,max_value:double,shipping_cost:double>>>>,min_similarity:double>"""


def compared_json(inputs: DataFrame) -> DataFrame:
    """(id, output) from (id, input): the whole comparison of each request, JSON in and JSON out, all requests at once.

    The output holds the requested names, the shop tables in order, the cheapest mix and the best
    single shop, with the names of the input's language; money in euros. What is no JSON of
    the right shape gives a null output.
    """
    cents = lambda c: F.round(c * 100).cast("long")
    read = inputs.select("id", F.from_json("input", INPUT).alias("i")).where("i.prodotti_richiesti IS NOT NULL")
    key = F.struct("id", F.col("s.id").alias("shop"))  # shops and their tiers are each request's own
    shop_rows = read.select("id", F.explode("i.catalogo_ecommerce").alias("s")).select(F.to_json(key).alias("shop_id"), F.col("s.name").alias("shop_name"), F.to_json(key).alias("tier_set"), "s.shipping_tiers")
    tier_rows = shop_rows.select("tier_set", F.posexplode("shipping_tiers").alias("pos", "t")).select("tier_set", "pos", cents(F.col("t.min_value")).alias("min_value"), cents(F.col("t.max_value")).alias("max_value"), cents(F.col("t.shipping_cost")).alias("cost"))
    asked = read.select(F.col("id").alias("basket_id"), F.posexplode("i.prodotti_richiesti").alias("query_index", "text")).withColumn("quantity", F.lit(1).cast("long"))
    found = read.select(F.col("id").alias("basket_id"), F.coalesce("i.min_similarity", F.lit(LEAST_SIMILARITY)).alias("least"), F.explode("i.risultati_db").alias("m")).where("m.similarity >= least")
    matches = found.select("basket_id", "m.query_index", F.to_json(F.struct(F.col("basket_id").alias("id"), F.col("m.ecommerce_id").alias("shop"))).alias("shop_id"), F.col("m.id").alias("offer_id"), cents(F.col("m.final_price")).alias("price"), "m.similarity")
    out = compare(asked.select("basket_id", "query_index", "quantity"), matches, shop_rows.drop("shipping_tiers"), tier_rows, 0.0)
    euros = lambda c: F.coalesce(F.col(c), F.lit(0)) / 100.0
    wanted = asked.groupBy("basket_id").agg(F.array_sort(F.collect_list("query_index")).alias("indices"))

    def money(*more):
        return [euros("products").alias("prezzo_prodotti"), euros("shipping").alias("prezzo_spedizione"), euros("total").alias("prezzo_totale"), F.coalesce("coverage", F.lit(0)).alias("copertura"), F.size("indices").alias("copertura_totale"), *more]

    shop = F.get_json_object("shop_id", "$.shop").alias("ecommerce_id")
    tables = out["tables"].join(wanted, "basket_id").groupBy("basket_id").agg(F.array_sort(F.collect_list(F.struct("place", F.struct(shop, F.col("shop_name").alias("ecommerce_name"), *money()).alias("t")))).alias("rows"))
    tables = tables.select("basket_id", F.transform("rows", lambda x: x["t"]).alias("tabelle_ecommerce"))
    covered = out["mix"].groupBy("basket_id").agg(F.collect_set("query_index").alias("found"))
    mix = wanted.join(out["mix_totals"], "basket_id", "left").join(covered, "basket_id", "left").select("basket_id", F.struct(*money(F.array_except("indices", F.coalesce("found", F.array().cast("array<int>"))).alias("prodotti_mancanti_indices"))).alias("scenario_risparmio"))
    single = wanted.join(out["single"], "basket_id", "left").select("basket_id", F.struct(shop, F.col("shop_name").alias("ecommerce_name"), *money()).alias("scenario_monopolista"))
    names = read.select(F.col("id").alias("basket_id"), F.col("i.prodotti_richiesti").alias("prodotti_richiesti"))
    whole = names.join(tables, "basket_id", "left").join(mix, "basket_id", "left").join(single, "basket_id", "left")
    text = whole.select(F.col("basket_id").alias("id"), F.to_json(F.struct("prodotti_richiesti", F.coalesce("tabelle_ecommerce", F.array()).alias("tabelle_ecommerce"), "scenario_risparmio", "scenario_monopolista")).alias("output"))
    return inputs.select("id").join(text, "id", "left")


LINE_TYPES = T.StructType([T.StructField("basket_id", T.LongType()), T.StructField("query_index", T.IntegerType()), T.StructField("shop_id", T.LongType()), T.StructField("price", T.LongType()), T.StructField("quantity", T.LongType()), T.StructField("available", T.BooleanType())])
