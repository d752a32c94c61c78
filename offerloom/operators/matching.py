"""Cross-shop matching: candidate pairs by rare grams, similarity, components, one offer per shop.

Products are (id, shop, name); ``norm`` is a normal form of the name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names as N
from ..registry import written
from .graph import connected_components
from .relational import both_sides

THRESHOLD = 0.70
EPSILON = 2.0**-52


def gram_pairs(products: DataFrame, least_shared: int = 1) -> DataFrame:
    """(a, b, shared, size_a, size_b) of products of different shops that share grams, a < b.

    The plain inverted-index join. For thresholds use ``similar``, which joins rare grams only.
    """
    x, y = both_sides(products.select("id", "shop", F.size("grams").alias("n"), F.explode("grams").alias("gram")), "gram", "id")
    a, b = x.select(F.col("id").alias("a"), F.col("shop").alias("sa"), F.col("n").alias("size_a"), "gram", "_cell"), y.select(F.col("id").alias("b"), F.col("shop").alias("sb"), F.col("n").alias("size_b"), "gram", "_cell")
    pairs = a.join(b, ["gram", "_cell"]).where("a < b AND sa <> sb").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.max("size_a").alias("size_a"), F.max("size_b").alias("size_b"))
    return pairs.where(F.col("shared") >= least_shared)


def rare_heads(sets: DataFrame, frequency: DataFrame, share: float) -> DataFrame:
    """(id, n, gram): the rarest n - ceil(share n) + 1 grams of each set, by how many sets have them."""
    exploded = sets.select("id", F.explode("grams").alias("gram"))
    ranked = exploded.join(frequency, "gram").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "gram"))), lambda x: x["gram"]).alias("grams"))
    n = F.size("grams")
    head = F.greatest(n - F.ceil(F.lit(share) * n - 1e-9) + 1, F.lit(1)).cast("int")
    return ranked.select("id", n.alias("n"), F.explode(F.slice("grams", F.lit(1), head)).alias("gram"))


def frequencies(sets: DataFrame) -> DataFrame:
    return sets.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))


def frequent_grams(sets: DataFrame, percent: int = 15) -> DataFrame:
    """(gram, df) of the grams that more sets hold than a percentage of all, however few those are."""
    n = sets.agg(F.count(F.lit(1)).alias("sets"))
    return frequencies(sets).join(F.broadcast(n), 100 * F.col("df") > percent * F.col("sets")).select("gram", "df")  # one row is broadcast


def stop_grams(sets: DataFrame, share: float = 0.15, least: int = 500) -> DataFrame:
    """(gram, df) of the grams that more sets hold than a share of all, rounded up, and more than ``least``."""
    n = sets.agg(F.greatest(F.ceil(F.lit(share) * F.count(F.lit(1))), F.lit(least)).alias("most"))
    return frequencies(sets).join(F.broadcast(n), F.col("df") > F.col("most")).select("gram", "df")  # one row is broadcast


#: Longs of a set's bitmap: 64 bits each, one of them set by each item.
BITMAP = 8


def bitmap(items: Column) -> list[Column]:
    """The bitmap of a set of strings, as longs; a bit that another set's lacks is an item that the other set lacks."""
    place = lambda x: F.pmod(F.xxhash64(x), F.lit(64 * BITMAP))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), (place(x) % 64).cast("int"))
    inside = lambda k: F.filter(items, lambda x: (place(x) >= 64 * k) & (place(x) < 64 * (k + 1)))
    return [F.aggregate(inside(k), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(bit(x))).alias(f"bits{k}") for k in range(BITMAP)]


def lacking(one: str, other: str) -> Column:
    """At least so many items of a set are not in the other, by their bitmaps."""
    return sum((F.bit_count(F.col(f"{one}.bits{k}").bitwiseAND(F.bitwise_not(F.col(f"{other}.bits{k}")))) for k in range(1, BITMAP)), F.bit_count(F.col(f"{one}.bits0").bitwiseAND(F.bitwise_not(F.col(f"{other}.bits0")))))


#: Pairs that meet in one task of ``head_pairs``: their number, not that of the rows, is its work.
TASK_PAIRS = 20_000_000


def head_pairs(heads: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b, of heads (id, n, gram, bits...) that share a gram and may reach a Dice of ``threshold`` by their sizes and bitmaps.

    What two sets share is at most what either has less what its bitmap shows the other to lack.
    Nearly all pairs that meet by a gram alone end there, before any is moved.
    """
    met = heads.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    parts = max(int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions")), met // TASK_PAIRS)
    dealt = heads.repartition(parts, "gram")  # the planner would join few rows in few tasks, however many pairs they make
    x, y = dealt.alias("x"), dealt.alias("y")
    both = F.least(F.col("x.n") - lacking("x", "y"), F.col("y.n") - lacking("y", "x"))
    may = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.id") < F.col("y.id")) & (2 * both >= (threshold - 1e-9) * (F.col("x.n") + F.col("y.n")))
    return x.join(y, may).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def similar(names: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, score) of distinct names (id, grams) with a Dice of at least ``threshold``, a < b.

    Two sets that similar share one of each side's rarest n - ceil(t/(2-t) n) + 1 grams, so only
    those are joined: no pair is lost, and frequent grams, which would pair everything, are
    seldom among them. Pairs that meet are held against each other's bitmaps before their sets are.
    """
    share = threshold / (2 - threshold)
    sets = names.select("id", "grams")
    rare = rare_heads(names, frequencies(names), share).join(names.select("id", *bitmap(F.col("grams"))), "id")
    pairs = head_pairs(written(rare, "heads"), threshold)
    scored = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
    return scored.select("a", "b", N.dice(F.col("ga"), F.col("gb")).alias("score")).where(F.col("score") + EPSILON >= threshold)


def edges(products: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, score) of products (id, shop, norm) of different shops; equal names are compared once."""
    byname = products.groupBy("norm").agg(F.min("id").alias("id"))
    byname = written(byname.withColumn("grams", N.trigrams(F.col("norm"))), "names")
    links = similar(byname.where("size(grams) > 0"), threshold)
    names = links.union(byname.where("size(grams) > 0").select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score")))
    of = products.select("id", "shop", "norm").join(byname.select("norm", F.col("id").alias("text_id")), "norm").select("id", "shop", "text_id")
    x = of.select(F.col("id").alias("x"), F.col("shop").alias("sx"), F.col("text_id").alias("a"))
    y = of.select(F.col("id").alias("y"), F.col("shop").alias("sy"), F.col("text_id").alias("b"))
    both = names.join(x, "a").join(y, "b").where("sx <> sy AND (a <> b OR x < y)")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")


def clusters(products: DataFrame, links: DataFrame) -> DataFrame:
    """Members (component, id, shop, mean_score): per component and shop the product with the highest mean link, ties to the greater id."""
    links = written(links, "links")
    labels = connected_components(links)
    ends = links.select(F.col("a").alias("id"), "score").union(links.select(F.col("b").alias("id"), "score"))
    means = ends.groupBy("id").agg(F.round(F.avg("score"), 9).alias("mean_score"))
    rows = products.join(labels.withColumnRenamed("node", "id"), "id").join(means, "id")
    best = rows.withColumn("n", F.row_number().over(Window.partitionBy("component", "shop").orderBy(F.desc("mean_score"), F.desc("id")))).where("n = 1").drop("n")
    size = F.count(F.lit(1)).over(Window.partitionBy("component"))
    return best.withColumn("members", size).where("members >= 2")


def canonical(name: Column, norm: Column) -> Column:
    """Aggregate: the longest display name, ties to the smaller normal form."""
    shown = N.display_name(name)
    return F.min(F.struct((-F.length(shown)).alias("l"), norm.alias("n"), shown.alias("name")))["name"]


def described(members: DataFrame, links: DataFrame) -> DataFrame:
    """A row per cluster: component, members, score, canonical_name, title, slug, product_ids."""
    inside = links.join(members.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a").join(members.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b").where("ca = cb")
    score = inside.groupBy(F.col("ca").alias("component")).agg(F.round(F.max("score"), 4).alias("score"))
    ordered = F.array_sort(F.collect_list(F.struct(F.lower("shop").alias("k"), "shop", "id")))
    base = members.groupBy("component").agg(F.count(F.lit(1)).alias("members"), canonical(F.col("name"), F.col("norm")).alias("canonical_name"), ordered.alias("m"))
    shops = F.transform("m", lambda x: x["shop"])
    title = F.when(F.col("members") <= 2, F.concat("canonical_name", F.lit(" — "), shops[0], F.lit(" vs "), shops[1])).otherwise(F.concat("canonical_name", F.lit(" — confronto prezzi su "), F.col("members").cast("string"), F.lit(" shop")))
    ids = F.transform("m", lambda x: x["id"].cast("string"))
    out = written(base.join(score, "component").select("component", "members", "score", "canonical_name", title.alias("title"), N.slug(F.col("canonical_name"), 100, "prodotto").alias("base"), ids.alias("product_ids")), "described")
    # the first cluster of a slug keeps it; later ones add the beginnings of their ids. Firsts come from
    # partial minima and are joined by component, so that a slug which many clusters share is no one task
    firsts = out.groupBy("base").agg(F.min("component").alias("component")).select("component", F.lit(True).alias("first"))
    tail = F.array_join(F.transform("product_ids", lambda x: F.substring(x, 1, 4)), "-")
    return out.join(firsts, "component", "left").withColumn("slug", F.when(F.col("first"), F.col("base")).otherwise(F.concat("base", F.lit("-"), tail))).drop("first", "base")


def name_classes(products: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Products by equal names: (id, shop, text_id), class sizes (text_id, shop, n), and links of classes (a, b, score), each both ways and with itself.

    A name that many products share is one class, so its products are never paired.
    """
    byname = written(products.groupBy("norm").agg(F.min("id").alias("text_id")).withColumn("grams", N.trigrams(F.col("norm"))).where("size(grams) > 0"), "names")
    links = written(similar(byname.select(F.col("text_id").alias("id"), "grams"), threshold), "name-links")
    every = links.union(links.select("b", "a", "score")).union(byname.select(F.col("text_id").alias("a"), F.col("text_id").alias("b"), F.lit(1.0).alias("score")))
    of = written(products.select("id", "shop", "norm").join(byname.select("norm", "text_id"), "norm").select("id", "shop", "text_id"), "classes")
    return of, written(of.groupBy("text_id", "shop").agg(F.count(F.lit(1)).alias("n")), "class-sizes"), every


def class_clusters(products: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """What ``clusters`` gives for ``edges``, with the links of the chosen members, without making the edges.

    A product's links are those of its class: with every product of a linked class, or of its
    own, that another shop has. So mean scores come from class sizes, and products of a class that
    has any such link are in one component.
    """
    of, sizes, links = name_classes(products, threshold)
    whole = sizes.groupBy(F.col("text_id").alias("b")).agg(F.sum("n").alias("all"))
    mine = links.join(sizes.select(F.col("text_id").alias("a"), "shop"), "a").join(whole, "b")
    same = sizes.select(F.col("text_id").alias("b"), "shop", F.col("n").alias("same"))
    met = mine.join(same, ["b", "shop"], "left").withColumn("others", F.col("all") - F.coalesce("same", F.lit(0))).where("others > 0")
    met = written(met.select("a", "b", "shop", "score", "others"), "class-links")
    means = met.groupBy(F.col("a").alias("text_id"), "shop").agg(F.round(F.sum(F.col("score") * F.col("others")) / F.sum("others"), 9).alias("mean_score"))
    labels = connected_components(met.select("a", "b"))
    linked = means.join(labels.withColumnRenamed("node", "text_id"), "text_id", "left").withColumn("component", F.coalesce("component", "text_id"))
    rows = products.join(of.select("id", "text_id"), "id").join(linked, ["text_id", "shop"])
    best = rows.withColumn("k", F.row_number().over(Window.partitionBy("component", "shop").orderBy(F.desc("mean_score"), F.desc("id")))).where("k = 1").drop("k")
    # a component goes by its smallest product, as in clusters
    least = rows.groupBy("component").agg(F.min("id").alias("least"))
    members = best.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("component"))).where("members >= 2").join(least, "component")
    members = written(members.withColumn("component", F.col("least")).drop("least"), "members")
    x, y = (members.select("component", F.col("id").alias(i), F.col("shop").alias(f"s{i}"), F.col("text_id").alias(f"t{i}")) for i in "ab")
    inside = x.join(links.select(F.col("a").alias("ta"), F.col("b").alias("tb"), "score"), "ta").join(y, ["component", "tb"]).where("a < b AND sa <> sb").select("a", "b", "score")
    return members, inside


def match(products: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    members, links = class_clusters(products, threshold)
    return described(members, links)


def shop_sets(members: DataFrame) -> DataFrame:
    """(slug, shops, score) of clusters (slug, score, shop, id): the sorted distinct shops and the highest score."""
    return members.groupBy("slug").agg(F.sort_array(F.collect_set("shop")).alias("shops"), F.max("score").alias("score"))


def signature(items: Column) -> Column:
    """A bitmap of a set: what it contains has no bit that the set's bitmap lacks."""
    return F.aggregate(items, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))))


def contains(whole: Column, whole_signature: Column, part: Column, part_signature: Column) -> Column:
    """Whether one set holds another: bitmaps first, the sets themselves where those agree."""
    return (part_signature.bitwiseAND(whole_signature) == part_signature) & (F.size(F.array_except(part, whole)) == 0)


def containments(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """(part, whole) of distinct sets: parts (part), wholes (whole), arrays of strings without repeats.

    A part meets only wholes that hold its rarest item, by how many wholes hold it; a part with
    an item that none holds meets none. So an item that all sets share pairs nothing, unless it is
    the rarest of a set.
    """
    there = written(wholes.select("whole", signature(F.col("whole")).alias("whole_signature")), "wholes")
    spread = there.select("whole", "whole_signature", F.explode("whole").alias("item"))
    frequency = spread.groupBy("item").agg(F.count(F.lit(1)).alias("df"))
    rare = parts.select("part", F.explode("part").alias("item")).join(frequency, "item")
    rare = rare.groupBy("part").agg(F.min(F.struct("df", "item"))["item"].alias("item"), F.count(F.lit(1)).alias("known")).where(F.col("known") == F.size("part"))
    met = rare.withColumn("part_signature", signature(F.col("part"))).join(spread, "item")
    return met.where(contains(F.col("whole"), F.col("whole_signature"), F.col("part"), F.col("part_signature"))).select("part", "whole")


def redirects(inactive: DataFrame, active: DataFrame) -> DataFrame:
    """For inactive clusters of two shops or more the active one that holds all their shops: most shared products, best score, fewest shops, slug.

    Both: (slug, score, shop, id), a row per member. Clusters with the same shops are one set,
    and of a set of active shops only the best cluster matters to inactive ones that share no product
    with it. Clusters that share products meet by those.
    """
    gone = written(shop_sets(inactive).where("size(shops) >= 2").select("slug", F.col("shops").alias("part")), "inactive-sets")
    here = written(shop_sets(active).select(F.col("slug").alias("target"), F.col("shops").alias("whole"), "score"), "active-sets")
    rank = F.struct((-F.coalesce("shared", F.lit(0))).alias("shared"), F.col("score").isNull().alias("unscored"), (-F.col("score")).alias("score"), F.size("whole").alias("shops"), "target")
    best = here.withColumn("shared", F.lit(0).cast("long")).withColumn("rank", rank).groupBy("whole").agg(F.min("rank").alias("rank"))
    by_set = containments(gone.select("part").distinct(), here.select("whole").distinct()).join(best, "whole").groupBy("part").agg(F.min("rank").alias("rank"))
    shared = inactive.select("slug", "id").distinct().join(active.select(F.col("slug").alias("target"), "id").distinct(), "id").groupBy("slug", "target").agg(F.count(F.lit(1)).alias("shared"))
    met = shared.join(gone, "slug").join(here, "target").where(contains(F.col("whole"), signature(F.col("whole")), F.col("part"), signature(F.col("part"))))
    by_product = met.withColumn("rank", rank).groupBy("slug").agg(F.min("rank").alias("nearest"))
    first = gone.join(by_set, "part", "left").join(by_product, "slug", "left").withColumn("rank", F.coalesce("nearest", "rank")).where("rank IS NOT NULL")
    return first.select("slug", F.col("rank.target").alias("target"), (-F.col("rank.shared")).alias("shared"))
