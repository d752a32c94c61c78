"""Small relational building blocks: predicates, joins with fallbacks, ranking, paging and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import written


def scrubbed(text: str) -> str:
    """A search text without wildcards: % _ and , become spaces, spaces collapse."""
    return " ".join(text.replace("%", " ").replace("_", " ").replace(",", " ").split())


def contains_any(columns: Sequence[Column], text: str) -> Column:
    """Case-insensitive contains on any column; an empty search finds nothing."""
    needle = scrubbed(text)
    return reduce(lambda a, b: a | b, [c.ilike(f"%{needle}%") for c in columns]) if needle else F.lit(False)


def visible(flag: Column) -> Column:
    """Not excluded; null counts as visible."""
    return ~F.coalesce(flag, F.lit(False))


def longest_prefix(df: DataFrame, code: str, prefixes: Sequence[str]) -> DataFrame:
    """Adds ``prefix``: the longest of a fixed list that the code begins with, upper case, trimmed."""
    norm = F.upper(F.trim(F.col(code)))
    ladder = F.coalesce(*[F.when(norm.startswith(p), F.lit(p)) for p in sorted(set(prefixes), key=lambda p: (-len(p), p))])
    return df.withColumn("prefix", ladder)


def with_fallback(df: DataFrame, lookup: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """Left join on ``key``; columns of a missing row take their default."""
    joined = df.join(lookup, key, "left")
    return reduce(lambda d, kv: d.withColumn(kv[0], F.coalesce(F.col(kv[0]), kv[1])), defaults.items(), joined)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, place: str | None = None) -> DataFrame:
    """The first ``n`` rows per key in a total order; with ``place``, their number from 1."""
    out = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n)
    return out.withColumnRenamed("_n", place) if place else out.drop("_n")


def priority_union(sources: Sequence[DataFrame], keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Union in which an earlier source wins a key."""
    parts = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return first_by(both, keys, [F.col("_source"), *order]).drop("_source")


def keep_and_add(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All existing rows, and the incoming ones whose key is new."""
    return existing.unionByName(incoming.join(existing.select(*keys).distinct(), list(keys), "left_anti"))


def paged(segments: Sequence[DataFrame], key: str, size: int = 10_000, most: int = 32) -> DataFrame:
    """Segments end to end, each in the order of ``key``: adds place from 0 and chunk, at most ``most`` chunks.

    Places come from counts per segment and range partition, so no task orders everything.
    """
    out, before = [], 0
    for i, s in enumerate(segments):
        placed = numbered(s, key).withColumn("place", F.col("place") + before).withColumn("segment", F.lit(i))
        before += s.count()
        out.append(placed)
    both = reduce(lambda a, b: a.unionByName(b), out)
    return both.withColumn("chunk", F.floor(F.col("place") / size).cast("int")).where(F.col("chunk") < most)


def numbered(df: DataFrame, key: str, buckets: int = 64) -> DataFrame:
    """Adds ``place``, the row number from 0 in the order of ``key``: ordered within value ranges, ranges added up.

    The ranges are written once, with their number, and read by both sides: planned twice they
    could be cut at different bounds. Equal keys go by a hash of their row, so a key with many rows is
    cut as well.
    """
    tied = df.withColumn("_tie", F.xxhash64(*df.columns))
    ranged = written(tied.repartitionByRange(buckets, F.col(key), F.col("_tie")).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(key, "_tie")))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    placed = inside.join(F.broadcast(before), "_part").withColumn("place", F.col("_k") - 1 + F.col("_before"))  # at most ``buckets`` rows
    return placed.select(*df.columns, "place")


def chunk_count(total: int, size: int = 10_000, most: int = 32) -> int:
    """How many chunks a listing of ``total`` rows has; a total of 0 is one that isn't known, so all are offered."""
    return min(-(-total // size), most) if total else most


def round_robin(df: DataFrame, group: str, order: Sequence[Column], group_order: Sequence[Column], limit: int) -> DataFrame:
    """First of every group, then second of every group, ...: the first ``limit`` rows."""
    turn = df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return turn.orderBy("turn", *group_order).limit(limit)


def streaks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], new: Column) -> DataFrame:
    """Adds ``island``, how many new rows came so far, and ``streak``, the length so far of the run of old rows since."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(w))
    return out.withColumn("streak", F.sum(1 - F.col("_new")).over(Window.partitionBy(*keys, "island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def upto_streak(df: DataFrame, keys: Sequence[str], order: Sequence[Column], new: Column, most: int) -> DataFrame:
    """Rows that a reader takes who stops after ``most`` old rows in a row: all up to the stopping row."""
    s = streaks(df, keys, order, new)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return s.withColumn("_over", F.coalesce(F.max((F.col("streak") >= most).cast("int")).over(w), F.lit(0))).where("_over = 0").drop("_over")


def change_points(df: DataFrame, keys: Sequence[str], order: Sequence[Column], state: Sequence[str]) -> DataFrame:
    """Rows whose state differs from the row before; the first of a key always stays."""
    w = Window.partitionBy(*keys).orderBy(*order)
    cur = F.struct(*state)
    return df.withColumn("_n", F.row_number().over(w)).withColumn("_prev", F.lag(cur).over(w)).where((F.col("_n") == 1) | ~cur.eqNullSafe(F.col("_prev"))).drop("_n", "_prev")


#: Pairs that meet in one task of a self-join, and rows of one key that meet the key's others there.
TASK_PAIRS, CELL_ROWS = 20_000_000, 4096


def both_sides(rows: DataFrame, key: str, by: str) -> tuple[DataFrame, DataFrame]:
    """The rows twice, each with ``_cell``: joined on (key, _cell) every two rows of a key meet once in each order, dealt by how many pairs there are.

    The planner deals rows by their bytes, and few rows of a frequent key make many pairs in one task. Here a
    key with many rows is cut into cells by a hash of ``by``; the other side goes to each of them.
    """
    kept = written(rows, "pair-rows")
    sizes = written(kept.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), "pair-keys")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), (sizes.agg(F.sum(F.col("_n") * F.col("_n"))).first()[0] or 0) // TASK_PAIRS)
    sized = kept.join(sizes.select(key, F.ceil(F.col("_n") / CELL_ROWS).cast("int").alias("_cells")), key)
    left = sized.withColumn("_cell", F.pmod(F.xxhash64(by), F.col("_cells")).cast("int")).drop("_cells").repartition(parts, key, "_cell")
    right = sized.withColumn("_cell", F.explode(F.sequence(F.lit(0), F.col("_cells") - 1))).drop("_cells").repartition(parts, key, "_cell")
    return left, right


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], buckets: int | None = None) -> DataFrame:
    """``df`` written in the order of keys and ``order``, with ``_part``, the number of its range: a key with many rows lies in several.

    Without ``buckets`` there are as many ranges as the session has shuffle partitions, 64 at least.
    """
    buckets = buckets or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return written(df.repartitionByRange(buckets, *keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, buckets: int | None = None) -> DataFrame:
    """Adds ``name``, the row number from 1 per key in a total order; counted within ranges and added up, so no key is one task."""
    parts = ranged(df, keys, order, buckets)
    sizes = parts.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a key has at most ``buckets`` ranges
    before = sizes.select(*keys, "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    return parts.withColumn("_inside", inside).join(before, [*keys, "_part"]).select(*df.columns, (F.col("_inside") + F.col("_before")).alias(name))


def filled_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, buckets: int | None = None) -> DataFrame:
    """Adds ``name``, the greatest ``value`` of a key up to the row in a total order; carried from range to range, so no key is one task."""
    parts = ranged(df, keys, order, buckets)
    most = parts.groupBy(*keys, "_part").agg(F.max(value).alias("_most"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = most.select(*keys, "_part", F.max("_most").over(earlier).alias("_before"))
    upto = F.max(value).over(Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("_upto", upto).join(before, [*keys, "_part"]).select(*df.columns, F.greatest("_upto", "_before").alias(name))


def unique_slugs(df: DataFrame, base: str, order: Sequence[str]) -> DataFrame:
    """Adds ``slug``: the base for the first row that has it, then base-2, base-3, ... skipping slugs that are bases themselves.

    The taken numbers t of a base, sorted with their ranks r, have t - r - 1 free numbers from 2 on before them,
    so the m-th free number is 1 + m + (how many have fewer than m before them). Those counts are found by
    laying rows and taken numbers in one order. Rows are numbered, and counts carried, over ranges, so one base
    may have any share of the rows.
    """
    n = written(ranked(df, [base], order, "_n"), "numbered")
    taken = df.select(F.col(base).alias("_t")).distinct().where(F.col("_t").rlike(r"-[0-9]{1,9}$"))
    taken = taken.select(F.regexp_replace("_t", r"-[0-9]+$", "").alias(base), F.regexp_extract("_t", r"-([0-9]+)$", 1).try_cast("long").alias("_k")).where("_k >= 2").distinct()
    taken = written(ranked(taken, [base], ["_k"], "_r"), "taken")
    rows = n.where("_n > 1").select(base, (F.col("_n") - 1).alias("_value")).join(taken.select(base).distinct(), base, "left_semi")
    events = rows.withColumn("_kind", F.lit(0)).withColumn("_r", F.lit(None).cast("long"))
    events = events.union(taken.select(base, F.col("_k") - F.col("_r") - 1, F.lit(1), "_r"))  # a taken number with as many before it doesn't count
    skipped = filled_forward(events, [base], ["_value", "_kind", "_r"], "_r", "_skip").where("_kind = 0").select(base, (F.col("_value") + 1).alias("_n"), "_skip")
    number = F.col("_n") + F.coalesce("_skip", F.lit(0))
    slug = F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), number.cast("string")))
    return n.join(skipped, [base, "_n"], "left").withColumn("slug", slug).drop("_n", "_skip")
