"""Mixing sources to target weights by capped water-filling. DataFrame operations only.

Sources weigh 1, 2, 3, repeating, by code point, a null source last. They share all
words by weight; a source stops at ``max_epochs`` times its words, and what it can't
take is shared again by weight among the rest until none is above. As a clamped source
stays clamped, that fixed point is found in one pass over the sources in order of
cap / weight: the first source that the level reached so far doesn't clamp sets it.

A source's rows are taken whole-number times, and a seeded part of them once more.
The part is exact without ordering a source in one task: rows hash (by MD5) into 65,536
buckets a source, bucket sums are added up in hash order in two steps of 256, and only the
bucket in which the wanted words run out is cut, at the row that comes nearest. One task orders
the sources, a narrow row each; no other order holds more than one bucket's rows.

Cases: a null text has no words and is taken as often as its neighbours, for 0 words;
a source without words gets the target 0; rows that repeat share a hash and are taken
as separate rows, in the order of what they carry besides; an empty table gives an empty result; other columns can be carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, stage

#: Buckets are the first hexadecimal digits of a row's hash, in two steps.
BUCKET_DIGITS = 4
HASH_DIGITS = 16
SEED = 20240607

ORACLE = f"""
WITH row_ AS (
  SELECT doc_id, coalesce('0' || source, '1') AS k, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, substr(md5('{SEED}-' || coalesce(CAST(doc_id AS VARCHAR), '') || '-' || coalesce(text, '')), 1, {HASH_DIGITS}) AS h FROM documents
), source_ AS (SELECT k, sum(size)::BIGINT AS source_size FROM row_ GROUP BY 1),
weighed AS (SELECT *, 1.0::DOUBLE + (row_number() OVER (ORDER BY k) - 1) % 3 AS weight, 3.0::DOUBLE * source_size AS most FROM source_),
level AS (SELECT *, most / weight AS level,
    (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS reached FROM weighed),
goal AS (SELECT k, source_size, least(most, coalesce(weight * (SELECT arg_min(reached, struct_pack(level, k)) FROM level WHERE reached <= level), most)) AS target FROM level),
rate AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS whole FROM goal),
run AS (SELECT r.*, t.source_size, t.target, t.whole, t.target - t.whole * t.source_size AS more, sum(size) OVER (PARTITION BY k ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM row_ r JOIN rate t USING (k)),
bucket AS (SELECT k, substr(h, 1, {BUCKET_DIGITS}) AS b, coalesce(sum(sum(size)) OVER (PARTITION BY k ORDER BY substr(h, 1, {BUCKET_DIGITS}) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM row_ GROUP BY 1, 2)
SELECT doc_id, size::BIGINT AS size, source_size, target, copies, (size * copies)::BIGINT AS taken
FROM (SELECT r.*, whole + CASE WHEN more - before > 0 AND upto - size / 2 <= more THEN 1 ELSE 0 END AS copies FROM run r JOIN bucket b ON b.k = r.k AND b.b = substr(r.h, 1, {BUCKET_DIGITS}))
"""


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key without null that orders as the sources do, null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def targets(sums: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """From (mix_key, source_size): adds weight and target. One row a source, so one task orders them."""
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.partitionBy().orderBy("mix_key")
    by_level = Window.partitionBy().orderBy("level", "mix_key")
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    ranked = (
        sums.withColumn("weight", F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1))
        .withColumn("most", F.col("source_size").cast("double") * max_epochs)
        .withColumn("level", F.col("most") / F.col("weight"))
    )
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    reached = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    return (
        ranked.withColumn("reached", reached)
        .withColumn("water", F.min(F.when(F.col("reached") <= F.col("level"), F.struct("level", "mix_key", "reached"))).over(everything)["reached"])
        .withColumn("target", F.least("most", F.coalesce(F.col("weight") * F.col("water"), F.col("most"))))
        .select("mix_key", "source_size", "weight", "target")
    )


def mix(docs: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken, and the columns in ``carry``, for every row of ``docs``."""
    base = docs.select(
        F.col("doc_id").alias("mix_id"),
        source_key(F.col("source")).alias("mix_key"),
        n_words(F.col("text")).alias("mix_size"),
        F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("-"), F.coalesce("text", F.lit("")))), 1, HASH_DIGITS).alias("mix_hash"),
        *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)),
    ).withColumn("bucket", F.conv(F.substring("mix_hash", 1, BUCKET_DIGITS), 16, 10).cast("int"))
    light = stage(base.select("mix_id", "mix_key", "mix_size", "mix_hash", "bucket"), "mix")
    rows = base if carry else light
    sums = stage(light.groupBy("mix_key", "bucket").agg(F.sum("mix_size").alias("bucket_size")), "mix-sums")
    goal = targets(sums.groupBy("mix_key").agg(F.sum("bucket_size").alias("source_size")), max_epochs, weights)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("whole", F.least(F.floor(rate), F.lit(max_epochs)).cast("long")).withColumn("more", F.col("target") - F.col("whole") * F.col("source_size"))
    fine = sums.withColumn("high", F.shiftright("bucket", 2 * BUCKET_DIGITS))
    coarse = fine.groupBy("mix_key", "high").agg(F.sum("bucket_size").alias("high_size"))
    above = Window.partitionBy("mix_key").orderBy("high").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("mix_key", "high").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.withColumn("high_before", F.coalesce(F.sum("high_size").over(above), F.lit(0))).join(goal, "mix_key").drop("high_size")
    before = F.col("high_before") + F.coalesce(F.sum("bucket_size").over(within), F.lit(0))
    plan = fine.join(coarse, ["mix_key", "high"]).withColumn("before", before).select("mix_key", "bucket", "source_size", "target", "whole", (F.col("more") - F.col("before")).alias("room"))
    ties = [F.xxhash64(*(f"carry_{i}" for i in range(len(carry))))] if carry else []
    running = Window.partitionBy("mix_key", "bucket").orderBy("mix_hash", "mix_id", *ties).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(plan, ["mix_key", "bucket"])
        .withColumn("run", F.sum("mix_size").over(running))
        .withColumn("copies", F.col("whole") + ((F.col("room") > 0) & (F.col("run") - F.col("mix_size") / 2 <= F.col("room"))).cast("long"))
        .select(F.col("mix_id").alias("doc_id"), F.col("mix_size").alias("size"), "source_size", "target", "copies", (F.col("mix_size") * F.col("copies")).alias("taken"), *(f"carry_{i}" for i in range(len(carry))))
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``."""
    columns = tuple(docs.columns)
    out = mix(docs, carry=columns, **options).where("copies > 0")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(*(F.col(f"carry_{i}").alias(c) for i, c in enumerate(columns)))
