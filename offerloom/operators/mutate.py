"""Mutations as new snapshots: upserts, replacements, deactivation and deletes of keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_wins(incoming: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key of a batch: the last in ``order``."""
    return incoming.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep_old: Sequence[str] = ()) -> DataFrame:
    """New rows replace old ones of their key; columns in ``keep_old`` keep the old value where there is one."""
    a = old.select(*keys, F.struct(*old.columns).alias("_a"))
    b = new.select(*keys, F.struct(*new.columns).alias("_b"))
    joined = a.join(b, list(keys), "full")

    def value(c: str) -> Column:
        x, y = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        return F.coalesce(x, y).alias(c) if c in keep_old else F.when(F.col("_b").isNotNull(), y).otherwise(x).alias(c)

    return joined.select(*keys, *(value(c) for c in old.columns if c not in keys))


def upsert_newer(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """As upsert, but an incoming row counts only if its version isn't older; a missing version on either side accepts it."""
    before = old.select(*keys, F.col(version).alias("_v"), F.lit(True).alias("_there"))
    fresh = new.join(before, list(keys), "left").where(F.col("_there").isNull() | F.col("_v").isNull() | F.col(version).isNull() | (F.col(version) >= F.col("_v"))).drop("_v", "_there")
    return upsert(old, fresh, keys)


def backfill(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert-only: rows of keys that aren't there yet."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"))


def deactivate_missing(old: DataFrame, snapshot: DataFrame, keys: Sequence[str], flag: str = "active") -> DataFrame:
    """Rows whose key the newest snapshot lacks become inactive."""
    here = snapshot.select(*keys).distinct().withColumn("_here", F.lit(True))
    return old.join(here, list(keys), "left").withColumn(flag, F.col(flag) & F.col("_here").isNotNull()).drop("_here").select(*old.columns)


def delete_present(old: DataFrame, gone: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The table without the keys in ``gone``, and the rows that were there to delete."""
    return old.join(gone.select(*keys), list(keys), "left_anti"), old.join(gone.select(*keys), list(keys), "left_semi")


def replace_children(old: DataFrame, new: DataFrame, parent: str, touched: DataFrame | None = None) -> DataFrame:
    """All children of touched parents go, the new ones come."""
    parents = (touched if touched is not None else new).select(parent).distinct()
    return old.join(parents, parent, "left_anti").unionByName(new)


def patched(old: DataFrame, patch: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Maps in ``column`` take over the entries of the patch."""
    p = patch.select(*keys, F.col(column).alias("_patch"))
    none = F.create_map().cast(dict(old.dtypes)[column])

    def merged(a: Column, b: Column) -> Column:
        return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)

    return old.join(p, list(keys), "left").withColumn(column, merged(F.coalesce(F.col(column), none), F.coalesce(F.col("_patch"), none))).drop("_patch").select(*old.columns)


def stamped(old: DataFrame, which: Column, column: str, value: Column) -> DataFrame:
    """Soft delete: the rows chosen get a mark unless they have one."""
    return old.withColumn(column, F.when(which & F.col(column).isNull(), value).otherwise(F.col(column)))


def get_or_create(dimension: DataFrame, wanted: DataFrame, slug: str, make: dict[str, Column]) -> DataFrame:
    """The dimension with a row for every wanted slug."""
    new = wanted.select(slug).distinct().join(dimension.select(slug), slug, "left_anti")
    for name, value in make.items():
        new = new.withColumn(name, value)
    return dimension.unionByName(new.select(*dimension.columns))


def unchanged(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files (path, content) whose checksum isn't stored yet."""
    return files.withColumn("sha256", F.sha2("content", 256)).join(stored.select("sha256"), "sha256", "left_anti")


def fold(old: DataFrame, changes: DataFrame, key: str, order: Sequence[Column], op: str = "op") -> DataFrame:
    """A change feed applied to a table: the last change of a key decides; deletes drop it."""
    last = last_wins(changes, [key], order)
    return old.join(last.select(key), key, "left_anti").unionByName(last.where(F.col(op) != "DELETE").select(*old.columns))
