"""Snapshot imports: the price list and the device repertory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import mutate as M
from ..operators import relational as R


def import_release(stored: dict[str, DataFrame], rows: DataFrame, release: int, published, newest: bool) -> dict[str, DataFrame]:
    """One release of a price list: dimension, facts, change points, and deactivation.

    rows: (aic, ingredient, company, price, note). stored: ``ingredients`` (ingredient, first_release),
    ``medicines`` (aic, ingredient, company, price, note, first_release, active), ``history`` (aic, published, price,
    note). A release older than the newest stored one only fills gaps and deactivates nothing.
    """
    usable = rows.where("aic IS NOT NULL AND ingredient IS NOT NULL AND company IS NOT NULL")
    once = R.first_by(usable, ["aic"], [F.col("ingredient"), F.col("company"), F.asc_nulls_last("price")])
    dims = once.select("ingredient").distinct().withColumn("first_release", F.lit(release))
    ingredients = M.upsert(stored["ingredients"], dims, ["ingredient"], keep_old=["first_release"])
    facts = once.select("aic", "ingredient", "company", "price", "note", F.lit(release).alias("first_release"), F.lit(True).alias("active"))
    if newest:
        medicines = M.deactivate_missing(M.upsert(stored["medicines"], facts, ["aic"], keep_old=["first_release"]), facts, ["aic"])
    else:
        medicines = M.backfill(stored["medicines"], facts, ["aic"])
    points = once.select("aic", F.lit(published).cast("date").alias("published"), "price", "note")
    both = M.upsert(stored["history"], points, ["aic", "published"])
    history = R.change_points(both, ["aic"], [F.col("published")], ["price", "note"])
    return {"ingredients": ingredients, "medicines": medicines, "history": history}


def import_devices(stored: DataFrame, rows: DataFrame, prefixes: list[str], file_size: int, large: int = 50 * 1024 * 1024) -> DataFrame:
    """The device repertory: rows in scope, latest version per key, only if not older; what left the scope goes.

    rows: (key, code, begins, ends, seq), stored: (key, code, begins). Files of ``large`` bytes or more are full dumps:
    their rows out of scope are ignored; in smaller ones they delete.
    """
    graded = R.longest_prefix(rows, "code", prefixes)
    latest = R.first_by(graded, ["key"], [F.desc_nulls_last("begins"), (F.col("ends").isNull() | (F.year("ends") >= 9999)).desc(), F.desc("seq")])
    inside = latest.where("prefix IS NOT NULL").select(*stored.columns)
    kept = M.upsert_newer(stored, inside, ["key"], "begins")
    if file_size >= large:
        return kept
    return M.delete_present(kept, latest.where("prefix IS NULL"), ["key"])[0]
