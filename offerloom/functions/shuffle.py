"""Seeded shuffles: the exact generator where order has to be the same everywhere, a hash order where any seeded order does."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.relational import ranked
from ..registry import written


def fnv1a(text: str) -> int:
    """32-bit FNV-1a over code units. Its offset basis and prime."""
    h = 0x811C9DC5
    units = text.encode("utf-16-le")
    for i in range(0, len(units), 2):
        h = ((h ^ (units[i] | units[i + 1] << 8)) * 0x01000193) & 0xFFFFFFFF
    return h


def shuffled(items: list, seed: str, scaled: bool = False) -> list:
    """Fisher-Yates from the end with a 32-bit congruential generator; places by remainder, or scaled. Its factor and step."""
    out, state = list(items), fnv1a(seed)
    for i in range(len(out) - 1, 0, -1):
        state = (state * 1664525 + 1013904223) & 0xFFFFFFFF
        j = state * (i + 1) >> 32 if scaled else state % (i + 1)
        out[i], out[j] = out[j], out[i]
    return out


FACTOR, STEP, MASK = 1664525, 1013904223, 0xFFFFFFFF


def jumped(start: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The generator's states after so many steps, by repeated squaring of its map, for all rows at once."""
    state, factor, step = start.astype("u8"), FACTOR, STEP
    for bit in range(int(steps.max(initial=0)).bit_length()):
        state = np.where(steps >> bit & 1 == 1, (state * np.uint64(factor) + np.uint64(step)) & np.uint64(MASK), state)
        factor, step = factor * factor & MASK, (factor * step + step) & MASK
    return state


def seeded_shuffle(df: DataFrame, scaled: bool = False) -> DataFrame:
    """(seed, item) to (seed, item, place): the order that ``shuffled`` gives, without gathering the items of a seed.

    Step i swaps cells i and j(i) <= i, from the last cell down, and every j(i) is drawn on its own by jumping ahead.
    What cell i holds when its step comes was put there by the next step above that chose
    it, and that step brought what its own cell held then. So each step points to one above
    it, and following the pointers, which are doubled until they stop, leads to the item. Their number of
    hops is about the logarithm of the number of items, that of rounds the logarithm of this.
    """
    size = df.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    items = written(ranked(df.select("seed", "item"), ["seed"], ["item"], "rank").select("seed", "item", (F.col("rank") - 1).alias("i")), "items")

    @F.pandas_udf("long")
    def chosen(seed: pd.Series, i: pd.Series, n: pd.Series) -> pd.Series:
        start = seed.map({s: fnv1a(s) for s in seed.unique()}).to_numpy("u8")
        cell = i.to_numpy("i8")
        state, span = jumped(start, n.to_numpy("i8") - cell), (cell + 1).astype("u8")
        return pd.Series((state * span >> np.uint64(32) if scaled else state % span).astype("i8"))

    # the last cell's step is the first draw; cell 0 has no step and keeps what it holds
    steps = items.select("seed", "i").join(size, "seed").select("seed", "i", F.when(F.col("i") == 0, 0).otherwise(chosen("seed", "i", "n")).alias("j"))
    steps = written(steps, "steps")
    above = Window.partitionBy("seed", "j").orderBy("i")  # the steps that choose a cell: few, about the logarithm of the number of items
    result = written(steps.withColumn("next", F.lead("i").over(above)), "results")
    # what a cell holds at its own step: from the first step above it that chose it, else its own item
    source = steps.where("i > j").groupBy("seed", F.col("j").alias("i")).agg(F.min("i").alias("to"))
    point = written(steps.select("seed", "i").join(source, ["seed", "i"], "left").select("seed", "i", F.coalesce("to", "i").alias("to")), "pointers")
    while True:
        ahead = point.select("seed", F.col("i").alias("to"), F.col("to").alias("past"))
        after = written(point.join(ahead, ["seed", "to"]).select("seed", "i", F.col("past").alias("to"), (F.col("past") != F.col("to")).alias("moved")), "pointers")
        point = after.select("seed", "i", "to")
        if not after.where("moved").limit(1).count():
            break
    held = point.select("seed", F.col("i").alias("next"), "to")
    found = result.join(held, ["seed", "next"], "left").select("seed", F.col("i").alias("place"), F.coalesce("to", "j").alias("i"))
    return found.join(items, ["seed", "i"]).select("seed", "item", "place")


def hash_order(df: DataFrame, seed: str, key: str) -> DataFrame:
    """A seeded order without gathering groups."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key)
