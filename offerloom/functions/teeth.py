"""The 32 teeth of the permanent dentition, made from the rules of the three notations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Quadrants with their Palmer corner, and the kinds of teeth from the middle outwards.
QUADRANTS = [(1, "Superiore Destro", "┘"), (2, "Superiore Sinistro", "└"), (3, "Inferiore Sinistro", "┌"), (4, "Inferiore Destro", "┐")]
KINDS = ["Incisivo centrale", "Incisivo laterale", "Canino", "Primo premolare", "Secondo premolare", "Primo molare", "Secondo molare", "Terzo molare"]


def rows() -> list[tuple]:
    out = []
    for q, name, mark in QUADRANTS:
        for n, kind in enumerate(KINDS, 1):
            universal = {1: 9 - n, 2: 8 + n, 3: 25 - n, 4: 24 + n}[q]
            out.append((f"{q}{n}", str(universal), n, mark, q, name, f"{kind} {name.lower()}", n == 8, f"dente-fdi-{q}{n}"))
    return out


def teeth(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "fdi string, universal string, palmer int, mark string, quadrant int, quadrant_name string, name string, wisdom boolean, slug string")


def palmer(t: DataFrame) -> Column:
    return F.concat(F.col("palmer").cast("string"), F.col("mark"))


def by_quadrant(t: DataFrame) -> DataFrame:
    return t.groupBy("quadrant").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("palmer", "fdi"))), lambda x: x["fdi"]), ",").alias("teeth"))
