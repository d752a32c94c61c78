"""A work queue as a table of versions: every change writes the next version, so two workers never get one task.

A version is the whole queue (id, name, status, worker). A change reads the latest
version and writes its successor under the next number; who finds that number taken reads anew.
A version counts once it was written whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUEUE = "id long, name string, status string, worker string"


def versions(spark: SparkSession, path: str) -> list[int]:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    where = hadoop(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(p.getName()[1:]) for p in found if p.getName().startswith("v") and fs.exists(hadoop(p, "_SUCCESS")))


def latest(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    n = versions(spark, path)[-1]
    return n, spark.read.schema(QUEUE).parquet(f"{path}/v{n}")


def changed(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], tries: int = 100) -> DataFrame:
    """The queue after ``change``, which is applied to the latest version there is when it is written."""
    for _ in range(tries):
        n, queue = latest(spark, path)
        try:
            change(queue).write.mode("errorifexists").parquet(f"{path}/v{n + 1}")
            return spark.read.schema(QUEUE).parquet(f"{path}/v{n + 1}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_ALREADY_EXISTS":
                raise
    raise RuntimeError(f"{path}: the next version was always taken")


def build(tasks: DataFrame, path: str) -> None:
    """A fresh queue of tasks (id, name), all pending; the history of a queue that is there stays."""
    spark = tasks.sparkSession
    fresh = tasks.select(F.col("id").cast("long").alias("id"), "name", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("worker"))
    if not versions(spark, path):
        fresh.write.parquet(f"{path}/v1")
    else:
        changed(spark, path, lambda q: q.where("status <> 'pending'").unionByName(fresh))


def claim(spark: SparkSession, path: str, worker: str, most: int = 1) -> DataFrame:
    """The next ``most`` pending tasks by id, now the worker's; tasks without id or name fail instead."""

    def take(queue: DataFrame) -> DataFrame:
        valid = F.col("id").isNotNull() & (F.length(F.trim(F.coalesce("name", F.lit("")))) > 0)
        first = queue.where((F.col("status") == "pending") & valid).orderBy("id").limit(most).select("id", F.lit(True).alias("mine"))
        mine, pending = F.coalesce("mine", F.lit(False)), F.col("status") == "pending"
        status = F.when(pending & ~valid, "failed").when(pending & mine, "claimed").otherwise(F.col("status"))
        return queue.join(first, "id", "left").select("id", "name", status.alias("status"), F.when(pending & mine, worker).otherwise(F.col("worker")).alias("worker"))

    before = latest(spark, path)[1].where((F.col("status") == "claimed") & (F.col("worker") == worker)).select("id")
    held = [r.id for r in before.collect()]  # what one worker holds
    after = changed(spark, path, take).where((F.col("status") == "claimed") & (F.col("worker") == worker))
    return after.where(~F.col("id").isin(held)) if held else after


def finish(spark: SparkSession, path: str, done: DataFrame) -> None:
    """Claimed tasks of ``done`` (id, ok) end as done or failed."""
    ends = done.select("id", "ok")
    status = F.when((F.col("status") == "claimed") & F.col("ok").isNotNull(), F.when(F.col("ok"), "done").otherwise("failed")).otherwise(F.col("status"))
    changed(spark, path, lambda q: q.join(ends, "id", "left").select("id", "name", status.alias("status"), "worker"))


def counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
