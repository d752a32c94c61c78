"""Named queries over the test tables: each is a function of the tables, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Paths handed out below the shared folder that are still there.
SCRATCH: list[str] = []


class Tables:
    """The tables of a folder as attributes, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def scratch(self, name: str) -> str:
        """A fresh path in the folder that all executors share."""
        return scratch(self.spark, name)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in a local session that sets none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="offerloom-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    SCRATCH.append(f"{shared_folder(spark)}/scratch/{name}-{uuid.uuid4().hex}")
    return SCRATCH[-1]


def sweep(spark: SparkSession, since: int = 0) -> None:
    """Delete the scratch tables of this process but the first ``since``: for when their results are written or no longer wanted."""
    while len(SCRATCH) > since:
        where = spark._jvm.org.apache.hadoop.fs.Path(SCRATCH.pop())
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, and losing an executor loses nothing."""
    path = scratch(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def query(name: str, oracle: str | None = None) -> Callable:
    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if oracle:
            ORACLES[name] = oracle
        return f

    return add
