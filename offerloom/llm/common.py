"""Helpers shared by the corpus operators: the shared folder, staged tables, size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word rule of every operator: maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: A side is broadcast only if it was counted and holds at most this many narrow rows.
BROADCAST_ROWS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in a local session that sets none, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="offerloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths of staged tables that are still there, in the order of their writing.
STAGED: list[str] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    STAGED.append(path)
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._staged_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def unstage(*staged: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in staged:
        path = getattr(df, "_staged_path", None)
        if path in STAGED:
            STAGED.remove(path)
            delete(df.sparkSession, path)


def sweep(spark: SparkSession, since: int = 0) -> None:
    """Delete all staged tables but the first ``since``: for when what was made of them is written, or no longer wanted."""
    while len(STAGED) > since:
        delete(spark, STAGED.pop())


def small_enough(staged: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``staged`` with a broadcast hint if it is counted to hold at most ``limit`` rows, else unchanged."""
    return F.broadcast(staged) if staged.count() <= limit else staged


def utf8(column) -> list:
    """The UTF-8 bytes of an Arrow string column, None for null."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
