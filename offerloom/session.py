"""A session with the settings that the operators assume: UTC, adaptive execution, ANSI arithmetic."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

HOME = str(Path(__file__).resolve().parent.parent)


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers that start from now on import this package from where the driver has it."""
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if HOME not in path.split(":"):
        env["PYTHONPATH"] = f"{HOME}:{path}".rstrip(":")
    return spark


def session(master: str = "local[*]", partitions: int = 8, **more: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("offerloom")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return importable(builder.config(map=settings | more).getOrCreate())
