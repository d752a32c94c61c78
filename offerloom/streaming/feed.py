"""The change feed and day counts as streams; the feed and the added days give what their batch forms give, the closed days without what comes late."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.mutate import last_wins

#: How long a delete is remembered against older changes that come late.
REMEMBER = "30 days"


def milliseconds(span: str) -> int:
    n, unit = span.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1000


def fold_stream(changes: DataFrame, target: str, checkpoint: str, key: str, order: str, columns: list[str], op: str = "op", remember: str = REMEMBER):
    """Starts a query that folds a feed by key in its state, and adds what takes effect in batch N to ``target``/N.

    A batch costs what it changes: the state has for a key the place in the order of its newest change and whether that
    was a delete, and nothing that is stored is read or written again. A batch that runs again after a failure
    overwrites its own folder. Changes not newer than what is known of their key have no effect; a
    delete is remembered for ``remember``, then its key leaves the state. Rows without a key or an order are skipped.
    """
    names = list(dict.fromkeys([key, *columns, order, op]))
    fields = {f.name: f for f in changes.schema.fields}
    kind, span = fields[order].dataType.simpleString(), milliseconds(remember)

    def fold(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        newest = None
        for part in parts:
            row = part.loc[[part[order].idxmax()]]
            newest = row if newest is None or row[order].iloc[0] > newest[order].iloc[0] else newest
        if newest is None or state.exists and newest[order].iloc[0] <= state.get[0]:
            return
        gone = newest[op].iloc[0] == "DELETE"
        state.update((newest[order].iloc[0].item(), bool(gone)))
        if gone:
            state.setTimeoutDuration(span)
        yield newest[names]

    usable = changes.select(*names).where(F.col(key).isNotNull() & F.col(order).isNotNull())
    effective = usable.groupBy(key).applyInPandasWithState(fold, T.StructType([fields[c] for c in names]), f"newest {kind}, gone boolean", "update", GroupStateTimeout.ProcessingTimeTimeout)

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    # time limits run with the batches that have rows; batches without any would go on for ever
    conf, setting = changes.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(setting)
    conf.set(setting, "false")
    try:
        return effective.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(setting, before)


def folded(spark: SparkSession, target: str, key: str, order: str, op: str = "op") -> DataFrame:
    """The live rows after all batches so far."""
    return last_wins(spark.read.parquet(target).drop("batch"), [key], [F.desc(order)]).where(F.col(op) != "DELETE").drop(op)


def compact(spark: SparkSession, target: str, onto: str, key: str, order: str) -> int:
    """Writes the newest change of each key at ``target`` to ``onto``, deletes included, as its batch 0; how many batches that replaces.

    For when the stream is stopped: it goes on with ``onto`` as its target, and the old folder can go.
    """
    all_ = spark.read.parquet(target)
    n = all_.select("batch").distinct().count()
    last_wins(all_.drop("batch"), [key], [F.desc(order)]).write.mode("overwrite").parquet(f"{onto}/batch=-1")
    return n


def day_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events per day and type on a stream: late rows count up to ``delay``."""
    w = F.window("ts", "1 day")
    return events.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


def added_days(events: DataFrame, target: str, checkpoint: str):
    """Starts a query that adds each batch's counts by day and type to ``target``/batch=N; ``all_days`` adds them up.

    Every row counts, however late it is and whether its day is over or not; rows without a time have a day of null. Nothing is kept in state,
    and a batch that runs again after a failure overwrites its own folder.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def all_days(spark: SparkSession, target: str) -> DataFrame:
    """(day, event_type, n) of all batches so far."""
    added = spark.read.schema("day timestamp, event_type string, n long").parquet(target)
    return added.groupBy("day", "event_type").agg(F.sum("n").alias("n"))


def closed_days(events: DataFrame, target: str, checkpoint: str, delay: str = "1 day"):
    """Starts a query that adds each day's counts to ``target`` once, when no row up to ``delay`` late can change them; the state of the day is freed then.

    A row that comes later than that is in no count: ``late_groups`` tells how many (day, type) groups had such rows.
    """
    return day_counts(events, delay).writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_groups(query) -> int:
    """How many groups of rows behind the watermark the batches of this run left out, a group counted once a batch and task."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def most_state_rows(query) -> int:
    """The most rows that the state held after a batch of this run."""
    return max((s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]), default=0)
