"""Streams against their batch forms: shuffled, repeated, late and restarted input."""

from __future__ import annotations

import datetime
import random
from collections import Counter

from pyspark.sql import functions as F

from offerloom.operators.mutate import last_wins
from offerloom.streaming import feed

SCHEMA = "k string, at long, v string, op string"


def test_fold_is_that_of_all_changes(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(12)}" if rng.random() < 0.95 else None, n, rng.choice(["a", "b", None]), rng.choice(["INSERT", "UPDATE", "DELETE"])) for n in range(120)]
    rows += rng.sample(rows, 30)
    rng.shuffle(rows)
    source, target, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))

    def run(onto=target):
        changes = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        q = feed.fold_stream(changes, onto, state, "k", "at", ["k", "at", "v"])
        q.awaitTermination()
        return q

    def live(*targets):
        return sorted(tuple(r) for r in feed.folded(spark, targets[0], "k", "at").select("k", "at", "v").collect())

    def wanted(n):
        newest = {}
        for r in rows[:n]:
            if r[0] is not None and r[1] > newest.get(r[0], (None, -1))[1]:
                newest[r[0]] = r
        return sorted(r[:3] for r in newest.values() if r[3] != "DELETE")

    for first, last in ((0, 50), (50, 100), (100, 150)):  # the stream stops and goes on from its checkpoint
        spark.createDataFrame(rows[first:last], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        q = run()
        assert live(target) == wanted(last)
    assert feed.most_state_rows(q) <= 2 * 12
    batches = spark.read.parquet(target)
    assert batches.count() < len(rows)  # only what takes effect is written
    small = f"file://{tmp_path}/small"
    assert feed.compact(spark, target, small, "k", "at") == 3 and live(small) == wanted(150)
    spark.createDataFrame([("k0", 1000, "late", "UPDATE"), ("k1", 0, "old", "UPDATE")], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run(small)
    rows += [("k0", 1000, "late", "UPDATE")]
    assert live(small) == wanted(151)


def test_days_close_once_and_late_rows_are_counted_apart(spark, tmp_path):
    source, target, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    day = lambda n, h=0: datetime.datetime(2026, 3, 1) + datetime.timedelta(days=n, hours=h)

    def run(*rows):
        spark.createDataFrame(list(rows), "ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(source)
        events = spark.readStream.schema("ts timestamp, event_type string").option("maxFilesPerTrigger", 1).parquet(source)
        q = feed.closed_days(events, target, state, "1 day")
        q.awaitTermination()
        return q, sorted((r.day.day, r.event_type, r.n) for r in spark.read.parquet(target).collect())

    q, got = run(*[(day(k, h), "view") for k in range(20) for h in (1, 5)], (day(3, 2), "cart"))
    assert got == [(k + 1, "view", 2) for k in range(3)] + [(4, "cart", 1), (4, "view", 2)] + [(k + 1, "view", 2) for k in range(4, 18)]
    assert feed.late_groups(q) == 0
    # within the delay a late row counts, behind it it is left out and told
    q, got = run((day(19, 2), "view"), (day(2), "view"), (day(2), "cart"), (day(22), "view"))
    assert feed.late_groups(q) == 2 and [g for g in got if g[0] >= 19] == [(19, "view", 2), (20, "view", 3)] and (3, "view", 2) in got
    assert feed.most_state_rows(q) <= 4  # open days only, however many have passed


def test_added_days_count_every_row(spark, tmp_path):
    import offerloom.queries  # noqa: F401  (registers)
    from offerloom.registry import QUERIES

    at = lambda day, hour=3: datetime.datetime(*day, hour)
    days = [(2026, 3, 1), (2026, 3, 2), (2026, 3, 20), (2026, 3, 21), (1969, 5, 5), (2026, 3, 1)]
    rows = [(at(d), kind) for d in days for kind in ("view", "cart", None)] + [(None, "view"), (None, None), (at((2026, 3, 21), 9), "view")]
    want = Counter((str(ts.date()) if ts else None, kind) for ts, kind in rows)
    schema = "ts timestamp, event_type string"
    source, target, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    for part in (rows[9:], rows[:9]):  # the later days come first; the stream stops and goes on
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        feed.added_days(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), target, state).awaitTermination()
    assert {(str(r.day.date()) if r.day else None, r.event_type): r.n for r in feed.all_days(spark, target).collect()} == want
    spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/events.parquet")
    assert {(r.day, r.event_type): r.n for r in QUERIES["t_06_stream_days"](spark, f"file://{tmp_path}").collect()} == want
    spark.createDataFrame([], schema).write.parquet(f"file://{tmp_path}/none/events.parquet")
    assert QUERIES["t_06_stream_days"](spark, f"file://{tmp_path}/none").collect() == []


def test_stream_and_batch_fold_of_the_given_feed(spark, small, tmp_path):
    from offerloom.queries.mutations import feed as given
    from offerloom.registry import Tables

    rows = given(Tables(spark, small))
    rows.union(rows.limit(50)).repartition(3).write.parquet(f"file://{tmp_path}/in")
    changes = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    feed.fold_stream(changes, f"file://{tmp_path}/out", f"file://{tmp_path}/state", "user_id", "event_id", ["user_id", "event_id", "value"]).awaitTermination()
    want = last_wins(rows, ["user_id"], [F.desc("event_id")]).where("op <> 'DELETE'").select("user_id", "event_id")
    got = feed.folded(spark, f"file://{tmp_path}/out", "user_id", "event_id").select("user_id", "event_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
