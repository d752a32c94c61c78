"""Sharding by fixed virtual slots.

Every row hashes into one of a fixed number of virtual slots. Bytes and rows are
summed per slot, which is a table of proven size (``SLOTS`` rows), and a versioned
slot-to-shard map says where each slot lives. Rebalancing edits the map, never the
hash: slots move from heavy to light shards until no move helps. Growing by a shard
moves slots into the new shard only. A run with a store edits the latest map there, for the
sizes it finds, and appends it as the next version; no version is ever overwritten, and
of two runs at once the later one takes the number after.

Cases: a null text has no bytes and costs the 16 bytes of its row; null ids hash like
any value; repeated rows (id and text) share a slot, which is never split, and take successive
places in it; an empty table gives an empty result; extra columns are ignored by the assignment.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import stage

SLOTS = 8192
ROW_BYTES = 16

MAP_SCHEMA = "version int, shards int, virtual_slot int, shard int, slot_bytes long, slot_rows long"


@dataclass(frozen=True)
class SlotMap:
    """A version of the map: ``shard_of[slot]``, with the sizes it was made for."""

    version: int
    shards: int
    shard_of: tuple[int, ...]
    slot_bytes: tuple[int, ...]
    slot_rows: tuple[int, ...]

    @staticmethod
    def first(shards: int, slot_bytes: list[int], slot_rows: list[int]) -> "SlotMap":
        return SlotMap(1, shards, tuple(i % shards for i in range(len(slot_bytes))), tuple(slot_bytes), tuple(slot_rows))

    def loads(self) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.shard_of):
            out[shard] += self.slot_bytes[slot]
        return out

    def rebalanced(self) -> "SlotMap":
        """The next version: while it helps, the heaviest shard gives the lightest the slot nearest to half their gap."""
        shard_of, loads = list(self.shard_of), self.loads()
        held: list[set[int]] = [set() for _ in range(self.shards)]
        for slot, shard in enumerate(shard_of):
            if self.slot_bytes[slot]:
                held[shard].add(slot)
        for _ in range(20 * len(shard_of)):
            heavy = max(range(self.shards), key=lambda s: (loads[s], -s))
            light = min(range(self.shards), key=lambda s: (loads[s], s))
            gap = loads[heavy] - loads[light]
            fits = [s for s in held[heavy] if self.slot_bytes[s] < gap]
            if not fits:
                break
            slot = min(fits, key=lambda s: (abs(2 * self.slot_bytes[s] - gap), s))
            held[heavy].remove(slot)
            held[light].add(slot)
            shard_of[slot] = light
            loads[heavy] -= self.slot_bytes[slot]
            loads[light] += self.slot_bytes[slot]
        return SlotMap(self.version + 1, self.shards, tuple(shard_of), self.slot_bytes, self.slot_rows)

    def grown(self) -> "SlotMap":
        """The next version with one more shard, which takes slots from the heaviest shards until it has its share."""
        loads, shard_of, new = [*self.loads(), 0], list(self.shard_of), self.shards
        share = sum(self.slot_bytes) / (self.shards + 1)
        by_shard: list[list[int]] = [[] for _ in range(self.shards)]
        for slot, shard in enumerate(shard_of):
            by_shard[shard].append(slot)
        while loads[new] < share:
            heavy = max(range(self.shards), key=lambda s: (loads[s], -s))
            fits = [s for s in by_shard[heavy] if self.slot_bytes[s] and loads[new] + self.slot_bytes[s] <= share]
            if not fits:
                break
            slot = max(fits, key=lambda s: (min(self.slot_bytes[s], loads[heavy] - share), -s))
            by_shard[heavy].remove(slot)
            shard_of[slot] = new
            loads[heavy] -= self.slot_bytes[slot]
            loads[new] += self.slot_bytes[slot]
        return SlotMap(self.version + 1, self.shards + 1, tuple(shard_of), self.slot_bytes, self.slot_rows)

    def rows(self) -> list[tuple]:
        return [(self.version, self.shards, i, *x) for i, x in enumerate(zip(self.shard_of, self.slot_bytes, self.slot_rows))]

    def save(self, spark: SparkSession, path: str) -> "SlotMap":
        """Append this map to the versions at ``path`` under the first free number from its own on; what was written."""
        now = self
        while True:
            if now.version not in SlotMap.versions(spark, path):
                try:
                    spark.createDataFrame(now.rows(), MAP_SCHEMA).coalesce(1).write.mode("errorifexists").parquet(f"{path}/map_version={now.version}")
                    return now
                except AnalysisException as e:
                    if e.getCondition() != "PATH_ALREADY_EXISTS":
                        raise
            now = replace(now, version=now.version + 1)

    @staticmethod
    def versions(spark: SparkSession, path: str) -> list[int]:
        """The versions at ``path`` that were written whole."""
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        found = [s.getPath() for s in fs.listStatus(where)] if fs.exists(where) else []
        whole = [p.getName() for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in whole if n.startswith("map_version="))

    @staticmethod
    def latest(spark: SparkSession, path: str) -> "SlotMap | None":
        found = SlotMap.versions(spark, path)
        return SlotMap.load(spark, path, found[-1]) if found else None

    @staticmethod
    def load(spark: SparkSession, path: str, version: int) -> "SlotMap":
        rows = sorted(spark.read.schema(MAP_SCHEMA).parquet(f"{path}/map_version={version}").collect(), key=lambda r: r.virtual_slot)
        return SlotMap(version, rows[0].shards, tuple(r.shard for r in rows), tuple(r.slot_bytes for r in rows), tuple(r.slot_rows for r in rows))


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of every row."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return docs.select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def measure(slotted: DataFrame, shards: int, slots: int = SLOTS) -> SlotMap:
    """Version 1 of the map, with the bytes and rows of every slot; at most ``slots`` rows reach the driver."""
    size, rows = [0] * slots, [0] * slots
    for r in slotted.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        size[r.virtual_slot], rows[r.virtual_slot] = r.b, r.n
    return SlotMap.first(shards, size, rows)


def assign(slotted: DataFrame, slot_map: SlotMap) -> DataFrame:
    """Adds shard, and slot: the place in the shard, gapless from 0 by virtual slot, then row."""
    spark, at, places = slotted.sparkSession, [0] * slot_map.shards, []
    for v, shard in enumerate(slot_map.shard_of):
        places.append((v, shard, at[shard]))
        at[shard] += slot_map.slot_rows[v]
    where = F.broadcast(spark.createDataFrame(places, "virtual_slot int, shard int, first long"))  # one row a slot
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    return (
        slotted.withColumn("n", F.row_number().over(inside))
        .join(where, "virtual_slot")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("n") - 1).cast("long").alias("slot"), "virtual_slot")
    )


def shard_documents(docs: DataFrame, shards: int = 40, slots: int = SLOTS, store: str | None = None) -> DataFrame:
    """Balanced shards of ``docs``; with ``store``, from the latest map there, whose next version is kept there too."""
    spark, slotted = docs.sparkSession, stage(with_slots(docs, slots), "slotted")
    now = measure(slotted, shards, slots)
    known = SlotMap.latest(spark, store) if store else None
    if known and (known.shards, len(known.shard_of)) == (shards, slots):  # the map in use, with the sizes of today
        now = replace(now, version=known.version, shard_of=known.shard_of)
    elif known:
        now = replace(now, version=known.version + 1)
    if store and not known:
        now = now.save(spark, store)
    final = now.rebalanced()
    if store:
        final = final.save(spark, store)
    return (
        assign(slotted, final)
        .withColumn("law", F.lit("bytes"))
        .withColumn("grown_shard", F.lit(None).cast(T.IntegerType()))
        .select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "virtual_slot")
    )
