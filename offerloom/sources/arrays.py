"""A splittable reader of files that are one JSON array.

The file is read as pieces that end at a closing brace, so every byte range of it is a task of its own.
Where a range begins, nobody knows yet whether it is inside a string, or how deep. So each range is first summed up by
its effect on both cases: the depth it adds, and whether it ends inside a string. Those
effects, a row per range, are composed in order, which gives each range its true beginning. Then
each range cuts its elements at the commas of depth 1. An element that goes on over ranges is joined from
its parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import written

ESCAPED = re.compile(r"\\.", re.S)
TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*(?:"|\Z|\\\Z)|[{}\[\],]', re.S)
REST = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)

EFFECTS = "file string, start long, depth_out long, string_out boolean, depth_in long, string_in boolean"
PARTS = "file string, start long, kind string, text string"


def effect(text: str, inside: bool) -> tuple[int, bool]:
    """The depth that a text adds, and whether it ends inside a string, if it begins inside one or not."""
    parts = ESCAPED.sub("", text).split('"')
    outside = parts[1 if inside else 0 :: 2]
    depth = sum(p.count("{") + p.count("[") - p.count("}") - p.count("]") for p in outside)
    return depth, inside == (len(parts) % 2 == 1)


def cut(text: str, inside: bool, depth: int) -> tuple[list[str], str, int]:
    """The parts of a text between commas of depth 1 and the array's own brackets, the rest that ends in an open string, and the depth before that rest.

    The last part is what is still open; a text that begins inside a string begins with the rest of it.
    """
    at = 0
    if inside:
        m = REST.match(text)
        if not m:
            return [""], text, depth
        at = m.end()
    parts, first = [], 0
    for m in TOKEN.finditer(text, at):
        mark = m[0]
        if mark[0] == '"':
            if len(mark) == 1 or not REST.fullmatch(mark[1:]):
                parts.append(text[first : m.start()])
                return parts, text[m.start() :], depth
        elif mark == ",":
            if depth == 1:
                parts.append(text[first : m.start()])
                first = m.end()
        elif mark in "{[":
            depth += 1
            if depth == 1:
                first = m.end()
        else:
            depth -= 1
            if depth == 0:
                parts.append(text[first : m.start()])
                first = m.end()
    parts.append(text[first:])
    return parts, "", depth


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): the pieces of the ranges in order; ``start`` is where a range begins."""
    return spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def runs(batches: Iterator) -> Iterator[tuple[str, int, str]]:
    """(file, start, text) of consecutive pieces of a range, with the braces that ended them."""
    for batch in batches:
        files, starts, values = (batch.column(k).to_pylist() for k in range(3))
        first = 0
        for k in range(1, len(files) + 1):
            if k == len(files) or (files[k], starts[k]) != (files[first], starts[first]):
                yield files[first], starts[first], "}".join(values[first:k]) + "}"
                first = k


def effects(spark: SparkSession, path: str) -> DataFrame:
    import pyarrow as pa

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple, list] = {}
        for file, start, text in runs(batches):
            s = state.setdefault((file, start), [0, False, 0, True])
            for k in (0, 2):
                depth, s[k + 1] = effect(text, s[k + 1])
                s[k] += depth
        for (file, start), s in state.items():
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((file, start, *s), (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_()))], names=["file", "start", "depth_out", "string_out", "depth_in", "string_in"])

    return pieces(spark, path).mapInArrow(sum_up, EFFECTS)


def beginnings(found: DataFrame) -> DataFrame:
    """(file, start, depth, inside) of every range: the effects before it, composed in order. A file has a row per range here."""

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        depth, inside, out = 0, False, []
        for r in rows.sort_values("start").itertuples():
            out.append((r.file, r.start, depth, inside))
            depth += r.depth_in if inside else r.depth_out
            inside = r.string_in if inside else r.string_out
        return pd.DataFrame(out, columns=["file", "start", "depth", "inside"])

    return found.groupBy("file").applyInPandas(compose, "file string, start long, depth long, inside boolean")


def elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of every element of the arrays at ``path``."""
    import pyarrow as pa

    first = F.broadcast(written(beginnings(effects(spark, path)), "ranges"))  # a row per byte range of the size that a task reads

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(file: str, start: int, rows: list[tuple[str, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array([start] * len(rows), pa.int64()), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["file", "start", "kind", "text"])

        def told() -> Iterator[pa.RecordBatch]:
            for b in batches:
                for d, i in zip(b.column(3).to_pylist()[:1], b.column(4).to_pylist()[:1]):
                    begin.setdefault((b.column(0)[0].as_py(), b.column(1)[0].as_py()), (d, i))
                for f, s, d, i in zip(*(b.column(k).to_pylist() for k in (0, 1, 3, 4))):
                    begin.setdefault((f, s), (d, i))
                yield b

        begin: dict[tuple, tuple] = {}
        now, depth, inside, open_, rest, cuts = None, 0, False, "", "", 0
        for file, start, text in runs(told()):
            if (file, start) != now:
                if now:
                    yield out(*now, [("tail" if cuts else "through", open_ + rest)])
                now, open_, rest, cuts = (file, start), "", "", 0
                depth, inside = begin[now]
            parts, left, depth = cut(rest + text, inside and not rest, depth)
            # an open string stays whole until it ends; one from the range before has no beginning here
            rest, inside = left, inside and not rest and left == text
            parts[0] = open_ + parts[0]
            rows = []
            for p in parts[:-1]:
                rows.append(("whole" if cuts else "head", p))
                cuts += 1
            open_ = parts[-1]
            if inside:
                open_, rest = open_ + rest, ""
            if rows:
                yield out(file, start, rows)
        if now:
            yield out(*now, [("tail" if cuts else "through", open_ + rest)])

    found = written(pieces(spark, path).join(first, ["file", "start"]).select("file", "start", "value", "depth", "inside").mapInArrow(split, PARTS), "parts")
    # a head ends what the last tail before it began; what lies between goes on through
    ends = found.where("kind <> 'whole'")
    order = Window.partitionBy("file").orderBy("start", F.when(F.col("kind") == "tail", 1).otherwise(0))  # two rows a range at most
    owner = F.coalesce(F.last(F.when(F.col("kind") == "tail", F.col("start")), True).over(order), F.lit(-1))
    joined = ends.withColumn("owner", owner).groupBy("file", "owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", F.when(F.col("kind") == "tail", 1).otherwise(0).alias("k"), "text"))), lambda x: x["text"]), "").alias("text"))
    return found.where("kind = 'whole'").select("file", "text").union(joined.select("file", "text"))


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The elements of JSON arrays as rows; a malformed one fails the read."""
    body = elements(spark, path).where(F.trim(F.regexp_replace("text", r"[\s\}\]]+$", "")) != "")
    return body.select(F.from_json("text", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
