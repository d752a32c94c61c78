"""Dated price lists in folders, archives and loose files: the best list of each day, decoded and read.

Files are found and read by Spark's own binary reader, so they may lie in any store it knows; an archive is opened in
the task that holds it. A folder or an archive gives its best list by name, a loose list itself.
The day comes from the path, else from the list's own name, else from its header; of several
lists of one day the one whose path is last counts.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import written
from .files import LIST_COLUMNS

#: Names of lists that don't count, of those that do, and what parts of a name are worth.
SKIPPED = ("prezzo_uguale", "unici_del_raggruppamento", "nome_commerciale", "principio_attivo")
MAIN = "lista_farmaci_equivalenti.csv"
WORTH = (("equivalenti", 50), ("trasparenza", 40), ("", 10))
#: The months of a header's date.
MONTHS = ("gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre")

FOUND = "path string, origin string, member string, score int, day date, body binary"
DAY = re.compile(r"(?<!\d)(\d{4})-(\d{2})-(\d{2})(?!\d)")
WRITTEN_DAY = re.compile(rf"(?<!\d)(\d{{1,2}})\s+({'|'.join(MONTHS)})\s+(\d{{4}})", re.I)


def name_score(path: str) -> int:
    """What a list is worth by its name; below 1 it doesn't count."""
    name = path.rsplit("/", 1)[-1].lower()
    if any(s in name for s in SKIPPED):
        return -100
    if name == MAIN:
        return 100
    return next((n for part, n in WORTH if part in name), 0) if name.endswith(".csv") else 0


def decoded(raw: bytes) -> str:
    """A list's text: UTF-8 where it is marked so, else Windows-1252, else Latin-1, which any bytes are."""
    if raw.startswith(b"\xef\xbb\xbf"):
        try:
            return raw.decode("utf-8-sig")
        except UnicodeDecodeError:
            pass
    try:
        return raw.decode("cp1252")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def day_of(text: str):
    """The first date in a text, as digits or as written in a header; None without one, or for days that don't exist."""
    import datetime

    for pattern, order in ((DAY, (0, 1, 2)), (WRITTEN_DAY, (2, 1, 0))):
        m = pattern.search(text)
        if m:
            y, mo, d = (m.groups()[k] for k in order)
            try:
                return datetime.date(int(y), int(mo) if mo.isdigit() else MONTHS.index(mo.lower()) + 1, int(d))
            except ValueError:
                continue
    return None


def separator(head: str) -> str:
    return ";" if head.count(";") >= head.count(",") else ","


def best(names: list[str]) -> str | None:
    """The member that an archive gives: the highest score, then the first name; without any that counts the first list."""
    lists = [n for n in names if n.lower().endswith(".csv")]
    scored = sorted((-name_score(n), n.lower(), n) for n in lists if name_score(n) > 0)
    return scored[0][2] if scored else lists[0] if lists else None


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(path, origin, member, score, day, body) of the lists under ``path``: an archive gives one, a folder's lists come each."""
    import pyarrow as pa

    types = dict(path=pa.string(), origin=pa.string(), member=pa.string(), score=pa.int32(), day=pa.date32(), body=pa.binary())

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw, origin, member = body.as_py(), at.rsplit("/", 1)[0], at
                if at.lower().endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
                        member = best(archive.namelist())
                        if member is None:
                            continue
                        raw, origin = archive.read(member), at
                day = day_of(origin) or day_of(at) or day_of(member) or day_of(decoded(raw[:20_000]).split("\n", 1)[0])
                row = dict(path=at, origin=origin, member=member, score=name_score(member), day=day, body=raw)
                yield pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in types.items()], names=list(types))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.where(F.lower("path").rlike(r"\.(csv|zip)$")).mapInArrow(open_, FOUND)


def lists(spark: SparkSession, path: str) -> DataFrame:
    """The list of each day: of a folder the best by score, then name; of a day the last by path. Lists without a day fail the read."""
    found = written(candidates(spark, path), "lists")
    undated = found.where("day IS NULL").select("path").first()
    if undated:
        raise ValueError(f"no publication day in {undated.path}")
    counts = F.col("score") > 0
    in_origin = Window.partitionBy("origin").orderBy(F.desc(counts), F.desc(F.when(counts, F.col("score"))), F.lower("member"))
    own = found.withColumn("k", F.row_number().over(in_origin)).where("k = 1")
    return own.withColumn("k", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("origin"), F.desc("path")))).where("k = 1").drop("k")


def list_rows(chosen: DataFrame, columns: dict[str, str] = LIST_COLUMNS) -> DataFrame:
    """(day, path, line, and a column for each of ``columns``) of chosen lists: columns go by the beginning of their header."""
    import pyarrow as pa

    names = ["day", "path", "line", *columns]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for day, path, body in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
                text = decoded(body.as_py())
                reader = csv.reader(io.StringIO(text, newline=""), delimiter=separator(text.split("\n", 1)[0]))
                head, at = [h.strip().lower() for h in next(reader, [])], {}
                for name, start in sorted(columns.items(), key=lambda kv: -len(kv[1])):
                    k = next((i for i, h in enumerate(head) if h.startswith(start) and i not in at.values()), None)
                    if k is not None:
                        at[name] = k
                rows = []
                for n, row in enumerate(reader, 1):
                    if any(x.strip() for x in row):
                        rows.append([n, *(row[at[c]].strip() or None if c in at and at[c] < len(row) else None for c in columns)])
                    if len(rows) == 10_000:
                        yield out(day, path, rows)
                        rows = []
                if rows:
                    yield out(day, path, rows)

    def out(day, path: str, rows: list[list]) -> pa.RecordBatch:
        columns_ = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array([day.as_py()] * len(rows), pa.date32()), pa.array([path] * len(rows)), pa.array(columns_[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns_[1:])], names=names)

    return chosen.select("day", "path", "body").mapInArrow(parse, ", ".join(["day date", "path string", "line long", *(f"{c} string" for c in columns)]))
