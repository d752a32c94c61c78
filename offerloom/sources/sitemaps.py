"""Sitemaps as a sink: one well-formed file for each chunk of addresses, and the index that names them on commit.

Tasks write their chunks under names of their own. Only when all tasks have ended are those that the job
accepts renamed, and the index written last; what tasks that failed, or ran twice, have left is
deleted. So a reader sees the old index or the whole new one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: The name space and the most addresses of a file.
NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"
MOST = 50_000
HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n'
INDEX = "sitemap-index.xml"


def opened(path: str) -> tuple:
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, str]]


class Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.site, self.overwrite = options["path"].rstrip("/"), options.get("site", "").rstrip("/"), overwrite

    def write(self, rows: Iterator[Row]) -> Written:
        """The chunks of a task, which come one after another, each into a file of its own."""
        store, at = opened(self.path)
        store.create_dir(f"{at}/_parts", recursive=True)
        made: list[tuple[int, str]] = []
        chunk = out = None
        n = 0
        try:
            for row in rows:
                if row.chunk != chunk:
                    if out:
                        out.write(b"</urlset>\n")
                        out.close()
                    chunk, n = row.chunk, 0
                    made.append((chunk, f"{chunk}-{uuid.uuid4().hex}.xml"))
                    out = store.open_output_stream(f"{at}/_parts/{made[-1][1]}")
                    out.write(f'{HEAD}<urlset xmlns="{NAMESPACE}">\n'.encode())
                n += 1
                if n > MOST:
                    raise ValueError(f"chunk {chunk} has more than {MOST} addresses")
                out.write(f"<url><loc>{escape(row.loc)}</loc></url>\n".encode())
            if out:
                out.write(b"</urlset>\n")
        finally:
            if out:
                out.close()
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = opened(self.path)
        files = sorted(f for m in messages if m for f in m.files)
        chunks = [c for c, _ in files]
        if len(set(chunks)) < len(chunks):
            self.abort(messages)
            raise ValueError("a chunk was written by several tasks; deal rows by chunk first")
        for old in self._files(store, at):
            if old.removesuffix(".xml") not in {str(c) for c in chunks}:
                store.delete_file(f"{at}/{old}")
        for chunk, name in files:
            store.move(f"{at}/_parts/{name}", f"{at}/{chunk}.xml")
        with store.open_output_stream(f"{at}/{INDEX}") as out:
            body = "".join(f"<sitemap><loc>{escape(f'{self.site}/sitemap/{c}.xml')}</loc></sitemap>\n" for c in chunks)
            out.write(f'{HEAD}<sitemapindex xmlns="{NAMESPACE}">\n{body}</sitemapindex>\n'.encode())
        self._drop(store, at)

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(*opened(self.path))

    def _files(self, store, at: str) -> list[str]:
        from pyarrow import fs

        return [f.base_name for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.base_name.removesuffix(".xml").isdigit()] if self.overwrite else []

    @staticmethod
    def _drop(store, at: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{at}/_parts").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/_parts")


class Sitemap(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sitemap"

    def schema(self) -> str:
        return "chunk int, loc string"

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def write_sitemap(urls: DataFrame, path: str, site: str = "") -> None:
    """URL sets and their index at ``path``, in place of what was there. urls: (chunk, loc), a chunk of at most ``MOST`` rows."""
    urls.sparkSession.dataSource.register(Sitemap)
    ordered = urls.select(F.col("chunk").cast("int"), "loc").repartition("chunk").sortWithinPartitions("chunk", "loc")
    ordered.write.format("sitemap").option("site", site).mode("overwrite").save(path)


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(chunk, n, listed) of the files at ``path``, parsed as XML: how many addresses each has, and whether the index names it."""
    files = spark.read.text(f"{path}/*.xml", wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]*)\.xml$", 1).alias("name"), F.regexp_replace("value", "^<[?][^>]*>", "").alias("xml"))
    chunks = files.where(F.col("name").rlike(r"^\d+$")).select(F.col("name").cast("int").alias("chunk"), F.call_function("xpath_int", "xml", F.lit("count(/urlset/url/loc)")).alias("n"))
    index = files.where(F.col("name") == INDEX.removesuffix(".xml")).select(F.explode(F.call_function("xpath", "xml", F.lit("/sitemapindex/sitemap/loc/text()"))).alias("loc"))
    named = index.select(F.regexp_extract("loc", r"/(\d+)\.xml$", 1).cast("int").alias("chunk"), F.lit(True).alias("listed"))
    return chunks.join(named, "chunk", "full").select("chunk", "n", F.coalesce("listed", F.lit(False)).alias("listed"))
