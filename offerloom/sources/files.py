"""Readers and writers: JSON lines and arrays, delimited lists with dated headers, HTML cards, payloads in attributes, exports."""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .arrays import json_array

PRODUCT_SCHEMA = "id string, product_name string, brand string, ecommerce_id string, final_price double, pub_slug string"


def json_lines(spark: SparkSession, path: str, schema: str = PRODUCT_SCHEMA, required: tuple[str, ...] = ("product_name", "ecommerce_id")) -> DataFrame:
    """JSON lines; a malformed line fails the read, blank lines and rows without a required value go."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    for c in required:
        rows = rows.where(F.length(F.trim(c)) > 0)
    return rows


def lookup(spark: SparkSession, path: str) -> DataFrame:
    """id and name of a JSON array of shops."""
    return json_array(spark, path, "id string, name string")


#: The beginnings of the columns of a price list, in lower case.
LIST_COLUMNS = {
    "ingredient": "principio attivo", "pack_reference": "confezione di riferimento", "atc": "atc", "aic": "aic", "medicine": "farmaco", "pack": "confezione",
    "company": "ditta", "reference_price": "prezzo riferimento", "public_price": "prezzo pubblico", "difference": "differenza", "note": "nota", "group_code": "codice gruppo",
}


def delimited(spark: SparkSession, path: str, columns: dict[str, str] = LIST_COLUMNS, encoding: str = "iso-8859-1") -> DataFrame:
    """A list whose delimiter is sniffed from its first line and whose columns go by the beginning of their header.

    Windows-1252 files are read as ISO 8859-1, which the engine has, and the euro sign is put back.
    """
    first = spark.read.option("encoding", encoding).csv(path, sep="\u0001", header=False).first()
    head = (first[0] if first else "") or ""
    sep = ";" if head.count(";") >= head.count(",") else ","
    raw = spark.read.csv(path, sep=sep, header=True, encoding=encoding)
    found = {}
    for name, start in sorted(columns.items(), key=lambda kv: -len(kv[1])):
        match = next((c for c in raw.columns if c.strip().lower().startswith(start) and c not in found.values()), None)
        if match:
            found[name] = match
    return raw.select(*(F.trim(F.translate(F.col(f"`{found[c]}`"), "\x80", "€")).alias(c) if c in found else F.lit(None).cast("string").alias(c) for c in columns))


def page_plan(plan: Column) -> Column:
    """Pages of "a-b" or "a,b,...": sorted, each once."""
    ends = F.split(plan, "-")
    span = F.sequence(ends[0].try_cast("int"), F.get(ends, F.lit(1)).try_cast("int"))
    listed = F.filter(F.transform(F.split(plan, ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull() & (x > 0))
    return F.array_sort(F.array_distinct(F.when(plan.rlike(r"^\d+-\d+$"), span).otherwise(listed)))


def link_cards(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, label) of the list cards of a page; the first of equal targets stays."""
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit('<li><a href="([^"]*)">'), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit('<li><a href="[^"]*">([^<]*)<'), F.lit(1)).alias("label"))
    cards = pages.select("page_id", F.posexplode(pairs).alias("pos", "c")).select("page_id", "pos", "c.href", "c.label")
    first = cards.groupBy("page_id", "href").agg(F.min(F.struct("pos", "label")).alias("f"))
    return first.select("page_id", "f.pos", "href", "f.label")


def balanced(text: str | None, marker: str) -> str | None:
    """The JSON object that follows a marker in a text, by counting braces outside strings."""
    at = (text or "").find(marker)
    if at < 0:
        return None
    rest = text[at + len(marker) :].lstrip()
    if not rest.startswith("{"):
        return None
    depth = 0
    for token in re.finditer(r'"(?:\\.|[^"\\])*"|[{}]', rest):
        depth += {"{": 1, "}": -1}.get(token[0], 0)
        if depth == 0:
            payload = html.unescape(rest[: token.end()])
            try:
                json.loads(payload)
            except ValueError:
                return None
            return payload
    return None


def payload(text: Column, marker: str) -> Column:
    @F.pandas_udf(T.StringType())
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda x: balanced(x, marker))

    return cut(text)


def jsonp(text: Column) -> Column:
    """The body of callback(...)."""
    return F.nullif(F.regexp_extract(text, r"(?s)^\s*[\w$.]+\((.*)\)\s*;?\s*$", 1), F.lit(""))


def basket_text(lines: DataFrame) -> DataFrame:
    """A plain text per basket: a line a product, then the total. lines: (basket_id, query_index, name, quantity, line)."""
    money = lambda c: F.format_string("%.2f", c / 100.0)
    row = F.concat_ws(" ", F.col("quantity").cast("string"), F.lit("x"), "name", money(F.col("line")))
    rows = F.array_sort(F.collect_list(F.struct("query_index", row.alias("row"))))
    out = lines.groupBy("basket_id").agg(rows.alias("rows"), F.sum("line").alias("total"))
    return out.select("basket_id", F.concat_ws("\n", F.array_join(F.transform("rows", lambda x: x["row"]), "\n"), F.concat(F.lit("Totale "), money(F.col("total")))).alias("text"))


def dump(df: DataFrame, path: str, key: str, parts: int = 8) -> DataFrame:
    """The whole table as JSON lines in files of key ranges, ordered by key from file to file; what reads it back."""
    df.repartitionByRange(parts, key).sortWithinPartitions(key).write.json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def json_sink(df: DataFrame, path: str, add: bool = False) -> DataFrame:
    """Rows as compressed JSON lines, added to those at ``path`` or alone there; what reads them back."""
    df.write.mode("append" if add else "errorifexists").option("compression", "gzip").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def report(sections: dict[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """A report of several relations, each as JSON lines in a folder of its name; what reads them back."""
    return {name: json_sink(df, f"{path}/{name}") for name, df in sections.items()}


def markdown_report(labels: DataFrame, title: str, actions: list[str], most: int = 40) -> DataFrame:
    """A report as one text: how many labels each action has, then a table per action of its largest. labels: (title, n, action).

    Only ``most`` rows of each action reach the text, so one row holds it.
    """
    place = F.row_number().over(Window.partitionBy("action").orderBy(F.desc("n"), "title"))
    top = labels.withColumn("k", place).where(F.col("k") <= most)
    row = F.concat(F.lit("\n| "), F.col("k").cast("string"), F.lit(" | "), F.replace("title", F.lit("|"), F.lit("\\|")), F.lit(" | "), F.col("n").cast("string"), F.lit(" |"))
    rows = top.groupBy("action").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", row.alias("row")))), lambda x: x["row"]), "").alias("rows"))
    counts = labels.groupBy("action").agg(F.count(F.lit(1)).alias("c"))
    of = lambda column, a: F.max(F.when(F.col("action") == a, F.col(column)))
    both = counts.join(rows, "action").agg(*(of("c", a).alias(f"c{i}") for i, a in enumerate(actions)), *(of("rows", a).alias(f"r{i}") for i, a in enumerate(actions)))
    head = F.array_join(F.array(*(F.concat(F.lit(f"{a} **"), F.coalesce(f"c{i}", F.lit(0)).cast("string"), F.lit("**")) for i, a in enumerate(actions))), " · ")
    parts = [F.coalesce(F.concat(F.lit(f"\n\n## {a}\n\n| # | title | n |\n|---|---|---:|"), f"r{i}"), F.lit("")) for i, a in enumerate(actions)]
    return both.select(F.concat(F.lit(f"# {title}\n\n"), head, *parts).alias("text"))
