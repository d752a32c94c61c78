"""The corpus pipeline: quality rules, near-duplicate removal, mixing to target weights, best-fit packing.

Every stage takes (spark, docs, sf_dir) and all rows that the stage before it kept; all
but the last return the columns of ``documents``. Quality rules reject whole documents;
of each component of near duplicates the smallest id stays; the mix repeats a document
as often as it is taken, so an id may come several times after it; packing lays every
piece of every copy into sequences.

What an input holds is treated alike by all stages. A row without an id is a document
like others: it is judged by its own text, never linked as a copy, mixed, and packed with a null
id. A null or empty text has no words, so quality rules reject it. Texts of any length are
read whole. Repeated rows of an id and text are judged alike, and one of them stays
after near-dedup; ties of the mix go by a hash of the row. An empty table passes
through all stages, and columns besides those of ``documents`` are dropped by the first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from offerloom.llm.common import STAGED, delete, shared_dir, sweep, table
from offerloom.llm.mixing import mixed_documents
from offerloom.llm.near_dedup import deduplicated
from offerloom.llm.packing import pack_documents
from offerloom.llm.quality import accepted
from offerloom.llm.queries import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that base rules and forest keep, each by its own verdict; without labels of both kinds the base rules decide."""
    return accepted(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, the smallest id; documents without words or id are linked with nothing."""
    return deduplicated(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as its source's target asks for, at most three times; a null source is one source, the last."""
    return mixed_documents(docs.select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row and their places; an empty text is its end id alone."""
    return pack_documents(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Isolation forests, seeded hashing and tokenizers are beyond SQL; a test compares the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again.

    Once a stage is written, what it was made of is deleted.
    """
    docs, at = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        before = len(STAGED)
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        sweep(spark, before)
        if k:
            delete(spark, f"{at}/{k - 1}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
