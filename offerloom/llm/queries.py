"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import shared_dir, table
from . import chat, divergence, mixing, near_dedup, topk
from .alignment import align
from .html_extract import extract
from .language_id import identify
from .lm_scoring import score
from .mixing import mix
from .near_dedup import near_duplicates
from .packing import pack_documents
from .quality import judge
from .sharding import shard_documents
from .token_counts import count_tokens
from .topk import nearest


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op2_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_branch_and_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op4_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotated(table(spark, sf_dir, "conversations"))


def op5_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = zlib.crc32(sf_dir.encode())  # a map of its own for every table
    return shard_documents(table(spark, sf_dir, "documents"), store=f"{shared_dir(spark)}/slot-map-{name}")


def op6_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def op7_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op9_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op11_linear_chain_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op12_postings_cogroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op13_systolic_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_style_tree, op2_best_two_fit, op3_branch_and_bound, op4_perspectives, op5_virtual_slots, op6_context_tree, op7_hyperminhash, op8_token_counts, op9_isolation_forest, op10_water_filling, op11_linear_chain_crf, op12_postings_cogroup, op13_systolic_rotation)}


def oracle_sql() -> dict[str, str]:
    return {"op3_branch_and_bound": topk.ORACLE, "op4_perspectives": chat.ORACLE, "op7_hyperminhash": near_dedup.ORACLE, "op10_water_filling": mixing.ORACLE, "op13_systolic_rotation": divergence.ORACLE}
