"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meterlens.llm.common import table
from meterlens.llm.language import language_id
from meterlens.llm import chat, licenses, minhash, negatives, phrases
from meterlens.llm.neighbours import nearest
from meterlens.llm.pieces import encode_texts
from meterlens.llm.quality import quality
from meterlens.llm.simhash import near_duplicates
from meterlens.llm.suffixes import cut_repeats, digest
from meterlens.llm.templates import find_leaks
from meterlens.llm.toxicity import toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op1_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, restored of every whole text."""
    return encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op3_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document and benchmark item that it holds."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_merge_dropout": op1_merge_dropout,
    "op2_language_id": op2_language_id,
    "op3_chat_snapshots": op3_chat_snapshots,
    "op4_simhash": op4_simhash,
    "op5_repeated_passages": op5_repeated_passages,
    "op6_license_scan": op6_license_scan,
    "op7_nn_descent": op7_nn_descent,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_template_leaks": op10_template_leaks,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_minhash": op12_minhash,
    "op13_phrases": op13_phrases,
}


def oracles() -> dict[str, str]:
    return {
        "op3_chat_snapshots": chat.ORACLE,
        "op6_license_scan": licenses.oracle(),
        "op11_hard_negatives": negatives.ORACLE,
        "op12_minhash": minhash.ORACLE,
        "op13_phrases": phrases.ORACLE,
    }
