"""From raw documents to training tokens, in five stages; each is written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterlens.llm.common import table
from meterlens.llm.pieces import encode_texts
from meterlens.llm.simhash import keep_one
from meterlens.llm.suffixes import with_cut_texts
from meterlens.llm.templates import drop_leaks
from meterlens.llm.toxicity import drop_toxic
from meterlens.session import settle


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_one(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that came earlier."""
    return with_cut_texts(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with ``ids``, ``n_tokens`` and ``restored``."""
    return encode_texts(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("simhash", remove_near_duplicates),
    ("repeats", remove_repeats),
    ("decontamination", remove_benchmark),
    ("pieces", tokenize),
]

#: Most stages cannot be written in SQL; tests hold run() against a plain computation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
