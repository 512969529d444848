"""A training corpus from raw documents: quality rules, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lapcast.llm import leaks, lines, near, packing, rules
from lapcast.llm.common import table
from lapcast.session import scratch, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule."""
    return rules.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are similar to earlier ones; those of which no word is left go."""
    return lines.without_later_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near-duplicates."""
    return near.keep_one(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of benchmark items; those that consist of them mostly go."""
    return leaks.cleaned(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document with its sequence and place."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("near-duplicates", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]
#: No stage but the first can be told in SQL; tests compare the whole run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again; what a stage stored for itself goes with it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch():
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
    return docs
