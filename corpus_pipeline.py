"""A corpus from raw documents to packed sequences, in stages that each work on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm.common import new_folder, scratch, table
from chronoloom.llm.decontamination import drop_leaks
from chronoloom.llm.exact_dedup import drop_exact
from chronoloom.llm.packing import pack
from chronoloom.llm.near_texts import drop_near
from chronoloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine calls toxic go. A null or empty text has no terms and stays; rows that repeat share their fate; without documents or labels nothing goes."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty) the one with the largest doc_id stays; a null doc_id is the smallest, and of rows that tie or repeat one stays."""
    return drop_exact(docs)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the largest doc_id of each group of near-duplicates (found by fingerprints, and by bands of min-hashes where these differ more; verified by shingles) stays, as in the stage before. Texts without a word, null or empty, are one group."""
    return drop_near(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go. A null or empty text leaks nothing; rows that repeat share their fate; items without words are never leaked."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces in sequences. A null text is its end id alone; a row that repeats is packed as often; a text of any length is cut into pieces."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("simhash near-dedup", simhash), ("benchmark decontamination", decontamination), ("packing", packing)]
#: SQL has no tokenizer, so it can't express the last stage; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what each returns is written and read again. Columns of other names pass through all stages but the last; an empty table gives no rows.

    The stages' tables stay in the shared folder, under one name that starts with pipeline; what a stage held for itself is removed.
    """
    docs, folder = table(spark, sf_dir, "documents"), new_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
