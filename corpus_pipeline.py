"""Corpus pipeline: documents through four of the training-data operators.

Each stage takes all its predecessor kept, is written as Parquet and read
again; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.llm import op2_secrets, op4_packing, op5_near_duplicates, op6_language_id
from punctual.llm.common import keep
from punctual.sources.tables import read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of no known language."""
    return op6_language_id.known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return op5_near_duplicates.without_near_duplicates(docs, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in the texts by its kind (``n_chars`` follows)."""
    return op2_secrets.redacted(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all texts into sequences of at most 4096 ids."""
    return op4_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language_id), ("near duplicates", near_duplicates), ("secret scans", secret_scans), ("packing", packing)]

# No SQL expresses the stages' models; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
