"""The corpus pipeline: documents to packed training pieces in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written and read again as the next one's ``docs``.  All but the last return
the columns of ``documents``; a stage works on every row that its predecessor
kept.  Nulls, empty texts, repeated rows and further columns have the results
that the operators' modules define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import jaccard, mixing, packing, pii, quality, secrets
from gleaner.llm.tokenizer_files import WORD_TOKENIZER
from gleaner.scratch import materialize
from gleaner.shipping import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass their rules and their host's verdict."""
    ship(spark)
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of Jaccard similarity 0.8 connect."""
    ship(spark)
    return jaccard.kept_documents(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets and personal data replaced by their kinds; ``n_chars`` follows the text."""
    ship(spark)
    clean = pii.redact(secrets.mask(docs), pii.fit(docs))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents at their sources' repetition rates, shuffled."""
    ship(spark)
    return mixing.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in windows of 4,096 ids, with their ids; ``doc_row`` tells copies of a document apart, ``packing.sequences`` joins the pieces of a window."""
    ship(spark)
    return packing.pack(docs, WORD_TOKENIZER, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("pack_windows", pack_windows),
]

#: Near-duplicate groups, boosted trees and tokenisers are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
