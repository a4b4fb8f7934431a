"""The corpus pipeline: documents through five operators, each on all that the one before kept.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir)
and returns a DataFrame. All but the last return the columns of ``documents``.
``run`` applies them to the table ``documents``; between stages rows are written
to the shared scratch folder and read again, so a stage starts from a table.

Nulls, repeated rows, extra columns and empty tables are treated as each
operator's module says. Texts that line dedup empties leave the corpus, as all
they held stands elsewhere; a text that was empty before has failed the quality
rules already.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.llm.common import boxed, stored, unboxed
from brightloom.llm.linededup import dedup_lines
from brightloom.llm.neardup import deduplicated
from brightloom.llm.packing import pack_documents
from brightloom.llm.quality import quality
from brightloom.llm.secrets import redact


def _with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now, where the table has that column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged."""
    return unboxed(quality(boxed(docs, "text")).where("kept"), docs.columns, "text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs of 50 words or more are cut out of the texts."""
    cut = dedup_lines(boxed(docs, "doc_id", "text"), min_words=50)
    kept = cut.where("not (n_deleted > 0 and n_deleted = n_lines)")
    return _with_length(unboxed(kept, docs.columns, "doc_id", "text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: shingles of five words, similarity of 0.8."""
    return deduplicated(docs, size=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return _with_length(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token pieces placed in sequences of 2048."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Neither MinHash nor the packing can be put in SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
