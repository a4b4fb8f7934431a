"""The queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brightloom.llm.quality import quality

    return quality(_documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("broken_rules", ",").alias("broken_rules"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from brightloom.llm.packing import pack_documents

    return pack_documents(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brightloom.llm.secrets import scan, spans_text

    found = scan(_documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(spans_text(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from brightloom.llm.pieces import digest_documents

    return digest_documents(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brightloom.llm.media import stored_payloads

    return stored_payloads(_documents(spark, sf_dir))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brightloom.llm.neardup import near_duplicates

    return near_duplicates(_documents(spark, sf_dir), size=4).select("doc_id", "n_shingles", "component_id", "kept")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brightloom.llm.sharding import shards_by_labels

    return shards_by_labels(_documents(spark, sf_dir))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brightloom.llm.htmlmain import extract

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brightloom.llm.licenses import scan

    return scan(_documents(spark, sf_dir))


def op3_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brightloom.llm.linededup import dedup_lines

    return dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)} | {"pipeline": pipeline}
