"""Instruction samples from generated utterances, and their export with counts, quality and an ordered content hash."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.core import files
from brightloom.core.canonical import canonical_dumps, exact_keys
from brightloom.core.errors import SchemaError, ValidationError
from brightloom.functions import text as tx
from brightloom.operators import corpus
from brightloom.operators.domains import DOMAINS

KEYS = {"schema", "schema_version", "sample_count", "languages", "domains", "intents", "total_duration_ms", "dataset_hashes", "mixing_weights", "quality", "content_hash"}


def render_samples(examples: DataFrame, domain: str, language: str, dataset_hash: str, rate: int = 16000) -> DataFrame:
    """Examples (utterance_id, intent, slot_values, n_samples) as samples: a system turn, a user turn of audio alone, the answer.

    The words of the utterance are left out on purpose: the task is from speech to structure.
    """
    if domain not in DOMAINS or len(dataset_hash) != 64 or set(dataset_hash) - set("0123456789abcdef"):
        raise ValidationError("needs a known domain and a hash of 64 hex characters")
    sample_id = F.concat(F.lit(f"{domain}-"), F.col("utterance_id"))
    slots = tx.slots_text(F.col("slot_values"), [s["name"] for s in DOMAINS[domain]["slots"]], corpus.NO_SLOTS[language])
    before, between = corpus.ANSWERS[language].split("{intent}")[0], corpus.ANSWERS[language].split("{intent}")[1].split("{slots}")[0]
    answer = F.concat(F.lit(before), F.col("intent"), F.lit(between), slots)
    audio = F.struct(sample_id.alias("manifest_id"), F.lit(dataset_hash).alias("dataset_hash"), (F.col("n_samples") / rate * 1000.0).alias("duration_ms"))
    no_audio = F.lit(None).cast("struct<manifest_id:string,dataset_hash:string,duration_ms:double>")
    turn = lambda role, text, sound: F.struct(F.lit(role).alias("role"), text.alias("text"), sound.alias("audio"))
    turns = F.array(
        turn("system", F.lit(corpus.SYSTEM_TEXT[language].replace("{domain}", domain)), no_audio),
        turn("user", F.lit(None).cast("string"), audio),
        turn("assistant", answer, no_audio),
    )
    return examples.select(
        F.lit("brightloom.instruction").alias("schema"), F.lit(1).alias("schema_version"), sample_id.alias("sample_id"), F.lit(domain).alias("domain"),
        F.lit(language).alias("language"), "intent", turns.alias("turns"), F.array(F.lit("synthetic")).alias("tags"),
    )


def with_quality(samples: DataFrame, snr: DataFrame | None = None, **bounds) -> DataFrame:
    """Samples with quality columns; ``snr`` (manifest_id, snr_db) may know some of them."""
    clips = F.transform(F.filter("turns", lambda t: t["audio"].isNotNull()), lambda t: t["audio"])
    answer = F.element_at("turns", -1)["text"]
    prefix = F.coalesce(*[F.when(F.col("language") == k, F.lit(corpus.answer_prefix(k))) for k in corpus.ANSWERS])
    shortest, longest = (f(F.transform(clips, lambda c: c["duration_ms"])) for f in (F.array_min, F.array_max))
    if snr is None:
        return samples.withColumns(corpus.quality_columns(shortest, None, answer, prefix, longest=longest, **bounds))
    # Each clip is looked up by its own manifest id; the worst of the known ones decides.
    each = samples.select("sample_id", F.explode(F.array_distinct(F.transform(clips, lambda c: c["manifest_id"]))).alias("_m"))
    known = each.join(snr.select(F.col("manifest_id").alias("_k"), "snr_db"), F.col("_m") == F.col("_k"))
    worst = known.groupBy(F.col("sample_id").alias("_s")).agg(F.min("snr_db").alias("_snr"))
    joined = samples.join(worst, F.col("sample_id") == F.col("_s"), "left")
    return joined.withColumns(corpus.quality_columns(shortest, F.col("_snr"), answer, prefix, longest=longest, **bounds)).drop("_s", "_snr")


def _ordered_hash(rows: DataFrame) -> str:
    """SHA-256 of the canonical JSON list of rows by sample id; rows stream through the driver one partition at a time."""
    digest, first = hashlib.sha256(b"["), True
    for r in rows.orderBy("sample_id").toLocalIterator():
        digest.update((b"" if first else b",") + canonical_dumps(r.asDict(True)).encode())
        first = False
    digest.update(b"]")
    return digest.hexdigest()


def export(samples: DataFrame, out: str, mixing_weights: dict[str, float] | None = None, snr: DataFrame | None = None, overwrite: bool = False, **bounds) -> dict:
    """Writes canonical JSON lines, then the manifest, and returns it."""
    from brightloom.sources.files import write_jsonl

    spark = samples.sparkSession
    if files.exists(spark, f"{out}/manifest.json"):
        if not overwrite:
            raise ValidationError(f"{out} holds an export already")
        files.delete(spark, f"{out}/manifest.json")  # rows that change have no manifest
    columns = samples.columns
    if samples.groupBy("sample_id").count().where("count > 1").limit(1).count():
        raise ValidationError("sample ids repeat")
    write_jsonl(samples, f"{out}/instructions", overwrite)
    flags = with_quality(samples, snr, **bounds)
    count = lambda df, c: {r[c]: r["n"] for r in corpus.count_by(df, c).orderBy(c).collect()}
    audio = samples.select(F.explode("turns").alias("t")).where("t.audio is not null").select("t.audio.*")
    total = audio.agg(F.sum("duration_ms").alias("d"), F.array_sort(F.collect_set("dataset_hash")).alias("h")).first()
    passed = flags.agg(F.count_if(F.size("issues") == 0).alias("p"), F.count(F.lit(1)).alias("n")).first()
    manifest = {
        "schema": "brightloom.export", "schema_version": 1, "sample_count": passed["n"], "languages": count(samples, "language"), "domains": count(samples, "domain"),
        "intents": count(samples, "intent"), "total_duration_ms": float(total["d"] or 0.0), "dataset_hashes": list(total["h"]),
        "mixing_weights": dict(sorted(mixing_weights.items())) if mixing_weights else None,
        "quality": {"passed": passed["p"], "failed": passed["n"] - passed["p"], "issues": count(flags.select(F.explode("issues").alias("issue")), "issue")},
        "content_hash": _ordered_hash(samples.select(*columns)),
    }
    files.write_json(spark, f"{out}/manifest.json", manifest)
    return manifest


def load(spark: SparkSession, out: str, schema) -> tuple[DataFrame, dict]:
    """The samples and manifest of an export; a changed or missing row is a SchemaError."""
    from brightloom.sources.files import read_jsonl

    manifest = exact_keys(files.read_json(spark, f"{out}/manifest.json"), KEYS, "manifest")
    if manifest["schema"] != "brightloom.export" or manifest["schema_version"] is True or manifest["schema_version"] != 1:
        raise SchemaError("unknown schema or version")
    rows = read_jsonl(spark, f"{out}/instructions", schema)
    if rows.where("_error is not null").limit(1).count():
        raise SchemaError("an exported row can't be read")
    rows = rows.drop("_error")
    if rows.count() != manifest["sample_count"] or _ordered_hash(rows) != manifest["content_hash"]:
        raise SchemaError("the export has changed since it was written")
    return rows, manifest
