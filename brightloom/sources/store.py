"""Stores of generated datasets and of their features: Parquet rows, WAV files, and an envelope with hashes, written last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.config.records import Config, config_from_dict, config_to_dict
from brightloom.core.canonical import exact_keys, stable_hash, validate_id
from brightloom.core.errors import SchemaError, ValidationError
from brightloom.operators.corpus import SPLITS
from brightloom.operators.generate import POLICIES, generated
from brightloom.sources import files

#: Rows that one digest covers at most, on average.
FAN = 1024
#: What a dataset's hash covers of a row; samples follow from these and the configuration.
LABELS = ("utterance_id", "split", "speaker_id", "snr_db", "pattern_id", "intent", "tokens", "tags", "slot_values")


def row_digests(rows: DataFrame, key: str) -> DataFrame:
    """(key, digest): the hash of each row's canonical JSON."""

    def run(batches):
        import pyarrow as pa

        from brightloom.core.canonical import stable_hash

        def plain(value):
            return {k: plain(v) for k, v in value} if isinstance(value, list) and value and isinstance(value[0], tuple) else value

        for batch in batches:
            digests = [stable_hash({k: plain(v) for k, v in r.items()}) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch[key], pa.array(digests, pa.string())], ["key", "digest"])

    return rows.mapInArrow(run, T.StructType().add("key", rows.schema[key].dataType).add("digest", "string"))


def content_digest(rows: DataFrame, key: str) -> str:
    """One hash of all rows, whatever their order and partitions: a tree over prefixes of the hashes of keys.

    Repeated rows count as often as they are there.
    """
    leaves = row_digests(rows, key).select(F.sha2(F.col("key").cast("string"), 256).alias("k"), "digest")
    count = rows.count()
    depth = 0
    while count > FAN * 16**depth:
        depth += 1
    level = leaves.select(F.substring("k", 1, depth).alias("at"), F.concat("k", "digest").alias("leaf"))
    while True:
        level = level.groupBy("at").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("leaf")), ","), 256).alias("digest"))
        if depth == 0:
            break
        step = min(depth, 2)
        depth -= step
        level = level.select(F.substring("at", 1, depth).alias("at"), F.concat("at", "digest").alias("leaf"))
    row = level.first()
    return stable_hash([count, row["digest"] if row else None])


def provenance(config: Config, language: str, policy: str, seed: int) -> dict:
    return {"schema": "brightloom.dataset", "schema_version": 1, "domain_id": config["domain"], "language": language, "policy": policy, "seed": seed, "config": config_to_dict(config)}


def dataset_hash(rows: DataFrame, origin: dict) -> str:
    return stable_hash({"provenance": origin, "examples": content_digest(rows.select(*LABELS), "utterance_id")})


def generate(spark: SparkSession, config: Config | None = None, language: str = "zh", policy: str = "speaker", seed: int | None = None) -> tuple[DataFrame, dict]:
    """The examples of a generation configuration and where they come from."""
    config = config or Config("generation")
    if config.kind != "generation":
        raise ValidationError(f"not a generation configuration: {config.kind}")
    seed = config["seed"] if seed is None else seed
    rows = generated(spark, config["domain"], language, dict(config["counts"]), seed, config["n_speakers"], config["noise_snr_db"], policy)
    return rows, provenance(config, language, policy, seed)


def summarize(rows: DataFrame, rate: int = 16000) -> dict:
    """Counts, speakers, patterns, SNR levels and intents by split, slot mentions, and lengths."""
    by = {r["split"]: r for r in rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("speaker_id")).alias("speakers"), F.sort_array(F.collect_set("pattern_id")).alias("patterns"), F.sort_array(F.collect_set("snr_db")).alias("snrs")
    ).collect()}
    intents: dict = {s: {} for s in SPLITS}
    for r in rows.groupBy("split", "intent").count().orderBy("intent").collect():
        intents[r["split"]][r["intent"]] = r["count"]
    slots = rows.select(F.explode(F.filter("tags", lambda t: F.startswith(t, F.lit("B-")))).alias("t")).groupBy(F.substring("t", 3, 64).alias("slot")).count().orderBy("slot")
    size, seconds = F.size("tokens"), F.col("n_samples") / rate
    all_ = rows.agg(F.min(size).alias("min"), F.max(size).alias("max"), F.avg(size).alias("mean"), F.sum(seconds).alias("total"), F.avg(seconds).alias("each")).first()
    of = lambda name: {s: list(by[s][name]) if s in by else [] for s in SPLITS}
    return {
        "counts": {s: by[s]["n"] if s in by else 0 for s in SPLITS}, "speakers": of("speakers"), "patterns": of("patterns"), "snr_levels": of("snrs"), "by_intent": intents,
        "slot_mentions": {r["slot"]: r["count"] for r in slots.collect()},
        "token_length": {"min": all_["min"] or 0, "max": all_["max"] or 0, "mean": round(all_["mean"] or 0.0, 4)},
        "duration_s": {"total": round(all_["total"] or 0.0, 6), "mean": round(all_["each"] or 0.0, 6)},
    }


def split_examples(rows: DataFrame, split: str) -> DataFrame:
    if split not in SPLITS:
        raise ValidationError(f"split must be one of {SPLITS}: {split!r}")
    return rows.where(F.col("split") == split)


def per_split(rows: DataFrame, column: str) -> DataFrame:
    """(split, value): the distinct values of each split, to see whether any is in two."""
    return rows.select("split", F.col(column).alias("value")).distinct()


def save_dataset(rows: DataFrame, origin: dict, path: str, overwrite: bool = False, wavs: bool = False) -> dict:
    """The examples by split, their WAV files if asked, and the envelope, which is returned."""
    files.save_table(rows, path, {"state": "rows"}, "split", overwrite)
    stored = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
    if wavs:
        files.write_wavs(stored, f"{path}/audio").write.mode("overwrite").parquet(f"{path}/audio-files")
    counts = {s: n for s, n in origin["config"]["counts"].items()}
    found = {r["split"]: r["count"] for r in stored.groupBy("split").count().collect()}
    if {s: n for s, n in counts.items() if n} != found or stored.select("utterance_id").distinct().count() != sum(found.values()):
        raise ValidationError(f"rows by split {found} don't match {counts}, or an id is there twice")
    content = {"provenance": origin, "stats": summarize(stored), "dataset_hash": dataset_hash(stored, origin), "wavs": wavs}
    files.files.write_json(rows.sparkSession, f"{path}/envelope.json", {"schema": "brightloom-table", "schema_version": 1, "count": sum(found.values()), "content": content})
    return content


def load_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The examples and their envelope, if rows and provenance still have the hash that was stored."""
    rows, content = files.load_table(spark, path)
    exact_keys(content, {"provenance", "stats", "dataset_hash", "wavs"}, "dataset envelope")
    origin = exact_keys(content["provenance"], {"schema", "schema_version", "domain_id", "language", "policy", "seed", "config"}, "provenance")
    if config_from_dict(origin["config"]).kind != "generation" or origin["policy"] not in POLICIES or type(origin["seed"]) is not int:
        raise SchemaError("the provenance is not one of a dataset")
    if missing := set(LABELS) - set(rows.columns):
        raise SchemaError(f"missing columns {sorted(missing)}")
    if dataset_hash(rows, origin) != content["dataset_hash"]:
        raise SchemaError("the dataset has changed since it was written")
    return rows, content


# Features


def frame_tokens(starts: Column, n_samples: Column, frame: int, hop: int, token: int = 1280) -> Column:
    """For each frame the token whose sound its center is in, -1 in gaps."""
    from brightloom.functions.arrays import let
    from brightloom.functions.signal import frame_count

    n = frame_count(n_samples, frame, hop)
    center = lambda f: f * hop + frame // 2
    hit = lambda a, c: F.array_max(F.transform(a, lambda s, i: F.when((s <= c) & (c < s + token), i)))
    frames = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))
    return let(starts, lambda a: F.transform(frames, lambda f: F.coalesce(hit(a, center(f)), F.lit(-1)).cast("bigint")))


def featurize(rows: DataFrame, config: Config) -> DataFrame:
    """(utterance_id, split, mel, frame_token) of examples."""
    from brightloom.signal.columns import log_mel_columns

    token = frame_tokens(F.col("segment_starts"), F.col("n_samples"), config.samples("frame_ms"), config.samples("hop_ms"))
    slim = rows.select("utterance_id", "split", "samples", token.alias("frame_token"))
    made = log_mel_columns(
        slim, rate=config["sample_rate"], frame_ms=config["frame_ms"], hop_ms=config["hop_ms"], n_fft=config["n_fft"], n_mels=config["n_mels"], low=config["fmin"], high=config["fmax"], window_name=config["window"]
    )
    return made.select("utterance_id", "split", "mel", "frame_token")


def featurize_dataset(rows: DataFrame, content: dict, config: Config, path: str, overwrite: bool = False) -> None:
    files.save_table(featurize(rows, config), path, {"what": "features", "config": config_to_dict(config), "dataset_hash": content["dataset_hash"]}, "split", overwrite)


def read_features_envelope(spark: SparkSession, path: str) -> dict:
    _, content = files.load_table(spark, path)
    exact_keys(content, {"what", "config", "dataset_hash"}, "features envelope")
    if content["what"] != "features" or config_from_dict(content["config"]).kind != "feature":
        raise SchemaError("not a store of features")
    return content


def list_features(spark: SparkSession, path: str) -> DataFrame:
    """The ids of a store, sorted."""
    rows, _ = files.load_table(spark, path)
    return rows.select("utterance_id").orderBy("utterance_id")


def load_features(spark: SparkSession, path: str, utterance_id: str) -> DataFrame:
    """The one row of an id, with its shapes checked."""
    validate_id(utterance_id)
    config = config_from_dict(read_features_envelope(spark, path)["config"])
    rows, _ = files.load_table(spark, path)
    row = rows.where(F.col("utterance_id") == utterance_id)
    shape = row.select((F.size("mel") == F.size("frame_token")) & F.forall("mel", lambda m: F.size(m) == config["n_mels"])).collect()
    if len(shape) != 1 or not shape[0][0]:
        raise SchemaError(f"no features of {utterance_id!r}, or of another shape")
    return row


def encode_split(rows: DataFrame, features: DataFrame, split: str, intents: list[str], tags: list[str]) -> DataFrame:
    """(utterance_id, mel, intent, frame_tags as numbers): examples of a split with their features.

    A missing counterpart on either side, an unknown label or tag, or another
    number of frames is a SchemaError.
    """
    from brightloom.functions.tags import frame_span_tags

    left, right = split_examples(rows, split), features.where(F.col("split") == split)
    sides = left.select("utterance_id").exceptAll(right.select("utterance_id")).union(right.select("utterance_id").exceptAll(left.select("utterance_id")))
    if not sides.isEmpty():
        raise SchemaError(f"examples and features differ: {sides.first()[0]!r}")
    number = lambda names, c: F.array_position(F.array(*[F.lit(n) for n in names]), c).cast("int") - 1
    both = left.select("utterance_id", F.col("intent").alias("name"), "tags").join(right.select("utterance_id", "mel", "frame_token"), "utterance_id")
    lifted = F.transform(frame_span_tags(F.col("tags"), F.col("frame_token")), lambda t: number(tags, t))
    out = both.select("utterance_id", "mel", number(intents, F.col("name")).alias("intent"), lifted.alias("frame_tags"))
    bad = out.where((F.col("intent") < 0) | F.exists("frame_tags", lambda t: t < 0) | (F.size("mel") != F.size("frame_tags")))
    if not bad.isEmpty():
        raise SchemaError(f"unknown label or frames out of line: {bad.first()['utterance_id']!r}")
    return out
