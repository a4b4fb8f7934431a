"""Dataset and feature stores."""

import numpy as np
import pytest

from brightloom.config.records import Config
from brightloom.core.errors import SchemaError, ValidationError
from brightloom.operators import domains as d
from brightloom.signal import kernels as k
from brightloom.sources import files, store

CONFIG = {"seed": 1234, "counts": {"train": 6, "dev": 3, "test": 2}, "n_speakers": 3}


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "d")
    rows, origin = store.generate(spark, Config("generation", **CONFIG))
    content = store.save_dataset(rows, origin, path, wavs=True)
    return path, content


def test_dataset_round_trip(spark, dataset):
    path, content = dataset
    rows, again = store.load_dataset(spark, path)
    assert again == content and rows.count() == 11
    s = content["stats"]
    assert s["counts"] == {"train": 6, "dev": 3, "test": 2} and s["token_length"] == {"min": 6, "max": 9, "mean": 7.4545}
    assert s["duration_s"] == {"total": 8.42, "mean": 0.765455} and s["slot_mentions"] == {"city": 9, "day": 6}
    wavs = files.read_wav_folder(spark, f"{path}/audio")
    audio = {r["path"].rsplit("/", 1)[1][:-4]: r["audio"] for r in wavs.collect()}
    for r in rows.collect():
        assert np.array_equal(np.float32(audio[r["utterance_id"]]["samples"]), k.from_pcm16(k.to_pcm16(np.array(r["samples"], float))))
    for wrong in ("other",):
        with pytest.raises(ValidationError):
            store.split_examples(rows, wrong)
    assert store.per_split(rows, "speaker_id").groupBy("value").count().where("count > 1").count() == 0
    with pytest.raises(ValidationError):
        store.save_dataset(rows, content["provenance"], path)


def test_digest_does_not_depend_on_partitions(spark, dataset, monkeypatch):
    rows, content = store.load_dataset(spark, dataset[0])
    want = store.dataset_hash(rows, content["provenance"])
    assert store.dataset_hash(rows.repartition(5), content["provenance"]) == want
    changed = rows.selectExpr("* except (intent)", "'x' AS intent")
    assert store.dataset_hash(changed, content["provenance"]) != want
    assert store.content_digest(rows.select("utterance_id").limit(0), "utterance_id") != store.content_digest(rows.select("utterance_id"), "utterance_id")
    many = spark.range(300).selectExpr("cast(id as string) AS k", "id")
    monkeypatch.setattr(store, "FAN", 3)
    deep = store.content_digest(many, "k")
    assert deep == store.content_digest(many.repartition(7, "id"), "k") != store.content_digest(many.where("id > 0"), "k")


def test_a_changed_dataset_is_refused(spark, tmp_path):
    rows, origin = store.generate(spark, Config("generation", counts={"train": 8}, seed=5), language="en")
    path = str(tmp_path / "d")
    content = store.save_dataset(rows, origin, path)
    other, _ = store.generate(spark, Config("generation", counts={"train": 8}, seed=6), language="en")
    other.write.mode("overwrite").partitionBy("split").parquet(f"{path}/rows")
    with pytest.raises(SchemaError):
        store.load_dataset(spark, path)
    with pytest.raises(ValidationError):
        store.save_dataset(other.limit(1), origin, path, overwrite=True)
    with pytest.raises(SchemaError):
        store.load_dataset(spark, path)  # the envelope went before the rows did
    assert content["stats"]["counts"]["train"] == 8


@pytest.mark.parametrize("language", d.LANGUAGES)
@pytest.mark.parametrize("domain", sorted(d.DOMAINS))
def test_every_domain_generates_valid_annotations(spark, domain, language):
    rows, _ = store.generate(spark, Config("generation", domain=domain, counts={"train": 9, "dev": 2}, seed=3), language=language, policy="pattern")
    from pyspark.sql import functions as F

    checked = d.annotations_checked(rows.select(F.lit(domain).alias("domain"), "intent", "tags", "split", "pattern_id", "slot_values")).collect()
    assert len(checked) == 11 and all(r["problem"] is None for r in checked)
    by = {s: {r["pattern_id"] for r in checked if r["split"] == s} for s in ("train", "dev")}
    assert not by["train"] & by["dev"]
    assert all(v in d.LEXICONS[domain, language][slot] for r in checked for slot, vs in r["slot_values"].items() for v in vs)


def test_features(spark, dataset, tmp_path):
    rows, content = store.load_dataset(spark, dataset[0])
    path, config = str(tmp_path / "f"), Config("feature", n_mels=16)
    store.featurize_dataset(rows, content, config, path)
    ids = [r[0] for r in store.list_features(spark, path).collect()]
    assert ids == sorted(ids) and len(ids) == 11 and store.read_features_envelope(spark, path)["dataset_hash"] == content["dataset_hash"]
    row, example = store.load_features(spark, path, ids[0]).first(), rows.where(rows["utterance_id"] == ids[0]).first()
    mel = k.log_mel(np.array(example["samples"], float), n_mels=16)
    assert np.allclose(np.array(row["mel"]), mel, atol=1e-4)
    centers = np.arange(len(mel)) * 160 + 200
    want = [next((i for i, s in enumerate(example["segment_starts"]) if s <= c < s + 1280), -1) for c in centers]
    assert row["frame_token"] == want
    for wrong in ("none", "../x"):
        with pytest.raises((SchemaError, ValidationError)):
            store.load_features(spark, path, wrong)
    features = spark.read.parquet(f"{path}/rows")
    intents = [i["name"] for i in d.domain("weather")["intents"]]
    tags = ["O"] + [p + s["name"] for s in d.domain("weather")["slots"] for p in ("B-", "I-")]
    encoded = store.encode_split(rows, features, "train", intents, tags).collect()
    assert len(encoded) == 6 and all(len(r["mel"]) == len(r["frame_tags"]) for r in encoded)
    for bad in (lambda: store.encode_split(rows, features.limit(3), "train", intents, tags), lambda: store.encode_split(rows, features, "train", intents[:1], tags)):
        with pytest.raises(SchemaError):
            bad()
