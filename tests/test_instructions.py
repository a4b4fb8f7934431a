"""Rendering, export and checkpoints."""

import numpy as np
import pytest

from brightloom.core.canonical import canonical_dumps, stable_hash
from brightloom.core.errors import SchemaError, ValidationError
from brightloom.model import checkpoint
from brightloom.model.net import JointModel
from brightloom.operators import instructions as ins
from brightloom.operators.generate import generated


@pytest.fixture(scope="module")
def samples(spark):
    rows = generated(spark, "weather", "en", {"train": 5, "dev": 3}, seed=1234)
    return ins.render_samples(rows, "weather", "en", "a" * 64).cache()


def test_rendering(samples):
    got = {r["sample_id"]: r for r in samples.collect()}
    assert len(got) == 8
    r = got["weather-train-00000"]
    assert [t["role"] for t in r["turns"]] == ["system", "user", "assistant"] and r["turns"][1]["text"] is None
    assert r["turns"][2]["text"].startswith("Intent: query-weather; Slots: city=")
    assert got["weather-train-00003"]["turns"][2]["text"] == "Intent: weather-alert; Slots: none"


def test_generation_is_reproducible(spark):
    a = generated(spark, "weather", "zh", {"train": 6, "dev": 3, "test": 2}, seed=1234, n_speakers=3)
    b = generated(spark, "weather", "zh", {"train": 6, "dev": 3, "test": 2}, seed=1234, n_speakers=3)
    x, y = (d.orderBy("utterance_id").collect() for d in (a, b))
    assert x == y and len(x) == 11
    assert all(r["n_samples"] == 320 + 1600 * len(r["tokens"]) and len(r["samples"]) == r["n_samples"] for r in x)
    lengths = [len(r["tokens"]) for r in x]
    assert (min(lengths), max(lengths)) == (6, 9) and round(sum(lengths) / 11, 4) == 7.4545
    by = {s: {r["speaker_id"] for r in x if r["split"] == s} for s in ("train", "dev", "test")}
    assert not by["train"] & by["dev"] and not by["train"] & by["test"] and not by["dev"] & by["test"]
    mentions = [t[2:] for r in x for t in r["tags"] if t[0] == "B"]
    assert (mentions.count("city"), mentions.count("day")) == (9, 6)


def test_export(spark, samples, tmp_path):
    out = str(tmp_path / "e")
    snr = spark.createDataFrame([("weather-train-00000", 3.0)], "manifest_id string, snr_db double")
    m = ins.export(samples, out, {"weather": 1.0}, snr, min_snr=10.0)
    assert m["sample_count"] == 8 and m["quality"] == {"passed": 7, "failed": 1, "issues": {"snr-below-minimum": 1}}
    rows = [r.asDict(True) for r in samples.orderBy("sample_id").collect()]
    assert m["content_hash"] == stable_hash(rows)
    back, again = ins.load(spark, out, samples.schema)
    assert again == m and sorted(canonical_dumps(r.asDict(True)) for r in back.collect()) == sorted(map(canonical_dumps, rows))
    with pytest.raises(ValidationError):
        ins.export(samples, out)
    part = next(p for p in (tmp_path / "e/instructions").glob("part-*") if p.stat().st_size)
    part.write_text(part.read_text().replace("city", "citx"))
    for crc in (tmp_path / "e/instructions").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(SchemaError):
        ins.load(spark, out, samples.schema)


def test_checkpoint(spark, tmp_path):
    spec = {"kind": "gru", "n_mels": 4, "hidden": 3, "layers": 1, "intents": ["a", "b"], "tags": ["O"]}
    model = JointModel(spec, seed=9)
    checkpoint.save(spark, model, str(tmp_path / "c"), epoch=2)
    back, envelope = checkpoint.load(spark, str(tmp_path / "c"), spec)
    assert envelope["epoch"] == 2 and all(np.array_equal(back.weights[n], w) for n, w in model.weights.items())
    with pytest.raises(SchemaError):
        checkpoint.load(spark, str(tmp_path / "c"), spec | {"hidden": 5})
