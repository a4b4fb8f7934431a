"""Hashes, mixing, signals, sources, the model and streaming."""

import numpy as np
import pytest

from brightloom.core import canonical as c
from brightloom.core.errors import AudioError, SchemaError, StreamingError, ValidationError
from brightloom.model.net import JointModel
from brightloom.operators import corpus, scoring
from brightloom.signal import kernels as k
from brightloom.streaming.session import StreamSession


def test_canonical_json():
    assert c.canonical_dumps({"b": [1, 1.0, "ß"], "a": None}) == '{"a":null,"b":[1,1.0,"ß"]}'
    assert c.stable_hash(1) != c.stable_hash(1.0)
    for bad in ('{"a":1,"a":2}', b"\xff", "NaN"):
        with pytest.raises(SchemaError):
            c.canonical_loads(bad)
    with pytest.raises(ValidationError):
        c.canonical_dumps(float("inf"))
    assert 0 <= c.derive_seed("split", 7, "3") < 2**32


def test_quotas():
    assert list(corpus.mixing_quotas({"a": 1, "b": 1, "c": 1}, 5).values()) == [2, 2, 1]
    assert list(corpus.mixing_quotas({"a": 3, "b": 1}, 8).values()) == [6, 2]
    assert list(corpus.mixing_quotas({"a": 1, "b": 2, "c": 3}, 7).values()) == [1, 2, 4]
    with pytest.raises(ValidationError):
        corpus.mixing_quotas({"a": 0}, 3)


def test_bootstrap():
    x = scoring.bootstrap_exact([1.0, 0.0, 1.0, 1.0], seed=5, replicates=200)
    assert x["low"] <= x["estimate"] <= x["high"] and x == scoring.bootstrap_exact([1.0, 0.0, 1.0, 1.0], seed=5, replicates=200)


def test_pcm_and_wav():
    x = np.array([0.0, 0.5, -1.0, 2.0, -2.0])
    assert np.frombuffer(k.to_pcm16(x), "<i2").tolist() == [0, 16383, -32767, 32767, -32767]
    rate, back = k.parse_wav(k.build_wav(k.to_pcm16(x), 16000))
    assert rate == 16000 and len(back) == 5
    for bad in (b"", k.build_wav(b"", 16000), k.build_wav(k.to_pcm16(x), 16000)[:-1], k.build_wav(k.to_pcm16(x), 10)):
        with pytest.raises(AudioError):
            k.parse_wav(bad)


def test_log_mel_peaks_at_the_tone():
    mel = k.log_mel(k.tone(440.0, 1200, 16000), n_mels=24)
    centers = k.mel_to_hz(np.linspace(k.hz_to_mel(20.0), k.hz_to_mel(7600.0), 26))[1:-1]
    assert mel.shape == (k.frame_count(1200, 400, 160), 24)
    assert abs(centers[int(mel.mean(axis=0).argmax())] - 440) < 120


@pytest.mark.parametrize("kind", ["tcn", "gru"])
def test_streaming_equals_offline(kind):
    model = JointModel({"kind": kind, "n_mels": 16, "hidden": 8, "layers": 2, "intents": ["a", "b"], "tags": ["O", "B-x", "I-x"]}, seed=3)
    audio = k.chirp(200, 3000, 13120, 16000, 0.5)
    mel = k.log_mel(audio, n_mels=16)
    results = []
    for chunk in (160, 37, 4000):
        s = StreamSession(model)
        for i in range(0, len(audio), chunk):
            s.push(audio[i : i + chunk])
        results.append(s.finalize())
        with pytest.raises(StreamingError):
            s.push(audio[:10])
    assert all(r["tags"] == model.predict(mel)[1] and r["intent"] == model.predict(mel)[0] for r in results)
    assert len(results[0]["tags"]) == 80 and results[0]["first_frame_ms"] in (350, 360)


def test_causal_and_learning():
    model = JointModel({"kind": "tcn", "n_mels": 6, "hidden": 12, "layers": 2, "intents": ["a", "b"], "tags": ["O", "B-x"]}, seed=1)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 6))
    y = x.copy()
    y[12:] += 5
    assert np.allclose(model.encode(x)[0][:12], model.encode(y)[0][:12])
    data = [(rng.normal(size=(15, 6)) + (2 if i % 2 else -2), i % 2, np.full(15, i % 2)) for i in range(20)]
    losses = model.fit_heads(data)
    assert losses[-1] < losses[0] / 2


def test_mix_and_splits(spark):
    d = spark.createDataFrame([("a" if i % 3 else "b", f"s{i:03d}") for i in range(60)], "source string, sample_id string")
    one = corpus.mix_samples(d, {"a": 2.0, "b": 1.0}, 12, 9).orderBy("position").collect()
    two = corpus.mix_samples(d.orderBy("source"), {"a": 2.0, "b": 1.0}, 12, 9).orderBy("position").collect()
    assert one == two and [r["position"] for r in one] == list(range(12)) and sum(r["source"] == "a" for r in one) == 8
    with pytest.raises(ValidationError):
        corpus.mix_samples(d, {"a": 1.0}, 3, 9)


def test_files(spark, tmp_path):
    from pyspark.sql import types as T

    from brightloom.sources import files

    rows = spark.createDataFrame([(1, "ä", 1e-5), (2, None, 2.0)], "id int, name string, v double")
    files.write_jsonl(rows, f"{tmp_path}/j")
    lines = sorted(r[0] for r in spark.read.text(f"{tmp_path}/j").collect())
    assert lines == ['{"id":1,"name":"ä","v":1e-05}', '{"id":2,"name":null,"v":2.0}']
    schema = T._parse_datatype_string("id int, name string, v double")
    assert files.read_jsonl(spark, f"{tmp_path}/j", schema).where("_error is null").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"id":1,"id":2,"name":"x","v":1.0}\n[1]\n\n{"id":1}\n')
    assert files.read_jsonl(spark, f"{tmp_path}/bad.jsonl", schema).where("_error is null").count() == 0
    files.save_table(rows, f"{tmp_path}/t", {"kind": "test"})
    back, envelope = files.load_table(spark, f"{tmp_path}/t")
    assert back.count() == 2 and envelope == {"kind": "test"}
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.wav").write_bytes(k.build_wav(k.to_pcm16(np.zeros(10)), 8000))
    (tmp_path / "w/b.wav").write_bytes(b"no")
    got = {r["path"][-5:]: r["audio"] for r in files.read_wav_folder(spark, f"{tmp_path}/w").collect()}
    assert got["a.wav"]["sample_rate"] == 8000 and got["b.wav"]["error"]


def test_near_duplicate_pairs_are_exact(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 8))
    v = np.concatenate([base, base + rng.normal(scale=0.2, size=base.shape), rng.normal(size=(20, 8)), np.zeros((1, 8))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, vector array<double>")
    n = np.linalg.norm(v, axis=1)
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if n[i] * n[j] > 0 and v[i] @ v[j] / (n[i] * n[j]) >= 0.9}
    assert {(r["a"], r["b"]) for r in corpus.near_duplicate_pairs(df, 0.9).collect()} == want


@pytest.mark.parametrize("kind", ["tcn", "gru"])
def test_sessions_go_on_from_snapshots(kind):
    from brightloom.core.canonical import canonical_dumps, canonical_loads

    model = JointModel({"kind": kind, "n_mels": 16, "hidden": 8, "layers": 2, "intents": ["a", "b"], "tags": ["O", "B-x", "I-x"]}, seed=3)
    audio = k.chirp(200, 3000, 13120, 16000, 0.5)
    whole, parts = StreamSession(model), StreamSession(model)
    for i in range(0, len(audio), 1000):
        whole.push(audio[i : i + 1000])
        parts.push(audio[i : i + 1000])
        parts = StreamSession.restore(canonical_loads(canonical_dumps(parts.snapshot())), model)
    assert parts.finalize() == whole.finalize()
    good = whole.snapshot()
    for change in ({"model_hash": "x"}, {"frames": 3}, {"revisions": -1}, {"pending": [0.0] * 9}, {"intent": "c"}, {"more": 1}, {"schema_version": True}):
        with pytest.raises(SchemaError):
            StreamSession.restore(good | change, model)


def test_buffer():
    from brightloom.streaming.session import AudioBuffer

    b = AudioBuffer(5)
    b.append([1, 2, 3])
    assert b.pending == 3 and b.peek().tolist() == [1, 2, 3] and b.consume(2).tolist() == [1, 2] and b.pending == 1
    for wrong in (lambda: b.append([0] * 5), lambda: b.consume(2), lambda: b.append([float("nan")])):
        with pytest.raises(StreamingError):
            wrong()
    b.clear()
    assert b.pending == 0


def test_sessions_as_a_streaming_operator(spark, tmp_path):
    """Chunks over several micro-batches give the offline tags; a gap ends a session with an error."""
    from brightloom.streaming.session import stream_sessions

    model = JointModel({"kind": "tcn", "n_mels": 8, "hidden": 6, "layers": 1, "intents": ["a", "b"], "tags": ["O", "B-x"]}, seed=2)
    audio = {f"s{n}": k.chirp(150 + 90 * n, 2500, 6000, 16000, 0.5) for n in range(3)}
    schema = "session_id string, seq bigint, samples array<double>, last boolean"
    for part in range(3):
        rows = [(s, q, x[q * 1000 : q * 1000 + 1000].tolist(), q == 5) for s, x in audio.items() for q in (2 * part, 2 * part + 1)]
        if part == 1:
            rows.append(("gap", 3, [0.0], False))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stream_sessions(source, model)
    query = out.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
    assert query.awaitTermination(180)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    for s, x in audio.items():
        mine = sorted((r for r in got if r["session_id"] == s), key=lambda r: r["seq"])
        intent, tags = model.predict(k.log_mel(x, n_mels=8))
        assert [t for r in mine for t in r["tags"]] == tags and mine[-1]["intent"] == intent and mine[-1]["finished"] and mine[-1]["error"] is None
    assert [r["error"] for r in got if r["session_id"] == "gap"] == ["chunk 0 is missing"]
