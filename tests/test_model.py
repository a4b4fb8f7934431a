"""Vocabularies, losses, gradients, training, adapters."""

import numpy as np
import pytest

from brightloom.config.records import Config
from brightloom.core.canonical import canonical_dumps
from brightloom.core.errors import AdapterError, ValidationError
from brightloom.model import training as t
from brightloom.model.net import JointModel
from brightloom.serve import adapters as a

FLAT = Config("train", dropout=0.0, batch_size=4, epochs=6, learning_rate=0.02, hidden_size=8)


def some(n, seed=0, mels=5, tags=3):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        y = rng.integers(0, tags, 12)
        out.append(t.Example(rng.normal(size=(12, mels)) * 0.3 + np.eye(tags, mels)[y] * 2 + (i % 2) * 0.8, i % 2, y))
    return out


def spec(kind):
    return {"kind": kind, "n_mels": 5, "hidden": 6, "layers": 2, "intents": ["a", "b"], "tags": ["O", "B-x", "I-x"]}


def test_vocabularies():
    v = t.tag_vocab("weather")
    assert v.names[:3] == ("O", "B-city", "I-city") and len(v) == 9 and v.indices(["O", "I-city"]) == [0, 2] and v.name(1) == "B-city"
    assert t.intent_vocab("calendar").names == ("create-event", "list-events", "cancel-event", "set-reminder")
    for wrong in (lambda: v.index("B-song"), lambda: v.name(9), lambda: v.name(True), lambda: t.Vocab([]), lambda: t.Vocab(["a", "a"])):
        with pytest.raises(ValidationError):
            wrong()
    s = t.model_spec("weather", Config("feature", n_mels=24), Config("train", encoder="gru"))
    assert s["kind"] == "gru" and s["n_mels"] == 24 and JointModel(s).model_hash != JointModel(s | {"n_mels": 8}).model_hash


def test_batches_and_loss():
    items = [t.Example(np.ones((n, 2)), 0, np.zeros(n, int)) for n in (3, 5)]
    b = t.collate(items)
    assert b["mel"].shape == (2, 5, 2) and b["mask"].sum() == 8 and (b["tags"][0, 3:] == t.PAD).all()
    assert [len(x) for x in t.iterate_batches(some(5), 2)] == [2, 2, 1]
    assert t.joint_loss(np.zeros((1, 2)), np.zeros((1, 3, 4)), np.array([0]), np.full((1, 3), t.PAD)) == pytest.approx(np.log(2))
    assert t.joint_loss(np.zeros((1, 2)), np.zeros((1, 3, 4)), np.array([0]), np.zeros((1, 3), int), 0.0, 2.0) == pytest.approx(2 * np.log(4))


@pytest.mark.parametrize("kind", ["tcn", "gru"])
def test_gradients_by_differences(kind):
    model, batch = JointModel(spec(kind), seed=4), some(3, 1)
    _, grads = t.gradients(model, batch, FLAT)
    rng = np.random.default_rng(0)
    for name, w in model.weights.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in w.shape)
            old, e = w[at], 1e-5
            w[at] = old + e
            up, _ = t.gradients(model, batch, FLAT)
            w[at] = old - e
            down, _ = t.gradients(model, batch, FLAT)
            w[at] = old
            assert grads[name][at] == pytest.approx((up - down) / (2 * e), rel=1e-4, abs=1e-7), name


@pytest.mark.parametrize("kind", ["tcn", "gru"])
def test_training_learns_and_repeats(kind):
    runs = []
    for _ in range(2):
        model = JointModel(spec(kind), seed=4)
        history = t.train_model(model, some(96), some(8, 9), FLAT)
        runs.append(model)
    assert history[-1]["train_loss"] < history[0]["train_loss"] / 2 and history[-1]["dev"]["frame_accuracy"] > 0.8
    assert all(np.array_equal(runs[0].weights[n], runs[1].weights[n]) for n in runs[0].weights)


def request(name="r", n=1600):
    return {"schema": "brightloom.request", "schema_version": 1, "request_id": name, "samples": [0.1 * (i % 7) for i in range(n)], "sample_rate": 16000}


def test_inference_over_a_table(spark):
    model = JointModel(spec("tcn"), seed=1)
    feature = Config("feature", n_mels=5)
    rows = [("r", canonical_dumps(request())), ("short", canonical_dumps(request("short", 10))), ("bad", "{"), ("none", None)]
    got = {r["id"]: r for r in a.infer(spark.createDataFrame(rows, "id string, request string"), model, feature).collect()}
    assert got["r"]["response"] == canonical_dumps(a.answer(request(), model, feature)) and got["r"]["error"] is None
    assert all(got[k]["response"] is None and got[k]["error"] for k in ("short", "bad", "none"))


def test_server_and_client(tmp_path):
    model, feature = JointModel(spec("tcn"), seed=1), Config("feature", n_mels=5)
    pair = {"request": request(), "response": a.answer(request(), model, feature)}
    a.write_fixtures(str(tmp_path / "f.json"), [pair])
    slept = []
    with a.MockServer(a.read_fixtures(str(tmp_path / "f.json"))) as server:
        client = a.HttpAdapter(server.url, retries=2, timeout=2.0, sleep=slept.append)
        assert client.infer(request()) == pair["response"] and server.served == 1
        server.fail_next(503, 2)
        assert client.infer(request()) == pair["response"] and len(slept) == 2 and slept[1] == 2 * slept[0]
        server.fail_next(503, 3)
        with pytest.raises(AdapterError, match="503"):
            client.infer(request())
        server.fail_next(400)
        with pytest.raises(AdapterError, match="400"):
            client.infer(request())
        with pytest.raises(AdapterError, match="404"):
            client.infer(request("other"))
        server.delay_next(0.5)
        quick = a.HttpAdapter(server.url, retries=1, timeout=0.2, sleep=slept.append)
        assert quick.infer(request()) == pair["response"]
    with pytest.raises(AdapterError):
        client.infer(request())
    for url in ("http://example.org", "https://127.0.0.1"):
        with pytest.raises(ValidationError):
            a.HttpAdapter(url)
