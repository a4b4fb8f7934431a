"""Configuration records, schema rules and task domains."""

import json

import pytest

from brightloom.config import records as c
from brightloom.core.errors import AdapterError, ConfigError, SchemaError, ValidationError
from brightloom.operators import domains as d
from brightloom.serve import protocol as p


def test_round_trip_of_every_kind():
    assert c.registered_kinds() == ["feature", "generation", "stream", "train"]
    for kind in c.registered_kinds():
        config = c.Config(kind)
        text = c.config_to_json(config)
        again = c.config_from_json(text)
        assert dict(again) == dict(config) and c.config_to_json(again) == text
        with pytest.raises(ConfigError):
            config.seed = 1
    assert c.Config("feature").samples("frame_ms") == 400 and c.Config("stream").samples("chunk_ms") == 2560


@pytest.mark.parametrize(
    "kind, values",
    [
        ("feature", {"n_fft": 500}), ("feature", {"hop_ms": 30}), ("feature", {"fmax": 9000.0}), ("feature", {"n_mels": True}), ("feature", {"window": "kaiser"}),
        ("generation", {"counts": {"train": 0}}), ("generation", {"counts": {"other": 1}}), ("generation", {"noise_snr_db": []}), ("generation", {"noise_snr_db": [float("nan")]}),
        ("stream", {"lookahead_ms": 4000}), ("stream", {"stability_threshold": 0}), ("stream", {"chunk_ms": 900}), ("train", {"intent_loss_weight": 0.0, "slot_loss_weight": 0.0}),
        ("train", {"epochs": 1.0}), ("train", {"colour": 1}), ("none", {}),
    ],
)
def test_bad_values(kind, values):
    with pytest.raises(ConfigError):
        c.Config(kind, **values)


def test_payloads_are_strict():
    good = c.config_to_dict(c.Config("stream"))
    for change in ({"schema_version": True}, {"schema_version": 2}, {"kind": "train"}, {"more": 1}):
        with pytest.raises(ConfigError):
            c.config_from_dict(good | change)
    with pytest.raises(ConfigError):
        c.config_from_dict({k: v for k, v in good.items() if k != "chunk_ms"})
    with pytest.raises(ConfigError):
        c.register_config("train", {})


def test_rules_of_schemas():
    good = {"schema": "brightloom.request", "schema_version": 1, "request_id": "a", "samples": [0.5], "sample_rate": 16000}
    assert list(p.problems(good, p.REQUEST)) == []
    for change, place in (({"schema_version": True}, "$.schema_version"), ({"schema_version": 1.0}, "$.schema_version"), ({"samples": [1, "x"]}, "$.samples[1]"), ({"more": 1}, "$")):
        with pytest.raises(AdapterError, match=place.replace("$", r"\$").replace("[", r"\[")):
            p.validate(good | change, p.REQUEST)
    answer = {"schema": "brightloom.response", "schema_version": 1, "request_id": "a", "intent": "x", "posterior": 1, "frame_tags": ["O"], "model_hash": "0" * 64}
    p.validate(answer, p.RESPONSE)
    for change in ({"model_hash": "0" * 64 + "\n"}, {"posterior": 1.01}, {"posterior": False}, {"frame_tags": []}, {"intent": ""}):
        with pytest.raises(AdapterError):
            p.validate(answer | change, p.RESPONSE)
    for schema in ({"type": "text"}, {"oneOf": []}, [], {"properties": {"a": 1}}, {"minimum": "1"}):
        with pytest.raises(AdapterError):
            p.validate(1, schema)
    p.validate({"a": {"b": [None]}}, {"properties": {"a": {"properties": {"b": {"items": {"type": "null"}}}}}})


def test_fixtures(spark, tmp_path):
    def pair(name):
        return {
            "request": {"schema": "brightloom.request", "schema_version": 1, "request_id": name, "samples": [0.0], "sample_rate": 8000},
            "response": {"schema": "brightloom.response", "schema_version": 1, "request_id": name, "intent": "x", "posterior": 0.5, "frame_tags": ["O"], "model_hash": "0" * 64},
        }

    p.save_fixtures(spark, [pair("a"), pair("b")], str(tmp_path / "f"))
    store = p.load_fixtures(spark, str(tmp_path / "f"))
    asked = spark.createDataFrame([("a",), ("z",), ("a",)], "request_id string")
    assert sorted((r["request_id"], r["missing"]) for r in p.replay(asked, store.union(store)).collect()) == [("a", False), ("a", False), ("z", True)]
    with pytest.raises(SchemaError, match="fixture 1"):
        p.fixture_table(spark, [pair("a"), pair("b") | {"response": pair("c")["response"]}])
    with pytest.raises(SchemaError):
        p.fixture_table(spark, [pair("a"), pair("a")])


def test_domains_are_consistent():
    hashes = {name: d.domain_hash(name) for name in d.DOMAINS}
    assert len(set(hashes.values())) == 4
    for name in d.DOMAINS:
        payload = d.domain_payload(name)
        assert d.check_domain(json.loads(json.dumps(payload))) == payload
        for language in d.LANGUAGES:
            assert d.lexicon_problems(name, d.LEXICONS[name, language]) == [] and d.template_problems(name, d.templates_for(name, language)) == []
        with pytest.raises(SchemaError):
            d.check_domain(payload | {"intents": payload["intents"] + payload["intents"][:1]})
        with pytest.raises(SchemaError):
            d.check_domain(payload | {"schema_version": True})
    assert {k: len(v) for k, v in d.TEMPLATES.items()} == {
        ("weather", "zh"): 6, ("music-control", "zh"): 9, ("calendar", "zh"): 6, ("navigation", "zh"): 4, ("weather", "en"): 4, ("music-control", "en"): 7, ("navigation", "en"): 3, ("calendar", "en"): 4,
    }
    assert d.registered(d.LEXICONS) == d.registered(d.TEMPLATES) and d.slot_entries("calendar", "en", "start-time")["two thirty"] == "14:30"
    for wrong in (lambda: d.domain("x"), lambda: d.intent("weather", "x"), lambda: d.slot("weather", "x"), lambda: d.slot_entries("weather", "zh", "song"), lambda: d.templates_for("weather", "fr")):
        with pytest.raises(ValidationError):
            wrong()
    assert d.lexicon_problems("weather", {"city": {"Rome": "罗马"}, "clock": {}, "song": {"a": "b"}, "day": {" today": "今天"}}) != []
    assert len(d.template_problems("weather", [("weather/query-weather/0", "in {day}"), ("weather/none/0", "x"), ("music/play/0", "y"), ("weather/weather-alert/0", "{city} {city}")])) == 4
    with pytest.raises(ValidationError):
        d.register_templates("weather", "zh", [("weather/weather-alert/9", "x")])


def test_values_and_annotations(spark):
    values = [("weather", "city", "北京", True), ("weather", "city", "Rome", False), ("weather", "clock", "24:00", False), ("weather", "clock", "07:30", True), ("weather", "clock", "07:30\n", False),
              ("music-control", "volume-level", "100", True), ("music-control", "volume-level", "101", False), ("music-control", "volume-level", "NaN", False), ("music-control", "song", "", False),
              ("music-control", "song", "x" * 64, True), ("music-control", "song", "x" * 65, False), ("weather", "song", "x", False), ("weather", "city", None, False)]
    df = spark.createDataFrame(values, "domain string, slot string, value string, want boolean")
    assert all(r["value_ok"] == r["want"] for r in d.values_checked(df).collect())
    for domain, slot, value, want in values:
        if value is not None and (domain, slot) != ("weather", "song"):
            typed = float(value) if slot == "volume-level" else value
            assert (d.value_problem(d.slot(domain, slot), typed) is None) == want
    rows = [("query-weather", ["B-city", "O"], None), ("none", [], "unknown-intent"), ("query-weather", ["B-song"], "unknown-slot"), ("query-weather", ["B-city", "B-clock"], "undeclared-slot"), ("query-forecast", ["B-city"], "missing-slot")]
    df = spark.createDataFrame([("weather", *r) for r in rows], "domain string, intent string, tags array<string>, want string")
    assert all(r["problem"] == r["want"] for r in d.annotations_checked(df).collect())
