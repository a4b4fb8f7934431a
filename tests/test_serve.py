"""Schemas, replay, reports and commands."""

import json

import pytest

from brightloom.__main__ import main, parse_counts
from brightloom.core.errors import AdapterError, ConfigError
from brightloom.operators import reports
from brightloom.serve import protocol as p

GOOD = {"schema": "brightloom.request", "schema_version": 1, "request_id": "a", "samples": [0.0, 1], "sample_rate": 16000}


def test_schema_checks():
    p.validate(GOOD, p.REQUEST)
    for change in ({"samples": []}, {"samples": [True]}, {"sample_rate": 1}, {"request_id": ""}, {"more": 1}, {"samples": None}):
        with pytest.raises(AdapterError):
            p.validate(GOOD | change, p.REQUEST)
    with pytest.raises(AdapterError):
        p.validate({k: v for k, v in GOOD.items() if k != "samples"}, p.REQUEST)
    with pytest.raises(AdapterError):
        p.validate(1, {"oneOf": []})


def test_columns(spark):
    df = spark.createDataFrame([("a", json.dumps(GOOD)), ("b", "{"), ("c", None)], "request_id string, body string")
    got = {r["request_id"]: r["problem"] for r in p.with_problems(df, "body", p.REQUEST).collect()}
    assert got["a"] is None and got["b"] and got["c"]
    fixtures = spark.createDataFrame([("a", "yes")], "request_id string, response string")
    assert {r["request_id"]: r["missing"] for r in p.replay(df, fixtures).collect()} == {"a": False, "b": True, "c": True}


def test_report(spark, tmp_path):
    from brightloom.operators import scoring

    rows = spark.createDataFrame([("x|<b>", "x|<b>", ["B-s", "I-s"], ["B-s", "O"], {"k": "v"})], "gold_intent string, pred_intent string, gold_tags array<string>, pred_tags array<string>, slices map<string,string>")
    s = reports.summarise(scoring.scored(rows), "run-1", {"seed": 3}, "slices")
    assert s["slot_strict"]["f1"] == 0 and s["slot_partial"]["credit"] == 0.5 and s["intent"]["accuracy"] == 1.0
    reports.write(s, str(tmp_path))
    assert "x\\|<b>" in (tmp_path / "report.md").read_text() and "<b>" not in (tmp_path / "report.html").read_text()
    with pytest.raises(FileExistsError):
        reports.write(s, str(tmp_path))


def test_commands(capsys):
    assert main(["schema", "--domain", "weather"]) == 0 and "query-forecast" in capsys.readouterr().out
    assert main(["query", "no-such", "x", "y"]) == 2
    assert parse_counts("train=8,dev=2") == {"train": 8, "dev": 2}
    for bad in ("", "train", "train=1,train=2", "other=1"):
        with pytest.raises(ConfigError):
            parse_counts(bad)


def test_run_envelope(spark):
    from brightloom.core.errors import SchemaError
    from brightloom.operators import scoring

    rows = [(i, "a" if i % 3 else "b", "a", ["B-s", "I-s", "O"], ["B-s", "I-s" if i % 2 else "O", "O"], {"k": str(i % 2)}) for i in range(12)]
    df = scoring.scored(spark.createDataFrame(rows, "id int, gold_intent string, pred_intent string, gold_tags array<string>, pred_tags array<string>, slices map<string,string>")).cache()
    run = reports.summarise(df, "run-2", slices="slices", bootstrap={"name": "slot_partial", "key": "id", "seed": 4, "replicates": 200})
    assert reports.check_run(json.loads(json.dumps(run))) == run and run["record_count"] == 12
    assert run["bootstrap"]["low"] <= run["bootstrap"]["estimate"] <= run["bootstrap"]["high"] and "slot_partial" in reports.markdown(run)
    hits = scoring.bootstrap_exact([float(r["intent_ok"]) for r in df.orderBy("id").collect()], seed=4, replicates=200)
    same = scoring.bootstrap_statistic(df, "intent", "id", 4, 200)
    assert (same["low"], same["high"], same["estimate"]) == pytest.approx((hits["low"], hits["high"], hits["estimate"]))
    totals = scoring.matrix_totals(scoring.confusion(df.selectExpr("gold_intent AS gold", "pred_intent AS pred"))).first()
    assert (totals["total"], totals["correct"]) == (12, 8)
    for change in ({"record_count": 3}, {"schema_version": True}, {"run_id": "A"}, {"more": 1}, {"confusion": []}, {"turn": run["turn"] | {"correct": 99}}):
        with pytest.raises(SchemaError if change != {"run_id": "A"} else Exception):
            reports.check_run(run | change)


def test_all_commands_from_data_to_report(spark, tmp_path, capsys):
    """generate, featurize, train, predict, stream-demo, export-instructions, eval, report, serve-mock."""

    def run(*argv):
        assert main([str(a) for a in argv]) == 0, capsys.readouterr().err
        return json.loads(capsys.readouterr().out.strip().split("\n")[-1])

    d, f, m = tmp_path / "d", tmp_path / "f", tmp_path / "m"
    assert run("generate", d, "--counts", "train=24,dev=6,test=6", "--wavs", "--speakers", 3)["counts"] == {"train": 24, "dev": 6, "test": 6}
    assert main(["generate", str(d)]) == 2
    assert run("featurize", d, f, "--mels", 16)["examples"] == 36
    first = run("train", d, f, m, "--epochs", 3, "--hidden", 16)["last"]
    assert first["epoch"] == 2 and first["dev"]["loss"] > 0
    wav = next((d / "audio").glob("test-*.wav"))
    decision, streamed = run("predict", m, wav), run("stream-demo", m, wav, "--chunk-ms", 100)
    assert streamed["result"]["intent"] == decision["intent"] and len(streamed["result"]["tags"]) == len(decision["frame_tags"]) and streamed["steps"][0]["frames"] == 0
    assert run("export-instructions", d, tmp_path / "i")["sample_count"] == 36
    assert run("eval", d, m, tmp_path / "run.json", "--replicates", 50)["intent"]["total"] == 6
    run("report", tmp_path / "run.json", tmp_path / "r")
    assert "Bootstrap CI" in (tmp_path / "r/report.md").read_text() and main(["eval", str(tmp_path), str(m), str(tmp_path / "x")]) == 2
    from brightloom.serve.adapters import write_fixtures

    request = {"schema": "brightloom.request", "schema_version": 1, "request_id": "wav", "samples": [0.0], "sample_rate": 16000}
    write_fixtures(str(tmp_path / "fx.json"), [{"request": request, "response": decision}])
    assert run("serve-mock", tmp_path / "fx.json", "--once")["served"] == 0
