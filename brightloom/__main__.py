"""Commands over datasets, features, models and runs. Exit codes follow the error: 0, 2 (input), 3 (adapter), 4 (stream), 1."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from brightloom.core.errors import ConfigError, EngineError


def parse_counts(text: str) -> dict[str, int]:
    """``train=8,dev=2`` as a mapping; each split once, counts not negative."""
    out: dict[str, int] = {}
    for part in text.split(","):
        name, _, n = part.partition("=")
        if name not in ("train", "dev", "test") or name in out or not n.isdecimal():
            raise ConfigError(f"counts look like train=8,dev=2: {text!r}")
        out[name] = int(n)
    return out


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("brightloom").getOrCreate()


def _config(kind: str, args: argparse.Namespace, **more):
    """A configuration from a file, or the defaults with the options that were given."""
    from brightloom.config.records import Config, config_from_json

    if getattr(args, "config", None):
        with open(args.config, "rb") as f:
            found = config_from_json(f.read())
        if found.kind != kind:
            raise ConfigError(f"{args.config} is not of kind {kind}")
        return found
    return Config(kind, **{k: v for k, v in more.items() if v is not None})


def schema(args: argparse.Namespace) -> dict:
    from brightloom.operators.domains import DOMAINS, domain_payload

    return domain_payload(args.domain) if args.domain else {name: domain_payload(name) for name in sorted(DOMAINS)}


def generate(args: argparse.Namespace) -> dict:
    from brightloom.sources import store

    config = _config("generation", args, domain=args.domain, seed=args.seed, counts=parse_counts(args.counts), n_speakers=args.speakers)
    rows, origin = store.generate(_spark(), config, args.language, args.policy)
    content = store.save_dataset(rows, origin, args.out, args.overwrite, args.wavs)
    return {"written": args.out, "dataset_hash": content["dataset_hash"], "counts": content["stats"]["counts"]}


def featurize(args: argparse.Namespace) -> dict:
    from brightloom.sources import store

    rows, content = store.load_dataset(_spark(), args.dataset)
    store.featurize_dataset(rows, content, _config("feature", args, n_mels=args.mels), args.out, args.overwrite)
    return {"written": args.out, "examples": rows.count()}


def train(args: argparse.Namespace) -> dict:
    from brightloom.config.records import config_from_dict
    from brightloom.model import checkpoint, training
    from brightloom.model.net import JointModel
    from brightloom.sources import store

    spark = _spark()
    rows, content = store.load_dataset(spark, args.dataset)
    envelope = store.read_features_envelope(spark, args.features)
    if envelope["dataset_hash"] != content["dataset_hash"]:
        raise ConfigError("the features are of another dataset")
    config = _config("train", args, epochs=args.epochs, encoder=args.encoder, hidden_size=args.hidden)
    feature = config_from_dict(envelope["config"])
    spec = training.model_spec(content["provenance"]["domain_id"], feature, config)
    features, _ = store.files.load_table(spark, args.features)
    splits = {s: training.examples(store.encode_split(rows, features, s, spec["intents"], spec["tags"])) for s in ("train", "dev")}
    model = JointModel(spec, seed=config["seed"])
    history = training.train_model(model, splits["train"], splits["dev"], config)
    checkpoint.save(spark, model, args.out, config["epochs"], history, args.overwrite)
    return {"written": args.out, "last": history[-1]}


def _model(spark, path: str):
    from brightloom.config.records import Config
    from brightloom.model import checkpoint

    model, _ = checkpoint.load(spark, path)
    return model, Config("feature", n_mels=model.spec["n_mels"])


def _wav(path: str) -> tuple[int, list[float]]:
    from brightloom.signal.kernels import parse_wav

    with open(path, "rb") as f:
        rate, samples = parse_wav(f.read())
    return rate, [float(x) for x in samples]


def predict(args: argparse.Namespace) -> dict:
    from brightloom.serve.adapters import answer

    model, feature = _model(_spark(), args.model)
    rate, samples = _wav(args.wav)
    return answer({"schema": "brightloom.request", "schema_version": 1, "request_id": "wav", "samples": samples, "sample_rate": rate}, model, feature)


def stream_demo(args: argparse.Namespace) -> dict:
    import numpy as np

    from brightloom.streaming.session import StreamSession

    model, _ = _model(_spark(), args.model)
    config = _config("stream", args, chunk_ms=args.chunk_ms)
    rate, samples = _wav(args.wav)
    if rate != config["sample_rate"]:
        raise ConfigError(f"the model hears {config['sample_rate']} Hz")
    session = StreamSession(model, rate, lookahead=config.samples("lookahead_ms"), capacity=config.samples("buffer_capacity_ms"), stability=config["stability_threshold"])
    step, steps = config.samples("chunk_ms"), []
    for i in range(0, len(samples), step):
        session.push(np.array(samples[i : i + step]))
        steps.append({"ms": session.pushed / rate * 1000, "frames": session.frames, "intent": session.intent, "stable": bool(session.stable)})
    return {"steps": steps, "result": {k: v.item() if hasattr(v, "item") else v for k, v in session.finalize().items()}}


def export_instructions(args: argparse.Namespace) -> dict:
    from brightloom.operators import instructions
    from brightloom.sources import store

    rows, content = store.load_dataset(_spark(), args.dataset)
    origin = content["provenance"]
    samples = instructions.render_samples(rows, origin["domain_id"], origin["language"], content["dataset_hash"])
    snr = rows.selectExpr(f"concat('{origin['domain_id']}-', utterance_id) AS manifest_id", "snr_db")
    return instructions.export(samples, args.out, None, snr, args.overwrite, **({"min_snr": args.min_snr} if args.min_snr is not None else {}))


def evaluate(args: argparse.Namespace) -> dict:
    """Scores a model on one split and writes the run's envelope."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from brightloom.core import files
    from brightloom.functions import tags as tg
    from brightloom.model.net import JointModel
    from brightloom.operators import reports, scoring
    from brightloom.sources import store

    spark = _spark()
    rows, content = store.load_dataset(spark, args.dataset)
    model, feature = _model(spark, args.model)
    spec, weights = model.spec, model.weights
    features = store.featurize(store.split_examples(rows, args.split), feature)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        own = JointModel(spec, weights)
        for batch in batches:
            found = [own.predict(np.array(m, float)) for m in batch["mel"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["utterance_id"], pa.array([i for i, _ in found], pa.string()), pa.array([t for _, t in found], pa.list_(pa.string()))], ["u", "pred_intent", "frames"])

    predicted = features.select("utterance_id", "mel").mapInArrow(run, T._parse_datatype_string("u string, pred_intent string, frames array<string>"))
    noise = F.concat(F.lit("snr-"), F.col("snr_db").cast("int").cast("string"))
    tokens = features.select(F.col("utterance_id").alias("f"), "frame_token")
    both = rows.join(predicted, F.col("utterance_id") == F.col("u")).join(tokens, F.col("utterance_id") == F.col("f"))
    records = both.select(
        "utterance_id", F.col("intent").alias("gold_intent"), "pred_intent", tg.frame_span_tags(F.col("tags"), F.col("frame_token")).alias("gold_tags"), tg.promoted(F.col("frames")).alias("pred_tags"),
        F.create_map(F.lit("noise"), F.coalesce(noise, F.lit("clean")), F.lit("speaker"), F.concat(F.lit("spk-"), F.col("speaker_id").cast("string"))).alias("slices"),
    )
    scored = scoring.scored(records).cache()
    try:
        bootstrap = {"key": "utterance_id", "seed": args.seed, "replicates": args.replicates} if args.replicates else None
        summary = reports.summarise(scored, args.run_id, {"dataset_hash": content["dataset_hash"], "split": args.split, "model_hash": model.model_hash}, "slices", bootstrap)
    finally:
        scored.unpersist()
    files.write_json(spark, args.out, summary)
    return {"written": args.out, "intent": summary["intent"], "slot_strict": summary["slot_strict"]}


def report(args: argparse.Namespace) -> dict:
    from brightloom.core import files
    from brightloom.operators import reports

    reports.write(reports.check_run(files.read_json(_spark(), args.run_file)), args.out, args.overwrite)
    return {"written": args.out}


def serve_mock(args: argparse.Namespace) -> dict:
    from brightloom.serve.adapters import MockServer, read_fixtures

    server = MockServer(read_fixtures(args.fixtures), args.port)
    print(json.dumps({"url": server.url}), flush=True)
    if not args.once:
        server.serve()
    return {"served": server.served}


def query(args: argparse.Namespace) -> dict:
    from brightloom.plans.queries import queries

    if args.name not in queries():
        raise ConfigError(f"unknown query {args.name!r}")
    queries()[args.name](_spark(), args.tables).write.mode("overwrite" if args.overwrite else "errorifexists").parquet(args.out)
    return {"written": args.out}


def build_parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="brightloom")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable, text: str, *places: str, **options) -> None:
        p = sub.add_parser(name, help=text)
        for place in places:
            p.add_argument(place)
        for option, settings in options.items():
            p.add_argument(f"--{option.replace('_', '-')}", **(settings if isinstance(settings, dict) else {"default": settings}))
        p.set_defaults(run=run)

    flag, whole = {"action": "store_true"}, {"type": int}
    command("schema", schema, "print the task domains", domain={"choices": ["calendar", "music-control", "navigation", "weather"]})
    command(
        "generate", generate, "write a labelled synthetic dataset", "out", domain="weather", language={"default": "zh", "choices": ["zh", "en"]}, counts="train=64,dev=16,test=16", seed={"type": int, "default": 1234},
        speakers=whole, policy={"default": "speaker", "choices": ["speaker", "pattern"]}, wavs=flag, overwrite=flag, config=None,
    )
    command("featurize", featurize, "write the features of a dataset", "dataset", "out", mels=whole, config=None, overwrite=flag)
    command("train", train, "train a model", "dataset", "features", "out", epochs=whole, encoder={"choices": ["tcn", "gru"]}, hidden=whole, config=None, overwrite=flag)
    command("predict", predict, "one WAV file to a decision", "model", "wav")
    command("stream-demo", stream_demo, "one WAV file in chunks", "model", "wav", chunk_ms=whole, config=None)
    command("export-instructions", export_instructions, "a dataset as an instruction corpus", "dataset", "out", min_snr={"type": float}, overwrite=flag)
    command("eval", evaluate, "score a model on one split", "dataset", "model", "out", split="test", run_id="run", seed={"type": int, "default": 0}, replicates={"type": int, "default": 0})
    command("report", report, "a run as Markdown and HTML", "run_file", "out", overwrite=flag)
    command("serve-mock", serve_mock, "serve fixtures on the loopback interface", "fixtures", port={"type": int, "default": 0}, once=flag)
    command("query", query, "run one query over a folder of tables", "name", "tables", "out", overwrite=flag)
    return top


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    try:
        print(json.dumps(args.run(args), ensure_ascii=False))
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        return e.exit_code
    return 0


if __name__ == "__main__":
    sys.exit(main())
