"""Checkpoints: the spec and history as an envelope, weights as a table of (name, shape, values)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession

from brightloom.core.canonical import stable_hash
from brightloom.core.errors import SchemaError
from brightloom.model.net import JointModel
from brightloom.sources.files import load_table, save_table


def save(spark: SparkSession, model: JointModel, path: str, epoch: int = 0, history: list | None = None, overwrite: bool = False) -> None:
    rows = [(n, list(map(int, w.shape)), w.astype(float).ravel().tolist()) for n, w in sorted(model.weights.items())]
    table = spark.createDataFrame(rows, "name string, shape array<int>, data array<double>")
    save_table(table, path, {"spec": model.spec, "spec_hash": stable_hash(model.spec), "epoch": epoch, "history": history or []}, overwrite=overwrite)


def load(spark: SparkSession, path: str, expected_spec: dict | None = None) -> tuple[JointModel, dict]:
    """The model and its envelope; weights must fit the spec, and the spec the expected one."""
    rows, envelope = load_table(spark, path)
    spec = envelope["spec"]
    if stable_hash(spec) != envelope["spec_hash"] or (expected_spec is not None and spec != expected_spec):
        raise SchemaError("the checkpoint is of another model")
    weights = {r["name"]: np.array(r["data"]).reshape(r["shape"]) for r in rows.collect()}
    fresh = JointModel(spec)
    if {n: w.shape for n, w in weights.items()} != {n: w.shape for n, w in fresh.weights.items()}:
        raise SchemaError("weights don't fit the spec")
    return JointModel(spec, weights), envelope
