"""Small files wherever Spark can write: read whole, replaced by a rename."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import SparkSession

from brightloom.core.canonical import MAX_ARTIFACT_BYTES, canonical_dumps, canonical_loads
from brightloom.core.errors import SchemaError


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def read_bytes(spark: SparkSession, path: str, most: int = MAX_ARTIFACT_BYTES) -> bytes:
    fs, at = _at(spark, path)
    if not fs.exists(at):
        raise SchemaError(f"{path} is not there")
    if fs.getFileStatus(at).getLen() > most:
        raise SchemaError(f"{path} is larger than {most} bytes")
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside the place, then renames; readers see the old file, none, or the new one whole."""
    fs, at = _at(spark, path)
    _, beside = _at(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    fs.delete(at, False)
    if not fs.rename(beside, at):
        raise OSError(f"cannot put {path} in place")


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    write_text(spark, path, canonical_dumps(value) + "\n")


def read_json(spark: SparkSession, path: str, most: int = MAX_ARTIFACT_BYTES) -> dict:
    value = canonical_loads(read_bytes(spark, path, most))
    if not isinstance(value, dict):
        raise SchemaError(f"{path} must hold one object")
    return value
