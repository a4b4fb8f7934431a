"""Sources and sinks: strict JSON lines, WAV folders, datasets with an envelope written last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.core import files
from brightloom.core.canonical import exact_keys
from brightloom.core.errors import SchemaError, ValidationError

MAX_WAV_BYTES = 64 * 1024 * 1024


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON objects with just the keys of ``schema``; ``_error`` says what is wrong with a line, null where nothing is."""
    keys = sorted(schema.fieldNames())
    lines = spark.read.text(path).withColumnRenamed("value", "_line")
    found = F.json_object_keys("_line")
    error = (
        F.when(F.trim("_line") == "", F.lit("empty line"))
        .when(found.isNull(), F.lit("not an object"))
        .when(F.size(found) != F.size(F.array_distinct(found)), F.lit("duplicate key"))
        .when(F.array_sort(found) != F.array(*[F.lit(k) for k in keys]), F.lit("unknown or missing keys"))
    )
    return lines.select(F.from_json("_line", schema).alias("r"), error.alias("_error")).select("r.*", "_error")


def write_jsonl(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """One canonical JSON object per line: sorted keys, no spaces, numbers as Python prints them."""

    def run(batches):
        import pyarrow as pa

        from brightloom.core.canonical import canonical_dumps

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([canonical_dumps(r) for r in batch.to_pylist()], pa.string())], ["value"])

    rows.mapInArrow(run, T.StructType().add("value", T.StringType())).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def read_wav_folder(spark: SparkSession, path: str, max_bytes: int = MAX_WAV_BYTES) -> DataFrame:
    """(path, audio): files above ``max_bytes`` aren't loaded, which the file listing decides."""
    from brightloom.signal.columns import wav_columns

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return wav_columns(files.where(F.col("length") <= max_bytes).select("path", "content"))


def write_wavs(rows: DataFrame, folder: str, name: str = "utterance_id", samples: str = "samples", rate: int = 16000) -> DataFrame:
    """One WAV file for each row, written by the executors: (name, path, n_bytes); nothing is written before the result is.

    ``folder`` is a path or URI that pyarrow's file systems reach on every executor.
    """
    from brightloom.core.canonical import validate_id

    schema = T.StructType([rows.schema[name]]).add("path", "string").add("n_bytes", "long")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        from brightloom.signal.kernels import build_wav, to_pcm16

        store, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(base, recursive=True)
        for batch in batches:
            paths, sizes = [], []
            for key, values in zip(batch[name].to_pylist(), batch[samples], strict=True):
                data = build_wav(to_pcm16(np.asarray(values.as_py(), np.float64)), rate)
                paths.append(f"{base}/{validate_id(key)}.wav")
                # A task that runs twice writes the same bytes in the same place.
                with store.open_output_stream(paths[-1]) as out:
                    out.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch[name], pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], [name, "path", "n_bytes"])

    return rows.select(name, samples).mapInArrow(run, schema)


def save_table(rows: DataFrame, path: str, envelope: dict, partition_by: str | None = None, overwrite: bool = False) -> None:
    """Rows as Parquet, then the envelope: a dataset without one is not complete. An old envelope goes before its rows do."""
    spark = rows.sparkSession
    if files.exists(spark, f"{path}/envelope.json"):
        if not overwrite:
            raise ValidationError(f"{path} holds a table already")
        files.delete(spark, f"{path}/envelope.json")
    writer = rows.write.mode("overwrite" if overwrite else "errorifexists")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{path}/rows")
    count = spark.read.parquet(f"{path}/rows").count()
    files.write_json(spark, f"{path}/envelope.json", {"schema": "brightloom-table", "schema_version": 1, "count": count, "content": envelope})


def load_table(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    envelope = exact_keys(files.read_json(spark, f"{path}/envelope.json"), {"schema", "schema_version", "count", "content"}, "envelope")
    if envelope["schema"] != "brightloom-table" or envelope["schema_version"] is True or envelope["schema_version"] != 1:
        raise SchemaError("unknown schema or version")
    rows = spark.read.parquet(f"{path}/rows")
    if rows.count() != envelope["count"]:
        raise SchemaError("the row count doesn't match the envelope")
    return rows, envelope["content"]
