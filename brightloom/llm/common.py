"""What the training-data operators share: scratch tables, stable ranks, word splitting.

Nothing here keeps state on one machine. Intermediate tables go to the folder
that the session names in ``spark.checkpoint.dir``, which the driver and all
executors share, so a lost executor costs only the tasks it was running.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows and bytes of an Arrow batch between the JVM and Python while scratch tables are written.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}
#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


_SCOPES: list[str] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside have a folder of their own, removed at the end: write results before it."""
    _SCOPES.append(uuid.uuid4().hex)
    try:
        yield
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _SCOPES.pop()


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; a temporary folder only where none is named and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="brightloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return "/".join([base.rstrip("/"), f"brightloom-{spark.sparkContext.applicationId}", *_SCOPES])


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches, which lie outside the heap, stay small while a table is written."""
    before = {k: spark.conf.get(k, None) for k in ARROW}
    try:
        for k, v in ARROW.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back: lineage ends there."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


#: Tables of a few numbers a row are broadcast up to so many rows.
BROADCAST_ROWS = 300_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a stored table, marked for broadcast if it has at most ``rows`` rows (counted in its files' footers); else the join shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def discard(*tables: DataFrame | None) -> None:
    """Removes scratch tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def clear_scratch(spark: SparkSession) -> None:
    """Removes this application's scratch tables; call it once all results are written."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def require(df: DataFrame, *names: str) -> None:
    """Raises ValueError for a missing column."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def words(text: Column) -> Column:
    """Words of a text in order; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also inside lambda functions."""
    return F.transform(F.array(value), body)[0]


def spread(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def ranked(df: DataFrame, keys: Sequence[str], order: str, rank: str, rows: int, deal: str | None = None) -> DataFrame:
    """``df`` with ``rank``: 0, 1, ... within ``keys`` (not null), whatever share of the rows a key has.

    Rows of a key are dealt by the hash of ``deal`` or of ``order`` (unique in
    ``df``) over buckets of bounded size. Buckets are counted with partial sums, counts are
    summed up before each bucket, and only single buckets are sorted. ``df`` is
    read twice and must give the same rows each time (a stored table does).
    """
    buckets = max(2 * shuffle_partitions(df.sparkSession), rows // 20_000 + 1)
    dealt = df.withColumn("_bucket", spread(F.col(deal or order), buckets))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), "_start")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order)
    on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)] + [F.col("_bucket") == F.col("_b")]
    return (
        dealt.withColumn("_i", F.row_number().over(inside))
        .join(starts, on, "left")
        .withColumn(rank, (F.col("_start") + F.col("_i") - 1).cast("long"))
        .drop("_bucket", "_b", "_i", "_start", *[f"_k{i}" for i in range(len(keys))])
    )


def sliced(batches: Iterable, column: str, size: int = 8 << 20) -> Iterator:
    """Arrow batches cut so that ``column`` (strings or binary) takes about ``size`` bytes, one row at least."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, stop - at)
            at = stop
        del batch
        pa.default_memory_pool().release_unused()


def boxed(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` as columns and all others in a struct, where their names can't clash with an operator's."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in keep]
    some = "_" * (1 + max(map(len, docs.columns)))  # a struct needs a field
    return docs.select(*keep, F.struct(*rest, F.lit(True).alias(some)).alias("_doc"))


def unboxed(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    """``columns`` in that order: ``keep`` from the operator, the others out of the struct."""
    return df.select(*[F.col(c) if c in keep else F.col(f"_doc.`{c}`").alias(c) for c in columns])


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
