"""Best-fit-decreasing packing of tokenised documents into sequences.

Items of one length are interchangeable, so best-fit decreasing over all
documents needs only how many pieces each length has: at most ``capacity``
counts, whatever the input. The driver runs the algorithm on those counts, with
a segment tree over remaining capacities that finds the tightest open bin class
in logarithmic time. The outcome is a short plan of rows "the n-th to m-th piece
of this length go into those sequences at that offset". Pieces then get their
place among those of their length (counted in buckets, no global sort) and join
the plan. A plan's rows are bounded by the capacity alone, not by the input; one
of at most ``BROADCAST_ROWS`` is broadcast, any other joins by a shuffle.

Defined results: a null or empty text has the end id alone. Documents longer
than ``capacity`` are cut into full pieces, the last may be shorter; no others
are cut. Repeated rows and null ids are packed like any others. An empty table
gives an empty result. Other columns are left behind.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.llm.common import empty, ranked, require, sliced, stored
from brightloom.llm.tokens import merge_ranks

#: Rows of a plan: pieces ``rank`` .. of ``length`` fill ``bins`` sequences from ``bin``, ``each`` per sequence, from ``offset`` on.
PLAN = "p_length int, rank_from long, rank_to long, each int, bin long, offset_from int"
#: Plans of at most so many rows (36 bytes each) are broadcast.
BROADCAST_ROWS = 100_000


class CapacityTree:
    """Open bins by remaining capacity: a segment tree of counts, ``tightest(n)`` in O(log capacity)."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, remaining: int, bins: int) -> None:
        at = self.size + remaining
        while at:
            self.count[at] += bins
            at //= 2

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity of at least ``need`` that an open bin has."""
        at = self.size + need
        if self.count[at]:
            return need
        while at > 1 and (at % 2 or not self.count[at + 1]):
            at //= 2
        if at <= 1:
            return None
        at += 1
        while at < self.size:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.size


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over ``counts`` (length -> pieces): plan rows and the number of sequences."""
    tree, open_bins, rows, bins = CapacityTree(capacity), {}, [], 0

    def keep(remaining: int, first: int, n: int) -> None:
        if remaining and n:
            open_bins.setdefault(remaining, []).append((first, n))
            tree.add(remaining, n)

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_bins[room].pop()
                tree.add(room, -n)
            each = room // length
            full = min(n, left // each)
            for some, per in ((full, each), (1 if full < n and left % each and left < n * each else 0, left % each)):
                if some:
                    rows.append((length, rank, rank + some * per, per, first, capacity - room))
                    keep(room - per * length, first, some)
                    first, n, left, rank = first + some, n - some, left - some * per, rank + some * per
            keep(room, first, n)
    return rows, bins


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32 and, if asked, ids."""
    require(docs, "doc_id", "text")
    end, unmade = end_id.to_bytes(4, "little"), merge_ranks(tokenizer)

    def cut(batches: Iterable) -> Iterator:
        import pyarrow as pa

        from brightloom.llm.tokens import word_ids

        vocab = word_ids(tokenizer, unmade)
        for batch in sliced(batches, "text"):
            cols: list[list] = [[] for _ in range(5 + with_ids)]
            encoded = vocab.texts(t.as_py() or "" for t in batch["text"])
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoded, strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row = (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))
                    for c, v in zip(cols, row, strict=False):
                        c.append(v)
                    if with_ids:
                        cols[5].append(memoryview(part).cast("I").tolist())
            kinds = [batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names[: len(cols)])
        vocab.forget()

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)])
    for name, kind in zip(names[1:], ("int", "long", "long", "long", "array<bigint>"), strict=True):
        if name != "ids" or with_ids:
            schema = schema.add(name, T._parse_datatype_string(kind))
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (any table with ``length`` of 1 to ``capacity``) with sequence_id and offset."""
    require(pieces, "length")
    spark = pieces.sparkSession
    table = stored(pieces.withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if bad := [n for n in counts if n is None or not 1 <= n <= capacity]:
        raise ValueError(f"lengths must be 1 to {capacity}: {bad[:5]}")
    rows, _ = plan(counts, capacity)
    placed = ranked(table, ["length"], "_uid", "_rank", sum(counts.values()))
    steps = spark.createDataFrame(rows, PLAN) if rows else empty(spark, PLAN)
    steps = F.broadcast(steps) if len(rows) <= BROADCAST_ROWS else steps
    nth = F.col("_rank") - F.col("rank_from")
    inside = (F.col("length") == F.col("p_length")) & (F.col("_rank") >= F.col("rank_from")) & (F.col("_rank") < F.col("rank_to"))
    return placed.join(steps, inside).select(
        *pieces.columns,
        (F.col("bin") + F.expr("(_rank - rank_from) div each")).alias("sequence_id"),
        (F.col("offset_from") + nth % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Documents tokenised, cut where too long and packed: one row per piece."""
    return pack(token_pieces(docs, tokenizer, capacity, end_id, with_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, length, ids and doc_ids, from pieces packed with their ids."""
    require(packed, "sequence_id", "offset", "ids")
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.flatten("parts.ids").alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"),
        F.col("parts.offset").alias("offsets"),
    )
