"""Line dedup: repeated line runs by a distributed suffix array over line ids.

Texts are sequences of line ids (128-bit hashes). A suffix is a line and all that
follow it. Prefix doubling names suffixes in their order: level 0 by line id;
from level k to k + 1 the pair of names at a line and 2^k lines on is counted,
and a pair's name is its interval's start plus the count of smaller pairs in it.
Suffixes whose first 2^k lines stand once are dropped, as no run begins there;
names are therefore in the suffix array's order, but leave out the places of
dropped ones. Suffixes of equal name at level k form an LCP interval of at least
2^k lines, and the two names at a run's start and 2^k lines before its end name
runs of any length. Doubling ends at the length of the longest run in question,
or when no repeat is left.

A run counts from ``min_words`` words on. Maximal runs are not listed as such:
for each line the shortest run of ``min_words`` words that begins at it and that
ends at it is looked up, and where its interval has an earlier place, the later
one's lines go. A line is in a maximal repeated run of ``min_words`` words or
more with an earlier copy exactly if one of these runs covers it, so the lines
that go are the same. Order is by id (null last), then row, then line; the first
copy stays. A run may overlap its earlier copy, as in one line repeated often.

Defined results: a null or empty text stays as it is. A text all of whose lines
go becomes empty. Repeated rows are later copies of the first. Other columns
pass unless named n_lines or n_deleted, which are replaced. Ranks, counts and
joins are spread over all tasks; hot lines and runs are aggregated first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from brightloom.llm.common import boxed, discard, require, sliced, small, stored

#: Cuts are broadcast up to so many runs and documents, counted first.
BROADCAST_CUTS = 1_000_000
#: Radix buckets for the order of line ids; ids are hashes, so buckets are even.
RADIX = 4096


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(rid, line, h1, h2, ahead, back): ahead and back are the fewest lines from, and up to, a line with ``min_words`` words, or null."""

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in sliced(batches, "text", 1 << 20):
            cols: list[list] = [[] for _ in range(6)]
            for rid, value in zip(batch["_rid"].to_pylist(), batch["text"], strict=True):
                text = value.as_py()
                lines = text.encode("utf-8", "surrogatepass").split(b"\n") if text else []
                n = len(lines)
                before = np.zeros(n + 1, np.int64)
                np.cumsum([len(x.split()) for x in lines], out=before[1:])
                # The first end with enough words from each start, the last start with enough words to each end.
                end = np.searchsorted(before, before[:-1] + min_words)
                start = np.searchsorted(before, before[1:] - min_words, "right") - 1
                at = np.arange(n)
                digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in lines]), np.int64)
                for c, new in zip(cols, (np.full(n, rid), at, digest[0::2], digest[1::2], np.where(end <= n, end - at, 0), np.where(start >= 0, at + 1 - start, 0)), strict=True):
                    c.append(new)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            flat = [np.concatenate(c) if c else np.empty(0, np.int64) for c in cols]
            arrays = [pa.array(c.astype(k.to_pandas_dtype()), mask=c == 0 if i > 3 else None) for i, (c, k) in enumerate(zip(flat, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["rid", "line", "h1", "h2", "ahead", "back"])

    return docs.select("_rid", "text").mapInArrow(run, "rid bigint, line int, h1 bigint, h2 bigint, ahead int, back int")


def _first_ranks(ids: DataFrame) -> DataFrame:
    """(h1, h2, rank): the place of the first suffix that starts with each line id, ids in order of their hash."""
    radix = F.shiftrightunsigned("h1", 64 - (RADIX - 1).bit_length()).cast("int")
    ids = ids.withColumn("radix", radix)
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = ids.groupBy("radix").agg(F.sum("n").alias("n"))
    # One window over at most RADIX sums.
    starts = sums.select(F.col("radix").alias("r"), before(Window.partitionBy(F.lit(0)).orderBy("radix")).alias("start"))
    inside = ids.withColumn("inner", before(Window.partitionBy("radix").orderBy("h1", "h2")))
    return inside.join(F.broadcast(starts), F.col("radix") == F.col("r")).select("h1", "h2", (F.col("start") + F.col("inner")).alias("rank"))


def _doubled(level: DataFrame, step: int, ranks: int) -> DataFrame:
    """Ranks of runs of 2 * ``step`` lines from those of ``step`` lines: (rid, line, rank), repeated runs only.

    Places within an interval come from counts by ranges of the second rank
    (``RADIX`` of them over ``ranks``), so no task sorts all that follows a common line.
    """
    by_text = Window.partitionBy("rid").orderBy("line")
    # Rows of a text are in order, so a row ``step`` rows on is ``step`` lines on only if no line between was dropped.
    on = F.lead("line", step).over(by_text) == F.col("line") + step
    pairs = level.withColumn("second", F.when(on, F.lead("rank", step).over(by_text))).where("second is not null")
    counted = pairs.groupBy("rank", "second").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counted = stored(counted.withColumn("part", F.expr(f"second div {ranks // RADIX + 1}")), "pairs")
    before = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counted.groupBy("rank", "part").agg(F.sum("n").alias("n")).select(F.col("rank").alias("r0"), F.col("part").alias("p0"), before("rank", "part").alias("start"))
    placed = counted.withColumn("inner", before("rank", "part", "second")).join(starts, (F.col("rank") == F.col("r0")) & (F.col("part") == F.col("p0")))
    named = placed.select(F.col("rank").alias("r"), F.col("second").alias("s"), (F.col("rank") + F.col("start") + F.col("inner")).alias("new"))
    named = small(stored(named, "names"))
    return pairs.join(named, (F.col("rank") == F.col("r")) & (F.col("second") == F.col("s"))).select("rid", "line", F.col("new").alias("rank"))


def repeated_runs(docs: DataFrame, min_words: int) -> DataFrame:
    """Runs with an earlier copy: (rid, start, length), from documents with ``_rid`` and ``_order``."""
    lines = stored(_lines(docs, min_words), "lines")
    ids = stored(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "line-ids")
    ranks = _first_ranks(ids).select(F.col("h1").alias("i1"), F.col("h2").alias("i2"), "rank")
    ranks = small(stored(ranks, "ranks"))
    base = stored(lines.join(ranks, (F.col("h1") == F.col("i1")) & (F.col("h2") == F.col("i2"))).select("rid", "line", "ahead", "back", "rank"), "level")
    discard(lines, ids)
    from_here = base.where("ahead is not null").select("rid", F.col("line").alias("start"), F.col("ahead").alias("length"))
    to_here = base.where("back is not null").select("rid", (F.col("line") - F.col("back") + 1).alias("start"), F.col("back").alias("length"))
    runs = from_here.union(to_here).distinct()
    level, step, named = base.select("rid", "line", "rank"), 1, None
    longest, top = base.agg(F.greatest(F.max("ahead"), F.max("back")), F.max("rank")).first()
    longest = longest or 0
    while step <= longest:
        a = level.select(F.col("rid").alias("ra"), F.col("line").alias("la"), F.col("rank").alias("head"))
        b = level.select(F.col("rid").alias("rb"), F.col("line").alias("lb"), F.col("rank").alias("tail"))
        here = runs.where((F.col("length") >= step) & (F.col("length") < 2 * step))
        here = here.join(a, (F.col("rid") == F.col("ra")) & (F.col("start") == F.col("la")))
        if step == 1:
            here = here.withColumn("tail", F.col("head"))
        else:
            here = here.join(b, (F.col("rid") == F.col("rb")) & (F.col("start") + F.col("length") - step == F.col("lb")))
        here = here.select("rid", "start", "length", "head", "tail")
        named = here if named is None else named.union(here)
        if 2 * step > longest:
            break
        level = stored(_doubled(level, step, top), "level")
        if level.isEmpty():
            break
        step *= 2
    if named is None:
        return runs.where("false")
    order = docs.select(F.col("_rid").alias("d"), "_order")
    named = stored(named.join(order, F.col("rid") == F.col("d")).select("rid", "start", "length", "head", "tail", "_order"), "runs")
    place = F.struct("_order", "rid", "start")
    key = ["length", "head", "tail"]
    first = named.groupBy(*key).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = small(stored(first.select(*[F.col(c).alias(f"f_{c}") for c in key], "first"), "first"))
    joined = named.join(first, [F.col(c) == F.col(f"f_{c}") for c in key])
    return joined.where((F.col("rid") != F.col("first.rid")) | (F.col("start") != F.col("first.start"))).select("rid", "start", "length")


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` with later copies of repeated line runs taken out of ``text``, and n_lines (before) and n_deleted."""
    require(docs, "doc_id", "text")
    rest = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    box = boxed(docs.select(*[F.col(f"`{c}`") for c in rest]), "doc_id", "text")
    table = stored(box.withColumns({"_rid": F.monotonically_increasing_id(), "_order": order}), "documents")
    cuts = stored(repeated_runs(table, min_words).groupBy(F.col("rid").alias("_r")).agg(F.collect_list(F.struct("start", "length")).alias("_cuts")), "cuts")
    held = cuts.agg(F.count(F.lit(1)) * 2 + F.coalesce(F.sum(F.size("_cuts")), F.lit(0))).first()[0]
    cuts = F.broadcast(cuts) if held <= BROADCAST_CUTS else cuts
    joined = table.join(cuts, F.col("_rid") == F.col("_r"), "left").select("doc_id", "text", "_doc", "_cuts")
    schema = T.StructType([box.schema[c] for c in ("doc_id", "text", "_doc")]).add("n_lines", "long").add("n_deleted", "long")

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in sliced(batches, "text"):
            texts, n_lines, n_deleted = [], [], []
            for value, cut in zip(batch["text"], batch["_cuts"], strict=True):
                text, cut = value.as_py(), cut.as_py()
                n = text.count("\n") + 1 if text else 0
                gone = 0
                if cut:
                    drop = bytearray(n)
                    for c in cut:
                        drop[c["start"] : c["start"] + c["length"]] = b"\1" * c["length"]
                    gone = sum(drop)
                    text = "\n".join(x for x, d in zip(text.split("\n"), drop, strict=True) if not d)
                texts.append(text)
                n_lines.append(n)
                n_deleted.append(gone)
            arrays = [batch["doc_id"], pa.array(texts, pa.string()), batch["_doc"], pa.array(n_lines, pa.int64()), pa.array(n_deleted, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text", "_doc", "n_lines", "n_deleted"])

    kept = [F.col(c) if c in ("doc_id", "text") else F.col(f"_doc.`{c}`").alias(c) for c in rest]
    return joined.mapInArrow(run, schema).select(*kept, "n_lines", "n_deleted")
