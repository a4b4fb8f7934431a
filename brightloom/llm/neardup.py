"""MinHash near-duplicate detection: banding, signature verification, exact checks, star components.

1. One pass in Arrow batches takes each text's set of word shingles, its digest,
   its MinHash bands and a signature of one byte per hash.
2. Equal sets are one class; only a class's first row goes on, so copies cost
   one partial aggregation, however many there are.
3. Members of a band bucket are compared by signature, all pairs across
   components, in cells of bounded size. A cell passes on a spanning forest of
   the pairs that sizes and signatures admit, never the pairs. Buckets with equal
   members are compared once.
4. What the forests join is a family: alternating large-star and small-star.
   Full sets are recomputed from the texts of family members alone and go to the
   family's cells, where each admitted pair is checked exactly unless the cell
   has joined its ends already. So no pair that meets in a bucket is left out.
5. The exact links make components by large-star and small-star again.

A bucket of more than ``BLOCK`` members first pairs each member with one pivot;
pairs that signatures and full sets confirm are one component from then on, so a
large group of near copies costs as many pairs as it has members. Only pairs
across components remain for the cells, and blocks of one component don't meet.
What stays quadratic is a bucket's members that are alike by signature, but
linked to nobody.

With 32 bands of 5 rows a pair at similarity 0.8 is missed with probability
3e-6, and by the margin of the signatures with 3e-7; nothing else loses a link.

Defined results: a text without words, or null, has an empty set and links with
nothing. Equal texts share a component whatever their ids. Null ids stay: a
component takes the least id that is not null. Rows repeat as they come. Other
columns are left behind by ``near_duplicates`` and kept by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.llm.common import boxed, discard, require, sliced, small, stored, unboxed
from brightloom.llm.components import components

ROWS, BANDS, SEED = 5, 32, 20240501
#: Agreement of signatures, out of ROWS * BANDS bytes, below which a pair at the threshold is 5 deviations off.
MARGIN = 5.0
#: Members, and shingles of full sets, that a block may have; a cell compares one block or two.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
#: Tables with signatures (some 250 bytes a row) are broadcast up to so many rows.
SIGNATURE_ROWS = 60_000


def _features(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        from brightloom.llm.shingles import MinHash, shingle_set

        hashes = MinHash(ROWS, BANDS, SEED)
        for batch in sliced(batches, "text"):
            n, c1, c2, bands, sigs = [], [], [], [], []
            for value in batch["text"]:
                s = shingle_set(value.as_py(), size)
                digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                n.append(len(s))
                c1.append(int(digest[0]))
                c2.append(int(digest[1]))
                if len(s):
                    minima = hashes.minima(s)
                    bands.append(hashes.band_keys(minima))
                    sigs.append((minima >> np.uint64(20)).astype(np.uint8).tobytes())
                else:
                    bands.append(np.empty(0, np.int64))
                    sigs.append(b"")
            offsets = np.cumsum([0, *map(len, bands)]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *bands])))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["tkey"], pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), keys, pa.array(sigs, pa.binary())],
                ["doc_id", "tkey", "n", "c1", "c2", "bands", "sig"],
            )

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)])
    for f in T._parse_datatype_string("tkey bigint, n bigint, c1 bigint, c2 bigint, bands array<bigint>, sig binary"):
        schema = schema.add(f)
    return docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text").mapInArrow(run, schema)


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """(v, n, shingles): the full set as 8-byte numbers, sorted."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        from brightloom.llm.shingles import shingle_set

        for batch in sliced(batches, "text", 1 << 20):
            sets = [shingle_set(t.as_py(), size) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch["v"], pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["v", "n", "shingles"]
            )

    return texts.select("v", "text").mapInArrow(run, "v bigint, n bigint, shingles binary")


def _close_in_size(percent: int):
    """Two sets can only be similar enough if the smaller has that share of the larger."""
    return F.least("n", "pn") * 100 >= F.greatest("n", "pn") * percent


def _least_agreement(percent: int) -> int:
    k, t = ROWS * BANDS, percent / 100
    return int(k * (t - MARGIN * (t * (1 - t) / k) ** 0.5))


def _signature_pass(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose signatures don't rule out the threshold."""
    k, least = ROWS * BANDS, _least_agreement(percent)

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, k) for c in ("sa", "sb"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    left = sigs.select(F.col("v").alias("va"), F.col("sig").alias("sa"))
    right = sigs.select(F.col("v").alias("vb"), F.col("sig").alias("sb"))
    both = pairs.join(right, F.col("b") == F.col("vb")).join(left, F.col("a") == F.col("va"))
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            good = []
            for x, y in zip(batch["xa"], batch["xb"], strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("v").alias("va"), F.col("shingles").alias("xa"))
    right = sets.select(F.col("v").alias("vb"), F.col("shingles").alias("xb"))
    both = pairs.join(right, F.col("b") == F.col("vb")).join(left, F.col("a") == F.col("va"))
    return both.select("a", "b", "xa", "xb").mapInArrow(run, "a bigint, b bigint")


def _agreement(x, y):
    """How many bytes each row of ``x`` shares with each row of ``y``."""
    import numpy as np

    out = np.zeros((len(x), len(y)), np.uint8 if x.shape[1] < 256 else np.int32)
    for a, b in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), strict=True):
        out += a[:, None] == b
    return out


def _admitted(at, n, r, sig, percent: int, least: int):
    """Square matrix of the pairs of a cell that blocks, components, sizes and signatures admit."""
    import numpy as np

    one = at[0] == at
    left, right = (one, ~one) if not one.all() else (one, one)
    ok = _agreement(sig[left], sig[right]) >= least
    small, large = np.minimum(n[left][:, None], n[right]), np.maximum(n[left][:, None], n[right])
    ok &= (r[left][:, None] != r[right]) & (small * 100 >= large * percent)
    out = np.zeros((len(at), len(at)), bool)
    out[np.ix_(left, right)] = ok
    return out | out.T


def _forest(ok):
    """For each vertex of a symmetric matrix the first vertex of its component."""
    import numpy as np

    label = np.full(len(ok), -1)
    for i in range(len(ok)):
        if label[i] < 0:
            label[i], front = i, np.array([i])
            while len(front):
                front = np.flatnonzero(ok[front].any(axis=0) & (label < 0))
                label[front] = i
    return label


def _exact_forest(ok, n, sets, percent: int):
    """As ``_forest`` over the admitted pairs whose full sets are similar enough; pairs already joined need no check."""
    import numpy as np

    label = np.arange(len(ok))
    distinct, number = np.unique(np.concatenate(sets), return_inverse=True)
    numbers, here = np.split(number, np.cumsum(n)[:-1]), np.zeros(len(distinct), np.int32)
    for x in range(len(ok)):
        partners = np.flatnonzero(ok[x] & (label != label[x]))
        if not len(partners):
            continue
        here[numbers[x]] = 1
        for some in np.array_split(partners, min(len(partners), -(-int(n[partners].sum()) // 1_000_000))):
            both = np.add.reduceat(here[np.concatenate([numbers[t] for t in some])], np.cumsum([0, *n[some][:-1]]))
            for t in some[100 * both >= percent * (n[x] + n[some] - both)]:
                label[label == label[t]] = label[x]
        here[numbers[x]] = 0
    return label


def _dealt(members: DataFrame, weight: Column) -> DataFrame:
    """``members`` (g, v, r, ...) with lo, hi and at: rows of one (g, lo, hi) are a cell, ``at`` is lo or hi.

    Any two members of a group g from different components r share a cell. A
    group of weight 1 at most is one cell. In a larger one, components of more
    than half a block have blocks of their own, all others share blocks; each
    two blocks are a cell unless both are of one component.
    """
    loads = members.groupBy("g", "r").agg(F.sum(weight).alias("load"))
    own = F.ceil(F.when(F.col("load") > 0.5, F.col("load")).otherwise(0.0)).cast("long")
    rest = F.ceil(F.sum(F.when(F.col("load") <= 0.5, F.col("load")))).cast("long")
    groups = loads.groupBy("g").agg(F.sum("load").alias("total"), F.coalesce(rest, F.lit(0)).alias("rest")).where("total > 1").select(F.col("g").alias("x"), "rest")
    groups = stored(groups, "groups")
    one = [F.lit(0).cast("long").alias(c) for c in ("lo", "hi", "at")]
    if groups.isEmpty():
        return members.select("*", *one)
    block = lambda r, i: F.xxhash64(r, i)
    shared = F.lit(-1).cast("long")
    parts = stored(loads.withColumn("own", own).join(small(groups), F.col("g") == F.col("x")).select("g", "r", "own", "rest"), "parts")
    each = parts.where("own > 0").select("g", "r", F.explode(F.sequence(F.lit(1), F.col("own"))).alias("i"))
    some = groups.where("rest > 0").select(F.col("x").alias("g"), shared.alias("r"), F.explode(F.sequence(F.lit(1), F.col("rest"))).alias("i"))
    blocks = stored(each.union(some).select("g", "r", block("r", "i").alias("at")), "blocks")
    other = blocks.select(F.col("g").alias("g2"), F.col("r").alias("r2"), F.col("at").alias("at2"))
    two = (F.col("at") < F.col("at2")) & ((F.col("r") != F.col("r2")) | (F.col("r") == shared))
    pairs = blocks.join(other, F.col("g") == F.col("g2")).where(two | (F.col("at") == F.col("at2")) & (F.col("r") == shared))
    pairs = stored(pairs.select(F.col("g").alias("pg"), F.explode(F.array_distinct(F.array("at", "at2"))).alias("pa"), F.col("at").alias("lo"), F.col("at2").alias("hi")), "cells")
    place = parts.select(F.col("g").alias("x"), F.col("r").alias("y"), "own", "rest")
    placed = members.join(small(place), (F.col("g") == F.col("x")) & (F.col("r") == F.col("y")), "left")
    nth = lambda k: F.pmod(F.xxhash64("v", F.lit(7)), F.greatest(k, F.lit(1))) + 1
    at = F.when(F.col("own") > 0, block("r", nth(F.col("own")))).otherwise(block(shared, nth(F.col("rest"))))
    whole = placed.where("x is null").select(*members.columns, *one)
    many = placed.where("x is not null").withColumn("at", at).join(small(pairs), (F.col("g") == F.col("pg")) & (F.col("at") == F.col("pa")))
    return whole.union(many.select(*members.columns, "lo", "hi", "at"))


def _cell_links(members: DataFrame, weight: Column, percent: int, sets: DataFrame | None = None) -> DataFrame:
    """Links (a, b): spanning forests of each cell's pairs, by signatures or, with ``sets``, exactly."""
    exact, k, least = sets is not None, ROWS * BANDS, _least_agreement(percent)
    cells = _dealt(members, weight)
    if exact:
        cells = sets.join(small(stored(cells, "cells"), SIGNATURE_ROWS), F.col("v") == F.col("y"))
    columns = ["g", "lo", "hi", "v", "at", "n", "r", "sig", *["shingles"] * exact]
    cells = cells.select(*columns).repartition("g", "lo", "hi").sortWithinPartitions("g", "lo", "hi", "v")

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def links(rows):
            v, at, n, r = (np.array(c, np.int64) for c in list(zip(*rows, strict=True))[3:7])
            if len(v) < 2:
                return
            sig = np.frombuffer(b"".join([x[7] for x in rows]), np.uint8).reshape(-1, k)
            ok = _admitted(at, n, r, sig, percent, least)
            if exact:
                few = np.flatnonzero(ok.any(axis=0))
                label = np.arange(len(v))
                if len(few):
                    label[few] = few[_exact_forest(ok[np.ix_(few, few)], n[few], [np.frombuffer(rows[i][8], np.uint64) for i in few], percent)]
            else:
                label = _forest(ok)
            moved = np.flatnonzero(label != np.arange(len(v)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(v[label[moved]]), pa.array(v[moved])], ["a", "b"])

        cell, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != cell:
                    if rows:
                        yield from links(rows)
                    cell, rows = row[:3], []
                rows.append(row)
        if rows:
            yield from links(rows)

    return cells.mapInArrow(run, "a bigint, b bigint")


def _pivot_pairs(hot: DataFrame, percent: int) -> DataFrame:
    """Each bucket's members (key, v, n) with its least member."""
    pivots = hot.groupBy("key").agg(F.min(F.struct("v", "n")).alias("p")).select(F.col("key").alias("pk"), F.col("p.v").alias("pv"), F.col("p.n").alias("pn"))
    pairs = hot.join(small(stored(pivots, "pivots")), F.col("key") == F.col("pk")).where((F.col("v") != F.col("pv")) & _close_in_size(percent))
    return pairs.select(F.col("pv").alias("a"), F.col("v").alias("b")).distinct()


def _mixed_buckets(marked: DataFrame) -> DataFrame:
    """Members (g, v, n, r) of the buckets of several components; of buckets with the same members one is taken."""
    whole = marked.groupBy("g").agg(
        F.min("r").alias("low"), F.max("r").alias("high"), F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("v")).alias("x"), F.bit_xor(F.xxhash64("v", F.lit(1))).alias("y")
    )
    once = stored(whole.where("low <> high").groupBy("m", "x", "y").agg(F.min("g").alias("k")).select("k"), "once")
    return marked.join(small(once), F.col("g") == F.col("k"), "left_semi")


def _links(docs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame | None:
    """Roots of linked representatives: (v, root); None without any link."""
    keyed = reps.select("v", "n", F.explode("bands").alias("key"))
    shared = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("key").alias("k"), "m"), "buckets")
    members = stored(keyed.join(small(shared), F.col("key") == F.col("k")).select("key", "m", "v", "n"), "members")
    if members.isEmpty():
        return None
    ends = stored(members.select(F.col("v").alias("x")).distinct(), "ends")
    wanted = stored(reps.join(small(ends), F.col("v") == F.col("x"), "left_semi").select("v", "doc_id", "tkey", "n", "sig"), "wanted")

    def sets(of: DataFrame) -> DataFrame:
        keys = small(stored(of.select(F.col("v").alias("x")).distinct(), "keys"))
        keys = small(stored(wanted.join(keys, F.col("v") == F.col("x"), "left_semi").select("v", F.col("doc_id").alias("d"), F.col("tkey").alias("t")), "keys"))
        texts = docs.select("doc_id", "text", F.xxhash64("text").alias("tkey")).join(keys, (F.col("tkey") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")))
        return _sets(texts.select("v", "text").dropDuplicates(["v"]), size)

    label, hot = None, members.where(F.col("m") > BLOCK)
    if not hot.isEmpty():
        pairs = stored(_signature_pass(_pivot_pairs(hot, percent), wanted, percent), "pairs")
        full = stored(sets(pairs.select(F.explode(F.array("a", "b")).alias("v"))), "sets")
        links = stored(_verified(pairs, full, percent), "links")
        label = None if links.isEmpty() else stored(components(links), "roots")
        discard(pairs, full, links)
    marked = members.select(F.col("key").alias("g"), "v", "n")
    if label is None:
        marked = marked.withColumn("r", F.col("v"))
    else:
        marked = marked.join(small(label.withColumnRenamed("v", "x")), F.col("v") == F.col("x"), "left").select("g", "v", "n", F.coalesce("root", "v").alias("r"))
        marked = stored(marked, "marked")
    mixed = _mixed_buckets(marked)
    sigs = small(wanted.select(F.col("v").alias("x"), "sig"), SIGNATURE_ROWS)
    mixed = stored(mixed.join(sigs, F.col("v") == F.col("x")).select("g", "v", "n", "r", "sig"), "mixed")
    likely = stored(_cell_links(mixed, F.lit(1 / BLOCK), percent), "likely")
    discard(members, mixed)
    if not likely.isEmpty():
        family = stored(components(likely), "families")
        full = sets(family).select(F.col("v").alias("y"), "shingles")
        joined = wanted.join(small(family.select(F.col("v").alias("x"), F.col("root").alias("g"))), F.col("v") == F.col("x")).select("g", "v", "n", "sig")
        if label is None:
            joined = joined.withColumn("r", F.col("v"))
        else:
            joined = joined.join(small(label.withColumnRenamed("v", "x")), F.col("v") == F.col("x"), "left").select("g", "v", "n", "sig", F.coalesce("root", "v").alias("r"))
        joined = stored(joined, "joined")
        links = stored(_cell_links(joined, F.lit(1 / BLOCK) + F.col("n") / BLOCK_SHINGLES, percent, full), "links")
        if not links.isEmpty():
            more = links if label is None else links.union(label.select(F.col("v").alias("a"), F.col("root").alias("b")))
            label = stored(components(more), "roots")
        discard(likely, family, links)
    discard(wanted)
    return label


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, tkey (hash of its text), n_shingles, component_id, kept, stays.

    ``kept``: its id is its component's. ``stays``: it is the row that stands for
    its component (one row, also where ids repeat).
    """
    require(docs, "doc_id", "text")
    docs = docs.select("doc_id", "text")
    rows = stored(_features(docs, size).withColumn("rid", F.monotonically_increasing_id()), "features")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")
    classes = stored(rows.where("n > 0").groupBy("c1", "c2").agg(F.min("rid").alias("v"), first, F.count(F.lit(1)).alias("m")), "classes")
    reps = stored(rows.join(classes.select(F.col("v")), F.col("rid") == F.col("v"), "left_semi").select(F.col("rid").alias("v"), "doc_id", "tkey", "n", "bands", "sig"), "reps")
    label = _links(docs, reps, size, percent)
    if label is None:
        heads = classes.where("m > 1").select("c1", "c2", "first")
    else:
        marked = classes.join(label.withColumnRenamed("v", "x"), F.col("v") == F.col("x"), "left").where("m > 1 or root is not null").withColumn("root", F.coalesce("root", "v"))
        marked = stored(marked.select("c1", "c2", "first", "root"), "marked")
        least = marked.groupBy("root").agg(F.min("first").alias("least")).withColumnRenamed("root", "r")
        heads = marked.join(least, F.col("root") == F.col("r")).select("c1", "c2", F.col("least").alias("first"))
    heads = small(stored(heads.select(F.col("c1").alias("h1"), F.col("c2").alias("h2"), "first"), "heads"))
    joined = rows.select("doc_id", "tkey", "n", "c1", "c2", "rid").join(heads, (F.col("c1") == F.col("h1")) & (F.col("c2") == F.col("h2")) & (F.col("n") > 0), "left")
    component = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return joined.select(
        "doc_id", "tkey", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
        F.coalesce(F.col("first.rid") == F.col("rid"), F.lit(True)).alias("stays"),
    )


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component; texts without words all stay."""
    verdicts = near_duplicates(docs, size, percent)
    by_key = verdicts.groupBy("doc_id", "tkey").agg(F.count(F.lit(1)).alias("_rows"), F.sum(F.col("stays").cast("int")).alias("_stay"))
    changed = stored(by_key.where("_rows > _stay").select(F.col("doc_id").alias("_d"), F.col("tkey").alias("_t"), "_stay"), "dropped")
    joined = boxed(docs, "doc_id", "text").withColumn("_k", F.xxhash64("text")).join(small(changed), (F.col("_k") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    once = joined.where("_stay = 1").dropDuplicates(["_k", "doc_id"])
    both = joined.where("_stay is null").unionByName(once)
    return unboxed(both, docs.columns, "doc_id", "text")
