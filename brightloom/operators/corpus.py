"""Instruction corpora: duplicates, turn rules, quality flags, mixing, splits, statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brightloom.core.canonical import derive_seed, make_rng
from brightloom.core.errors import ValidationError
from brightloom.functions import text as tx
from brightloom.functions.arrays import let

SPLITS = ("train", "dev", "test")
# Instruction templates and issue names.
SYSTEM_TEXT = {
    "zh": "你是语音助手。听用户的语音，识别{domain}领域的意图和槽位。",
    "en": "You are a speech assistant. Listen to the user's audio and identify the intent and slots for the {domain} domain.",
}
ANSWERS = {"zh": "意图：{intent}；槽位：{slots}", "en": "Intent: {intent}; Slots: {slots}"}
NO_SLOTS = {"zh": "无", "en": "none"}
ISSUES = ("duration-out-of-bounds", "snr-below-minimum", "answer-not-canonical")


def exact_duplicate_groups(rows: DataFrame, id_column: str, normal: Column) -> DataFrame:
    """Ids of equal normalised texts, two or more: (text_hash, ids, n).

    Ids of one group are one value in the result, as asked for; ``exact_duplicates`` has a row for each instead.
    """
    keyed = rows.select(F.col(id_column).alias("id"), tx.text_hash(normal).alias("text_hash"))
    groups = keyed.groupBy("text_hash").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.count(F.lit(1)).alias("n"))
    return groups.where("n > 1")


def exact_duplicates(rows: DataFrame, id_column: str, normal: Column) -> DataFrame:
    """(id, text_hash, first_id, n): each member of a group of two or more, whatever the group's size."""
    keyed = rows.select(F.col(id_column).alias("id"), tx.text_hash(normal).alias("text_hash"))
    groups = keyed.groupBy("text_hash").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(groups, "text_hash")


def gram_vectors(rows: DataFrame, id_column: str, normal: Column) -> DataFrame:
    """(id, bucket, n): counts of gram buckets, 256 at most for a row, counted in the row."""
    grams = F.sort_array(tx.gram_buckets(normal))

    def counts(g: Column) -> Column:
        """Runs of the sorted buckets: a run ends where the next begins."""
        placed = F.transform(g, lambda x, i: F.struct(x.alias("bucket"), i.alias("i"), F.coalesce(F.get(g, i - 1), F.lit(-1)).alias("p")))
        starts = F.filter(placed, lambda s: s["p"] != s["bucket"])
        n = lambda s, a, k: (F.coalesce(F.get(a, k + 1)["i"], F.size(g)) - s["i"]).cast("long")
        return let(starts, lambda a: F.transform(a, lambda s, k: F.struct(s["bucket"].alias("bucket"), n(s, a, k).alias("n"))))

    return rows.select(F.col(id_column).alias("id"), F.explode(let(grams, counts)).alias("x")).select("id", "x.bucket", "x.n")


def feature_vector(normal: Column) -> Column:
    """The dense vector of 256 bucket counts, scaled to length 1 (all zero for empty text)."""
    grams = tx.gram_buckets(normal)
    zero = F.array_repeat(F.lit(0.0), 256)
    counts = let(grams, lambda a: F.transform(F.sequence(F.lit(0), F.lit(255)), lambda b: F.size(F.filter(a, lambda g: g == b)).cast("double")))

    def scaled(c: Column) -> Column:
        norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
        return let(norm, lambda n: F.when(n == 0, zero).otherwise(F.transform(c, lambda x: x / n)))

    return let(counts, scaled)


def near_duplicate_pairs(vectors: DataFrame, threshold: float = 0.9, id_column: str = "id", vector: str = "vector", pivots: int = 3, block: int = 2048) -> DataFrame:
    """All pairs a < b with cosine >= threshold: (a, b, cosine), exact. Vectors without length match nothing.

    Angles obey the triangle inequality, so two vectors within the threshold's
    angle differ by no more than it in their angle to any pivot. Rows are dealt to
    cells of that width in the angles to a few axes and meet only neighbouring
    cells. A cell's rows are split into blocks of about ``block`` rows by hash, so
    a cell where vectors cluster is many small tasks; a task multiplies two blocks
    as matrices and gives out only the pairs it finds. Work is quadratic where
    vectors point one way, as no bound tells them apart, but memory is not.
    """
    width = math.acos(max(-1.0, min(1.0, threshold))) * (1 + 1e-9) or 1e-6
    unit = _unit(vectors.select(F.col(id_column).alias("id"), F.col(vector).alias("v")), width, pivots)
    cells = [f"c{k}" for k in range(pivots)]
    counts = unit.groupBy(*cells).agg(F.count(F.lit(1)).alias("n"))
    # A table of cells with their blocks, and of the block pairs of cells that touch: its size is that of the cells, not of the rows.
    blocks = counts.select(*cells, F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block).cast("int"))).alias("b"))
    near = blocks
    for c in cells:
        near = near.withColumn(f"o{c}", F.explode(F.array(*[F.col(c) + d for d in (-1, 0, 1)])))
    other = blocks.select(*[F.col(c).alias(f"p{c}") for c in cells], F.col("b").alias("pb"))
    mine, theirs = F.struct(*cells, "b"), F.struct(*[F.col(f"p{c}") for c in cells], F.col("pb"))
    pairs = near.join(other, [F.col(f"o{c}") == F.col(f"p{c}") for c in cells]).select(mine.alias("l"), theirs.alias("r")).where("l <= r")
    pairs = pairs.select(F.xxhash64("l", "r").alias("task"), F.col("l").cast("string").alias("left"), F.col("r").cast("string").alias("right"))
    needs = pairs.select("task", F.explode(F.array(F.struct(F.col("left").alias("at"), F.lit(0).alias("side")), F.struct(F.col("right").alias("at"), F.lit(1).alias("side")))).alias("x")).select("task", "x.*")
    # A block with itself needs one side.
    needs = needs.groupBy("task", "at").agg(F.min("side").alias("side"))
    sized = unit.join(counts.withColumnsRenamed({c: f"p{c}" for c in cells}), [F.col(c) == F.col(f"p{c}") for c in cells])
    own = F.pmod(F.xxhash64("id"), F.floor((F.col("n") - 1) / block) + 1).cast("int")
    placed = sized.select("id", "v", F.struct(*cells, own.alias("b")).cast("string").alias("place"))
    met = placed.join(needs, F.col("place") == F.col("at")).select("task", "side", "id", "v")
    kind = vectors.schema[id_column].dataType.simpleString()

    def run(rows):
        import numpy as np
        import pyarrow as pa

        ids, side = np.array(rows["id"].to_pylist()), rows["side"].to_numpy()
        x = np.stack(rows["v"].to_numpy(zero_copy_only=False))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        one = not len(right)
        right = left if one else right
        found = x[left] @ x[right].T
        i, j = np.nonzero(found >= threshold)
        a, b = ids[left[i]], ids[right[j]]
        keep = a < b if one else a != b
        a, b, c = a[keep], b[keep], found[i, j][keep]
        swap = a > b
        pair = [pa.array(x.tolist(), rows["id"].type) for x in (np.where(swap, b, a), np.where(swap, a, b))]
        return pa.table([*pair, pa.array(c, pa.float64())], ["a", "b", "cosine"])

    return met.groupBy("task").applyInArrow(run, f"a {kind}, b {kind}, cosine double")


def _unit(vectors: DataFrame, width: float, pivots: int) -> DataFrame:
    """(id, v, c0, ...): vectors scaled to length 1, and their cells by the angles to ``pivots`` axes."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids, values = batch["id"], batch["v"]
            rows = [(i, np.asarray(v, np.float64)) for i, v in zip(ids.to_pylist(), values.to_numpy(zero_copy_only=False), strict=True) if v is not None]
            rows = [(i, v / n) for i, v in rows if np.isfinite(v).all() and (n := float(np.sqrt(v @ v))) > 0]
            # Axis k is the sum of each pivots-th coordinate, from k on; the angle needs no pass over the data.
            along = [[float(v[k::pivots].sum()) / math.sqrt(max(1, len(v[k::pivots]))) for _, v in rows] for k in range(pivots)]
            cells = [pa.array(np.floor(np.arccos(np.clip(a, -1, 1)) / width).astype(np.int32), pa.int32()) for a in along]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], ids.type), pa.array([v for _, v in rows], pa.list_(pa.float64())), *cells], names)

    names = ["id", "v", *[f"c{k}" for k in range(pivots)]]
    schema = f"id {vectors.schema['id'].dataType.simpleString()}, v array<double>, " + ", ".join(f"c{k} int" for k in range(pivots))
    return vectors.mapInArrow(run, schema)


def turn_structure(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """For each conversation whether its roles are legal: maybe a system turn first, then user and assistant in turn, ending on assistant."""
    w = Window.partitionBy(key).orderBy(order)
    body = turns.withColumns({"n": F.row_number().over(w), "before": F.lag("role").over(w), "after": F.lead("role").over(w)})
    good = (
        F.when(F.col("role") == "system", (F.col("n") == 1) & F.col("after").isNotNull())
        .when(F.col("role") == "user", F.coalesce(F.col("before"), F.lit("system")).isin("system", "assistant") & F.col("after").isNotNull())
        .when(F.col("role") == "assistant", F.coalesce(F.col("before") == "user", F.lit(False)))
        .otherwise(False)
    )
    filled = F.coalesce(F.trim("text") != "", F.lit(False))
    return body.groupBy(key).agg(F.count(F.lit(1)).alias("n_turns"), F.min(good & filled).alias("valid"))


def quality_columns(
    duration_ms: Column, snr_db: Column | None, answer: Column, prefix: Column, low: float = 200.0, high: float = 30000.0, min_snr: float | None = None, longest: Column | None = None
) -> dict[str, Column]:
    """duration_ok, snr_ok (null: unknown), answer_canonical, issues; with several clips ``duration_ms`` is the shortest."""
    duration_ok = F.coalesce((duration_ms >= low) & ((duration_ms if longest is None else longest) <= high), F.lit(True))
    snr_ok = F.lit(None).cast("boolean") if snr_db is None or min_snr is None else snr_db >= min_snr
    canonical = F.coalesce(F.startswith(answer, prefix), F.lit(False))
    flags = (~duration_ok, F.coalesce(~snr_ok, F.lit(False)), ~canonical)
    issues = F.array_compact(F.array(*[F.when(f, F.lit(n)) for f, n in zip(flags, ISSUES, strict=True)]))
    return {"duration_ok": duration_ok, "snr_ok": snr_ok, "answer_canonical": canonical, "issues": issues}


def answer_prefix(language: str) -> str:
    return ANSWERS[language].split("{", 1)[0]


def mixing_quotas(weights: dict[str, float], size: int) -> dict[str, int]:
    """Quotas that sum to ``size``: whole shares, then one more for the largest remainders, ties by name."""
    total = sum(weights.values())
    if not weights or total <= 0 or size < 1 or any(not math.isfinite(w) or w < 0 for w in weights.values()):
        raise ValidationError("weights must be finite, not negative and sum to more than 0; size must be positive")
    share = {s: size * w / total for s, w in weights.items()}
    quota = {s: math.floor(x) for s, x in share.items()}
    order = sorted(share, key=lambda s: (quota[s] - share[s], s))
    for s in order[: size - sum(quota.values())]:
        quota[s] += 1
    return dict(sorted(quota.items()))


def mixing_quota_table(weights: DataFrame, size: int) -> DataFrame:
    """The same over a table (source, weight): a table of sources is small, its total is one aggregate."""
    total = weights.agg(F.sum("weight").alias("total"))
    raw = weights.join(F.broadcast(total), F.lit(True)).withColumn("raw", F.lit(size) * F.col("weight") / F.col("total"))
    parts = raw.withColumns({"whole": F.floor("raw"), "rest": F.col("raw") - F.floor("raw")})
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("rest"), "source")
    every = Window.partitionBy(F.lit(0))
    ranked = parts.withColumns({"rn": F.row_number().over(w), "left": F.lit(size) - F.sum("whole").over(every)})
    return ranked.select("source", (F.col("whole") + F.when(F.col("rn") <= F.col("left"), 1).otherwise(0)).cast("long").alias("quota"))


def mix_samples(samples: DataFrame, weights: dict[str, float], size: int, seed: int, source: str = "source", id_column: str = "sample_id") -> DataFrame:
    """A weighted mix, reproducible from ``seed``: rows with ``position`` 0 .. size - 1.

    Which places are chosen depends on counts alone, so the generator runs on the
    driver over group sizes; rows join their place within their source.
    """
    quotas = mixing_quotas(weights, size)
    counts = {r[source]: r["n"] for r in samples.groupBy(source).agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(counts) != set(quotas):
        raise ValidationError(f"sources and weights differ: {sorted(set(counts) ^ set(quotas), key=str)}")
    picks = []
    for s, quota in quotas.items():
        if quota > counts[s]:
            raise ValidationError(f"source {s!r} has {counts[s]} samples, its quota is {quota}")
        if quota == counts[s]:
            picks += [(s, i) for i in range(quota)]
        elif quota:
            rng = make_rng(derive_seed("mix-select", seed, s))
            picks += [(s, int(i)) for i in sorted(rng.choice(counts[s], size=quota, replace=False))]
    spark = samples.sparkSession
    chosen = spark.createDataFrame(picks, "s string, i int")
    placed = samples.withColumn("_i", F.row_number().over(Window.partitionBy(source).orderBy(id_column)) - 1)
    pool = placed.join(F.broadcast(chosen) if len(picks) <= 1_000_000 else chosen, (F.col(source) == F.col("s")) & (F.col("_i") == F.col("i"))).drop("s", "i", "_i")
    order = make_rng(derive_seed("mix-order", seed)).permutation(len(picks))
    place = spark.createDataFrame([(int(p), k) for k, p in enumerate(order)], "p int, position int")
    ranked = pool.withColumn("_p", F.row_number().over(Window.orderBy(id_column)) - 1)
    return ranked.join(place, F.col("_p") == F.col("p")).drop("_p", "p")


def assign_splits(keys: DataFrame, key: str, counts: dict[str, int], seed: int) -> DataFrame:
    """(key, split): distinct keys in the order of their hashes, dealt in turn to the splits that have a count."""
    wanted = [s for s in SPLITS if counts.get(s, 0) > 0]
    if not wanted or set(counts) - set(SPLITS):
        raise ValidationError("counts must name known splits, one at least above 0")
    text = F.col(key).cast("string")
    payload = F.concat(F.lit(f'["split",{seed},"'), text, F.lit('"]'))
    seeded = keys.select(key).distinct().withColumn("_seed", tx.derived_seed(payload))
    # Seeds are even 32-bit numbers: their high bits make radix buckets that are counted, then ranked one by one.
    radix = seeded.withColumn("_r", F.shiftright(F.col("_seed"), 20))
    before = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = radix.groupBy(F.col("_r").alias("_b")).agg(F.count(F.lit(1)).alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_r").orderBy("_seed", text)
    ranked = radix.withColumn("_i", F.row_number().over(inside) - 1).join(F.broadcast(starts), F.col("_r") == F.col("_b"))
    names = F.array(*[F.lit(s) for s in wanted])
    return ranked.select(key, F.get(names, ((F.col("_start") + F.col("_i")) % len(wanted)).cast("int")).alias("split"))


def count_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
