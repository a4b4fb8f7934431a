"""Evaluation: span credit, micro scores, slices, confusion, bootstrap. All from one scored row per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.core.canonical import derive_seed, make_rng
from brightloom.functions import tags as tg

# Ratios with the rule for empty sides: a score without predictions (or gold) is 1; a confusion label without is 0.


def precision(credit: Column, pred: Column) -> Column:
    return F.when(pred == 0, F.lit(1.0)).otherwise(credit / pred)


def recall(credit: Column, gold: Column) -> Column:
    return F.when(gold == 0, F.lit(1.0)).otherwise(credit / gold)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def scored(records: DataFrame) -> DataFrame:
    """Records (gold_intent, pred_intent, gold_tags, pred_tags; tags valid) with all counts that the scores need."""
    staged = records.withColumns({"gold_spans": tg.spans(F.col("gold_tags")), "pred_spans": tg.spans(F.col("pred_tags"))})
    same = F.col("gold_intent").eqNullSafe(F.col("pred_intent"))
    return staged.withColumns(
        {
            "n_gold": F.size("gold_spans").cast("long"),
            "n_pred": F.size("pred_spans").cast("long"),
            "credit_strict": tg.strict_credit(F.col("gold_spans"), F.col("pred_spans")),
            "credit_partial": tg.partial_credit(F.col("gold_spans"), F.col("pred_spans")),
            "intent_ok": same.cast("int"),
            "turn_ok": (same & F.col("gold_spans").eqNullSafe(F.col("pred_spans"))).cast("int"),
        }
    )


def micro(rows: DataFrame, policy: str = "strict", by: list[str] | None = None) -> DataFrame:
    """Micro precision, recall and F1 of scored rows, by columns if asked."""
    if policy not in ("strict", "partial"):
        raise ValueError(f"unknown policy {policy!r}")
    sums = rows.groupBy(*(by or [])).agg(
        F.coalesce(F.sum("n_gold"), F.lit(0)).alias("gold"), F.coalesce(F.sum("n_pred"), F.lit(0)).alias("pred"), F.coalesce(F.sum(f"credit_{policy}"), F.lit(0.0)).alias("credit")
    )
    p, r = precision(F.col("credit"), F.col("pred")), recall(F.col("credit"), F.col("gold"))
    return sums.withColumns({"precision": p, "recall": r}).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def accuracy(rows: DataFrame, flag: str, by: list[str] | None = None) -> DataFrame:
    sums = rows.groupBy(*(by or [])).agg(F.coalesce(F.sum(flag), F.lit(0)).cast("long").alias("correct"), F.count(F.lit(1)).alias("total"))
    return sums.withColumn("accuracy", F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("correct") / F.col("total")))


def slice_summary(rows: DataFrame, slices: str = "slices") -> DataFrame:
    """Scores for each (kind, value) in a map column."""
    each = rows.select("*", F.explode(slices).alias("kind", "value"))
    sums = each.groupBy("kind", "value").agg(
        F.count(F.lit(1)).alias("records"), F.sum("intent_ok").alias("ok"), F.sum("n_gold").alias("g"), F.sum("n_pred").alias("p"),
        F.sum("credit_strict").alias("s"), F.sum("credit_partial").alias("c"),
    )
    score = lambda c: f1(precision(F.col(c), F.col("p")), recall(F.col(c), F.col("g")))
    return sums.select("kind", "value", "records", (F.col("ok") / F.col("records")).alias("intent_accuracy"), score("s").alias("slot_strict"), score("c").alias("slot_partial"))


def confusion(pairs: DataFrame, gold: str = "gold", pred: str = "pred", labels: list[str] | None = None) -> DataFrame:
    """Counts for each pair of labels, zeros included; labels are given or all that occur (few)."""
    spark = pairs.sparkSession
    counts = pairs.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    if labels is None:
        names = counts.select(F.explode(F.array("gold", "pred")).alias("label")).distinct()
    else:
        names = spark.createDataFrame([(x,) for x in labels], "label string")
        other = counts.where(~F.col("gold").isin(labels) | ~F.col("pred").isin(labels))
        if not other.isEmpty():
            raise ValueError(f"unknown label: {other.first()}")
    every = F.array_sort(F.collect_set("label"))
    grid = names.agg(every.alias("labels")).select(F.explode("labels").alias("gold"), "labels").select("gold", F.explode("labels").alias("pred"))
    return grid.join(counts, ["gold", "pred"], "left").select("gold", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def per_label(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each label; 0 where a side is empty."""
    sides = matrix.select(
        F.explode(F.array(F.struct(F.col("gold").alias("label"), F.col("n").alias("g"), F.lit(0).cast("long").alias("p")), F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("g"), F.col("n").alias("p")))).alias("x"),
        F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("hit"),
    ).select("x.*", "hit")
    sums = sides.groupBy("label").agg(F.sum("g").alias("support"), F.sum("p").alias("predicted"), (F.sum("hit") / 2).alias("hit"))
    ratio = lambda a, b: F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.col(a) / F.col(b))
    out = sums.withColumns({"precision": ratio("hit", "predicted"), "recall": ratio("hit", "support")})
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall"))).select("label", "precision", "recall", "f1", "support")


def matrix_totals(matrix: DataFrame) -> DataFrame:
    """(total, correct, accuracy) of a confusion matrix; 0 where it counts nothing."""
    sums = matrix.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n"))), F.lit(0)).alias("correct"))
    return sums.withColumn("accuracy", F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("correct") / F.col("total")))


#: What a bootstrap may estimate: for resampled sums of these columns, the ratio or F1 of them.
STATISTICS = {"intent": ("intent_ok", None), "turn": ("turn_ok", None), "slot_strict": ("credit_strict", ("n_gold", "n_pred")), "slot_partial": ("credit_partial", ("n_gold", "n_pred"))}


def statistic(name: str, sums: dict[str, float], weight: float) -> float:
    """A statistic from (weighted) sums over records."""
    top, sides = STATISTICS[name]
    if sides is None:
        return sums[top] / weight
    gold, pred = (sums[s] for s in sides)
    p, r = (sums[top] / x if x else 1.0 for x in (pred, gold))
    return 2 * p * r / (p + r) if p + r else 0.0


def bootstrap_statistic(rows: DataFrame, name: str, key: str, seed: int, replicates: int = 1000, confidence: float = 0.95) -> dict:
    """Percentile interval of a statistic over resampled records, in the order of ``key``, with one sequential generator.

    Needs the counts of each record in one place, some 30 bytes a record; ``bootstrap_scalable`` is for more.
    """
    import numpy as np

    if name not in STATISTICS or not 10 <= replicates <= 100_000 or not 0 < confidence < 1:
        raise ValueError("needs a known statistic, 10 to 100000 replicates and a confidence in (0, 1)")
    top, sides = STATISTICS[name]
    columns = [top, *(sides or ())]
    held = np.array([[float(r[c]) for c in columns] for r in rows.select(key, *columns).orderBy(key).toLocalIterator()])
    if not len(held):
        raise ValueError("needs records")
    rng, n = make_rng(derive_seed("bootstrap", seed)), len(held)
    value = lambda sums: statistic(name, dict(zip(columns, sums, strict=True)), n)
    drawn = np.array([value(held[rng.integers(0, n, n)].sum(axis=0)) for _ in range(replicates)])
    tail = (1 - confidence) / 2 * 100
    low, high = np.percentile(drawn, [tail, 100 - tail])
    return {"statistic": name, "estimate": float(value(held.sum(axis=0))), "low": float(low), "high": float(high), "replicates": replicates, "confidence": confidence, "seed": seed}


def bootstrap_exact(hits: list[float], seed: int, replicates: int = 1000, confidence: float = 0.95) -> dict:
    """Percentile interval of the mean of per-record values, with one sequential generator as small runs expect."""
    import numpy as np

    if not 10 <= replicates <= 100_000 or not 0 < confidence < 1 or not hits:
        raise ValueError("needs records, 10 to 100000 replicates and a confidence in (0, 1)")
    values, rng = np.asarray(hits, float), make_rng(derive_seed("bootstrap", seed))
    stats = np.array([values[rng.integers(0, len(values), len(values))].mean() for _ in range(replicates)])
    tail = (1 - confidence) / 2 * 100
    low, high = np.percentile(stats, [tail, 100 - tail])
    return {"estimate": float(values.mean()), "low": float(low), "high": float(high), "replicates": replicates, "confidence": confidence, "seed": seed}


def poisson_cuts(scale: int) -> list[int]:
    """Cumulative probabilities of 0, 1, 2, ... under Poisson(1), out of ``scale``."""
    cuts, total, p = [], 0.0, 0.36787944117144233
    for k in range(1, 9):
        total += p
        cuts.append(int(total * scale))
        p /= k
    return cuts


def bootstrap_scalable(rows: DataFrame, top: str, bottom: Column, key: str, replicates: int = 200, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """Percentile interval of sum(top) / sum(bottom) under Poisson(1) weights, for any number of records.

    Each record has ``replicates`` weights in one array, by inversion of hash digits
    (20 bits each, 12 to a hash); sums of all replicates are aggregated partially,
    so the shuffle has one row for each task and replicate.
    """
    cuts = F.array(*[F.lit(c) for c in poisson_cuts(1 << 20)])
    prefix = F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"), F.lit("|"))
    digit = lambda h, j: F.conv(F.substring(h, j * 5 + 1, F.lit(5)), 16, 10).cast("int")
    weight = lambda u: F.size(F.filter(cuts, lambda c: c <= u))
    hashes = F.transform(F.sequence(F.lit(0), F.lit((replicates - 1) // 12)), lambda b: F.sha2(F.concat(prefix, b.cast("string")), 256))
    weights = F.slice(F.flatten(F.transform(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.lit(11)), lambda j: weight(digit(h, j))))), 1, replicates)
    each = rows.select(F.col(top).cast("double").alias("t"), bottom.cast("double").alias("b"), key).select("t", "b", F.posexplode(weights).alias("r", "w"))
    stats = each.groupBy("r").agg((F.sum(F.col("t") * F.col("w")) / F.sum(F.col("b") * F.col("w"))).alias("v"))
    tail = (1 - confidence) / 2
    ends = F.percentile("v", F.array(F.lit(tail), F.lit(1 - tail)))
    return stats.agg(ends.alias("e"), F.count(F.lit(1)).alias("replicates")).select(F.col("e")[0].alias("low"), F.col("e")[1].alias("high"), "replicates")
