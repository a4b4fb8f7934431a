"""Label sequences: every short sequence against plain Python."""

from itertools import product

from pyspark.sql import functions as F

from brightloom.functions import tags as tg

ALPHABET = ["O", "B-x", "I-x", "I-y", "B-y"]


def promote(tags):
    out = []
    for i, t in enumerate(tags):
        before = tags[i - 1] if i else "O"
        out.append("B-" + t[2:] if t[0] == "I" and (before == "O" or before[2:] != t[2:]) else t)
    return out


def drop(tags):
    out, is_open = [], None
    for t in tags:
        if t[0] == "I" and is_open != t[2:]:
            out.append("O")
            is_open = None
        else:
            out.append(t)
            is_open = None if t == "O" else t[2:]
    return out


def spans(tags):
    out = []
    for i, t in enumerate(tags):
        if t[0] == "B":
            out.append([t[2:], i, i + 1])
        elif t[0] == "I":
            out[-1][2] = i + 1
    return [tuple(s) for s in out]


def partial(gold, pred):
    pairs = []
    for i, g in enumerate(gold):
        for j, p in enumerate(pred):
            both = min(g[2], p[2]) - max(g[1], p[1])
            if g[0] == p[0] and both > 0:
                pairs.append((-both / (max(g[2], p[2]) - min(g[1], p[1])), i, j))
    used, credit = (set(), set()), 0.0
    for n, i, j in sorted(pairs):
        if i not in used[0] and j not in used[1]:
            used[0].add(i), used[1].add(j)
            credit -= n
    return credit


def rows(spark):
    every = [list(t) for n in range(1, 5) for t in product(ALPHABET, repeat=n)]
    return every, spark.createDataFrame([(i, t) for i, t in enumerate(every)], "id int, tags array<string>")


def test_all_short_sequences(spark):
    every, df = rows(spark)
    t, pro = F.col("tags"), tg.promoted(F.col("tags"))
    got = {
        r["id"]: r
        for r in df.select(
            "id", tg.is_valid_sequence(t).alias("valid"), pro.alias("pro"), tg.dropped(t).alias("drop"), tg.spans(pro).alias("spans"),
            tg.tags_of_spans(tg.spans(pro), F.size("tags")).alias("back"), tg.bio_to_bioes(pro).alias("bioes"), tg.bioes_to_bio(tg.bio_to_bioes(pro)).alias("bio"),
            tg.is_valid_sequence(tg.bio_to_bioes(pro), True).alias("bioes_valid"),
        ).collect()
    }
    for i, tags in enumerate(every):
        r = got[i]
        assert r["valid"] == (promote(tags) == tags)
        assert r["pro"] == promote(tags)
        assert r["drop"] == drop(tags)
        assert [(s["label"], s["start"], s["end"]) for s in r["spans"]] == spans(promote(tags))
        assert r["back"] == r["pro"] == r["bio"]
        assert r["bioes_valid"]


def test_empty_and_null(spark):
    df = spark.createDataFrame([(1, []), (2, None)], "id int, tags array<string>")
    got = {r["id"]: r for r in df.select("id", tg.promoted(F.col("tags")).alias("p"), tg.spans(F.col("tags")).alias("s"), tg.is_valid_sequence(F.col("tags")).alias("v")).collect()}
    assert got[1]["p"] == [] and got[1]["s"] == [] and got[1]["v"]
    assert got[2]["p"] is None and not got[2]["v"]


def test_partial_credit(spark):
    import random

    rng = random.Random(3)
    data = []
    for i in range(150):
        pair = []
        for _ in range(2):
            cuts = sorted(rng.sample(range(12), 6))
            pair.append([(rng.choice("xy"), a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True)])
        data.append((i, *pair))
    df = spark.createDataFrame(data, f"id int, g {tg.SPANS}, p {tg.SPANS}")
    got = {r["id"]: r for r in df.select("id", tg.partial_credit(F.col("g"), F.col("p")).alias("c"), tg.strict_credit(F.col("g"), F.col("p")).alias("s")).collect()}
    for i, g, p in data:
        assert abs(got[i]["c"] - partial(g, p)) < 1e-12
        assert got[i]["s"] == len(set(g) & set(p))


def test_golden_credit(spark):
    df = spark.createDataFrame([([("city", 0, 2), ("day", 3, 4)], [("city", 0, 2), ("day", 3, 5)]), ([("city", 0, 4)], [("city", 0, 2), ("city", 3, 4)])], f"g {tg.SPANS}, p {tg.SPANS}")
    assert [r[0] for r in df.select(tg.partial_credit(F.col("g"), F.col("p"))).collect()] == [1.5, 0.5]


def test_frame_span_tags(spark):
    df = spark.createDataFrame([(["B-x", "I-x", "O", "B-y"], [-1, 0, -1, 1, 2, -1])], "t array<string>, f array<bigint>")
    assert df.select(tg.frame_span_tags(F.col("t"), F.col("f"))).first()[0] == ["O", "B-x", "I-x", "I-x", "O", "O"]
