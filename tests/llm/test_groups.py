"""Operators across texts, and the pipeline, against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("brightloom.llm.queries")
P = pytest.importorskip("public_tokenizers")

DATA = "/root/testdata/sf0.001"


def words(t, lower=True):
    t = t or ""
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if lower and "A" <= c <= "Z" else c for c in t))


def brute_components(rows, size, percent=80):
    sets = {}
    for i, t in rows:
        w = words(t)
        k = min(size, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held, ids = defaultdict(list), sorted(sets)
    for i in ids:
        common = Counter(j for g in sets[i] for j in held[g])
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in sets[i]:
            held[g].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.fixture(scope="module")
def near_texts():
    rng = random.Random(8)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, "one two"), (4, " \n")]
    for i in range(5, 70):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w).upper() if i % 7 == 0 else " ".join(w)))
    for i in range(70, 90):
        rows.append((i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(60))))
    rows += [(i, rows[80][1]) for i in range(90, 110)]
    return rows


def test_near_duplicates(spark, near_texts):
    from brightloom.llm.neardup import deduplicated, near_duplicates

    df = spark.createDataFrame([(*r, "s") for r in near_texts], "doc_id int, text string, kept string")
    want = brute_components(near_texts, 4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, 4).collect()}
    assert got == want
    assert len({v for v in want.values()}) < len(near_texts) - 20
    want5 = brute_components(near_texts, 5)
    left = deduplicated(df)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, (_, c) in want5.items() if i == c)


def test_near_duplicates_of_odd_tables(spark):
    from brightloom.llm.neardup import deduplicated, near_duplicates

    t = " ".join(f"a{i}" for i in range(40))
    df = spark.createDataFrame([(None, t), (7, t), (7, t), (3, t), (None, None), (9, "")], "doc_id int, text string")
    got = near_duplicates(df).collect()
    assert len(got) == 6 and {r["component_id"] for r in got if r["n_shingles"]} == {3}
    assert sum(r["stays"] for r in got) == 3 and sum(r["kept"] for r in got if r["n_shingles"]) == 1
    same = spark.createDataFrame([(7, t), (7, t)], "doc_id int, text string")
    assert deduplicated(same).count() == 1
    assert near_duplicates(df.limit(0)).count() == 0 and deduplicated(df.limit(0)).count() == 0


def test_components(spark):
    from brightloom.llm.components import components

    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 60)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    root = {v: v for e in edges for v in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {v for a, b in edges if a != b for v in (a, b)}
    got = {r["v"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {v: find(v) for v in linked}


def brute_lines(rows, least=50):
    """Maximal runs by definition: every run of enough words that stood earlier loses its lines."""
    lines = [(i, (t or "").split("\n") if t else []) for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))]
    first, gone = {}, defaultdict(set)
    for d, (_, l) in enumerate(lines):
        for s in range(len(l)):
            n = 0
            for e in range(s, len(l)):
                n += len(words(l[e], False))
                if n >= least:
                    key = tuple(l[s : e + 1])
                    if key in first and first[key] < (d, s):
                        gone[d] |= set(range(s, e + 1))
                    else:
                        first.setdefault(key, (d, s))
    return [(i, None if not l and t is None else "\n".join(x for k, x in enumerate(l) if k not in gone[d])) for d, ((i, l), (_, t)) in enumerate(zip(lines, sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), strict=True))]


def test_line_dedup(spark):
    from brightloom.llm.linededup import dedup_lines

    rng = random.Random(4)
    pool = [" ".join(f"t{rng.randrange(50)}" for _ in range(rng.choice([0, 3, 8, 20, 60]))) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\n".join(["one two"] * 80)), (None, rows[3][1])]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "doc_id int, text string, rid int, n_lines int")
    got = sorted(((r["doc_id"], r["text"]) for r in dedup_lines(df).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert got == brute_lines(rows)
    assert dedup_lines(df.limit(0)).count() == 0


def check_shards(rows, got, shards=16):
    """Sizes, checksums, balance and slots against the texts themselves."""
    crc = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, *crc(t)) for i, t in rows)
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(shards)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))


def test_sharding(spark):
    from brightloom.llm.sharding import shards_by_labels

    rng = random.Random(6)
    texts = [f"g{rng.randrange(60)}" if i % 3 else f"s{i}" for i in range(900)] + ["hot"] * 450 + [None, None, ""]
    rng.shuffle(texts)
    rows = [(None if i == 5 else i // 2 * 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id int, text string, shard string")
    got = shards_by_labels(df).collect()
    check_shards(rows, got)
    groups = defaultdict(Counter)
    for r in got:
        groups[r["size"], r["text_crc32"]][r["shard"]] += 1
    small = [c for c in groups.values() if 1 < sum(c.values()) < 40]
    assert sum(len(c) == 1 for c in small) >= 0.9 * len(small)
    assert shards_by_labels(df.limit(0)).count() == 0 and [r["shard"] for r in shards_by_labels(df.limit(1)).collect()] == [0]


@pytest.mark.parametrize("groups, single, most_cut", [([3_300] + [5] * 900, 2_200, 12), ([200] * 5 + [4] * 1_000, 200, 20), ([2] * 2_000, 100, 60)])
def test_sharding_keeps_groups_together_when_shards_are_full(spark, groups, single, most_cut):
    """One group of several shards' size, some of a shard's, and many small ones, with little room beside them."""
    from brightloom.llm.sharding import cut_edges, shards_by_labels
    from pyspark.sql import functions as F

    texts = [f"g{k}" for k, n in enumerate(groups) for _ in range(n)] + [f"s{i}" for i in range(single)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = shards_by_labels(df.repartition(3)).collect()
    check_shards(rows, got)
    at = {r["doc_id"]: r["shard"] for r in got}
    parts = defaultdict(set)
    for i, t in rows:
        parts[t].add(at[i])
    size, share = Counter(texts), len(rows) // 16
    cut = [t for t, p in parts.items() if size[t] > 1 and len(p) > (1 if size[t] <= share else -(-size[t] // (share // 2)))]
    assert len(cut) <= most_cut, (len(cut), len(groups))
    again = {r["doc_id"]: r["shard"] for r in shards_by_labels(df.repartition(7, F.rand(5))).collect()}
    assert again == at
    placed = spark.createDataFrame([(t, at[i], i % 16) for i, t in rows], "text string, shard int, before int")
    after, before = (cut_edges(placed, ["text"], c).first() for c in ("shard", "before"))
    brute = sum(n * (n - 1) // 2 for n in size.values())
    inside = sum(n * (n - 1) // 2 for n in Counter((t, at[i]) for i, t in rows).values())
    assert (after["pairs"], after["cut"]) == (brute, brute - inside) and after["cut"] < before["cut"]


def test_sharding_by_columns_and_edges(spark):
    """Links by either of two columns, and by an edge table that joins whole groups."""
    from brightloom.llm.sharding import shards_by_labels

    rng = random.Random(3)
    rows = [(i, f"t{i}", f"h{i // 4}" if i < 400 else None, f"u{i // 8}" if i < 300 else None) for i in range(1_600)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id int, text string, host string, user string")
    got = shards_by_labels(df, links=["host", "user"]).collect()
    check_shards([r[:2] for r in rows], got)
    at = {r["doc_id"]: r["shard"] for r in got}
    assert sum(at[i] == at[i // 8 * 8] for i in range(296)) > 0.8 * 296 and sum(at[i] == at[i // 4 * 4] for i in range(400)) > 0.85 * 400
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 400) if i % 10 != 9], "a int, b int")
    got = shards_by_labels(df.drop("host"), links=[], edges=chain).collect()
    check_shards([r[:2] for r in rows], got)
    at = {r["doc_id"]: r["shard"] for r in got}
    assert sum(at[a] == at[b] for a, b in ((i, i + 1) for i in range(400) if i % 10 != 9)) > 0.5 * 360  # 1 in 16 by chance


def test_sql_of_queries(spark):
    duckdb = pytest.importorskip("duckdb")
    from brightloom.llm import queries, sql

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    for name, text in sql.oracle_sql().items():
        df = queries.queries()[name](spark, DATA)
        columns = sorted(df.columns)
        found = con.execute(text)
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(str(r[names.index(c)]) for c in columns) for r in found.fetchall()), name


def test_pipeline(spark):
    """Each stage on its own input against a plain version of what it promises."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in cp.STAGES:
        from brightloom.llm.common import stored

        before = docs.collect() if docs.columns == columns else []
        docs = stored(stage(spark, docs, DATA), name)
        after = docs.collect()
        seen.append(name)
        ids = {r["doc_id"] for r in after}
        if name == "quality_rules":
            assert docs.columns == columns and ids < {r["doc_id"] for r in before} and all(len(words(r["text"])) >= 50 for r in after)
        elif name == "line_dedup":
            want = dict(brute_lines([(r["doc_id"], r["text"]) for r in before]))
            assert docs.columns == columns and {r["doc_id"]: r["text"] for r in after} == {i: t for i, t in want.items() if t} and all(r["n_chars"] == len(r["text"]) for r in after)
        elif name == "near_dedup":
            want = brute_components([(r["doc_id"], r["text"]) for r in before], 5)
            assert docs.columns == columns and ids == {i for i, (_, c) in want.items() if i == c}
        elif name == "secret_scan":
            assert docs.columns == columns and len(after) == len(before) and not any(re.search(r"[0-9a-f]{24}", r["text"]) for r in after)
        else:
            assert ids == {r["doc_id"] for r in before}
    assert seen == ["quality_rules", "line_dedup", "near_dedup", "secret_scan", "packing"] and cp.ORACLE_SQL is None


def test_pipeline_on_odd_tables(spark):
    import corpus_pipeline as cp

    long = "The cat and the dog sat on it. " + " ".join(f"word{i}" for i in range(300))
    rows = [(None, long, None, None, None, "a"), (1, long, "en", "s", 1, "b"), (1, long, "en", "s", 1, "b"), (2, None, None, None, None, None), (3, "", "", "", 0, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string")
    for table, n in ((df, 1), (df.limit(0), 0)):
        docs = table
        for _, stage in cp.STAGES[:-1]:
            docs = stage(spark, docs, DATA)
            assert docs.columns == df.columns
        assert docs.count() == n
        assert cp.STAGES[-1][1](spark, docs, DATA).count() == n


def test_scratch_folders_go(spark):
    import os

    from brightloom.llm.common import scratch, scratch_dir, stored

    outside = scratch_dir(spark)
    with scratch(spark):
        inside = scratch_dir(spark).removeprefix("file:").replace("//", "/")
        assert stored(spark.range(3), "x").count() == 3 and os.path.isdir(inside)
    assert not os.path.exists(inside) and scratch_dir(spark) == outside


def test_columns_that_clash_with_inner_names(spark):
    """Columns named like the operators' own, and with dots, come through unchanged."""
    from brightloom.llm.linededup import dedup_lines
    from brightloom.llm.neardup import deduplicated
    from brightloom.llm.quality import quality
    from brightloom.llm.secrets import redact, scan

    inner = ["_words", "_lines", "_rid", "_order", "_cuts", "_k", "_key", "_rules", "_doc", "_", "a.b", "_stay", "_t"]
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{text} x{i}" if i else None, *[f"{c}{i}" for c in inner]) for i in range(3)]
    df = spark.createDataFrame(rows, ["doc_id", "text", *inner])
    for out in (quality(df), dedup_lines(df), scan(df), redact(df), deduplicated(df)):
        assert set(df.columns) <= set(out.columns)
        for r in out.collect():
            assert all(r[c] == f"{c}{r['doc_id']}" for c in inner)
