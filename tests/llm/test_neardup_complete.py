"""Near-duplicate links that passes with pivots alone do not meet."""

import itertools
import random

import pytest

pytest.importorskip("brightloom.llm.queries")
from test_groups import brute_components  # noqa: E402


def noisy_family(n, share, seed, words=120):
    rng, fresh = random.Random(seed), itertools.count()
    base = [f"b{i}" for i in range(words)]
    return [(i, " ".join(f"x{next(fresh)}" if rng.random() < share else w for w in base)) for i in range(n)]


@pytest.mark.parametrize("block, shingles", [(1024, 1_000_000), (40, 1_000_000), (1024, 3_000)])
def test_no_link_of_a_noisy_family_is_lost(spark, monkeypatch, block, shingles):
    """Copies of one text with a twentieth of the words replaced: most pairs are just below the threshold.

    With small blocks the family's buckets are larger than a block, so pivots come first and cells meet in twos.
    """
    from brightloom.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", shingles)
    rows = noisy_family(500, 0.05, 1)
    want = {i: c for i, (_, c) in brute_components(rows, 4).items()}
    assert 20 < len(set(want.values())) < 480
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, 4).collect()}
    assert got == want


def test_a_large_linked_group_needs_no_cells(spark, monkeypatch):
    """Members that a pivot has linked are one component: the cells have nothing to compare."""
    from brightloom.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK", 16)
    rows = noisy_family(120, 0.005, 2, 200)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string"), 4).collect()
    assert {r["component_id"] for r in got} == {0}


def test_each_pair_across_components_shares_a_cell(spark):
    """A group of one cell, one of large and small components, and one of small components only."""
    from pyspark.sql import functions as F

    from brightloom.llm.neardup import _dealt

    rows = [(1, v, v // 2) for v in range(12)] + [(2, 100 + v, 100 if v < 70 else 170 if v < 100 else 170 + v // 3) for v in range(130)] + [(3, 400 + v, 400 + v) for v in range(50)]
    members = spark.createDataFrame(rows, "g bigint, v bigint, r bigint")
    cells = {}
    for r in _dealt(members, F.lit(1 / 16)).collect():
        assert r["at"] in (r["lo"], r["hi"])
        cells.setdefault((r["g"], r["lo"], r["hi"]), []).append((r["v"], r["r"], r["at"]))
    met = set()
    for (_, lo, hi), held in cells.items():
        assert len({v for v, _, _ in held}) == len(held) <= 80  # two blocks of about 16, dealt by hash
        met |= {tuple(sorted((a, b))) for a, ra, ta in held for b, rb, tb in held if ra != rb and (lo == hi or ta != tb)}
    want = {tuple(sorted((a, b))) for g, a, ra in rows for h, b, rb in rows if g == h and ra != rb}
    assert met == want
    big = [held for held in cells.values() if {r for _, r, _ in held} == {100}]
    assert not big  # the component of 70 isn't compared with itself


def test_long_texts_and_hot_copies(spark):
    """A text of 200,000 words beside a near copy, and one text that is most of the rows."""
    from brightloom.llm.neardup import near_duplicates

    long = [f"w{i}" for i in range(200_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:190_000])), (3, " ".join(long[:100_000]))]
    rows += [(10 + i, "one two three four five six seven") for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(8)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, 4).collect()}
    assert got == {1: 1, 2: 1, 3: 3} | {10 + i: 10 for i in range(3_000)}
