"""Sharding by balanced label propagation, in DataFrame functions only.

Documents are linked by equal texts, by equal values of any of some columns, or
by an edge table. Those with the same link keys are a unit. All start where
their hash puts them. Units too large for quotas, of which there are at most
``CLASSES`` a shard, are packed first, the largest first, each where most of it
already is if it fits. Then rounds move units to the shard where most of their
neighbours are: one aggregation of (unit, shard) counts, with more than one link
column one join to the counts of its keys, and a table of 16 x 64 sums from
which the driver sets quotas. It begins with all moves of the round, so that
shards exchange rows even when full, and takes back classes of moves until no
shard is over its capacity; what found no room looks for open shards in the next
round. Groups larger than half a shard are blocks of their own, so no group is
ever in one task. Documents without links fill what is left: from counts by shard
alone it follows which rows stay and where the surplus goes, so that row counts
differ by one at most. ``cut_edges`` measures what the shards cut.

Law ``rows``: counts at most one apart. Defined results: a null text has size 1,
checksum 0 and is linked with other nulls only; an empty text likewise with
empty ones; a null in a link column links nothing. Repeated rows and null ids
are rows like others. An empty table gives an empty result. Other columns are
left behind. The same rows get the same shards however they are partitioned, but
for rows that repeat with their id in groups of over half a shard.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.llm.common import discard, ranked, require, small, stored

#: Quotas are set for so many classes of units by target shard; units of more than a shard's share of that are packed.
CLASSES = 64
ROUNDS = 10
UNIT = ["u1", "u2"]


def _admitted(flows: list, held: list[int], capacity: list[int]) -> list[int]:
    """The codes target * CLASSES + class of moves that the quotas admit; ``held`` is updated.

    ``flows``: rows (cls, shard, target, n). All move at first; the moves into
    the fullest shard that suffice, or else the most, are taken back until none
    holds more than its capacity or nothing more can be taken back.
    """
    cells: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in flows:
        cells.setdefault((r["target"], r["cls"]), []).append((r["shard"], r["n"]))
    total = {c: sum(n for _, n in parts) for c, parts in cells.items()}

    def move(cell: tuple[int, int], sign: int) -> None:
        held[cell[0]] += sign * total[cell]
        for source, n in cells[cell]:
            held[source] -= sign * n

    for c in cells:
        move(c, 1)
    while over := [t for t in range(len(held)) if held[t] > capacity[t] and any(c[0] == t for c in cells)]:
        t = max(over, key=lambda t: held[t] - capacity[t])
        into = sorted((c for c in cells if c[0] == t), key=lambda c: (total[c], c))
        back = next((c for c in into if total[c] >= held[t] - capacity[t]), into[-1])
        move(back, -1)
        del cells[back]
    return sorted(target * CLASSES + cls for target, cls in cells)


def _packed(counts: dict[tuple, dict[int, int]], capacity: list[int]) -> tuple[dict[tuple, int], list[int]]:
    """A shard for each large unit (its counts by shard), the largest first, and the room that is left."""
    room, out = [*capacity], {}
    for unit, by in sorted(counts.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        n = sum(by.values())
        fits = [s for s in range(len(room)) if room[s] >= n]
        if fits:
            out[unit] = max(fits, key=lambda s: (by.get(s, 0), room[s], -s))
            room[out[unit]] -= n
    return out, room


def _votes(hist: DataFrame, keys: DataFrame | None) -> DataFrame:
    """(unit, shard, n): a unit's rows, or with ``keys``, the link keys of each unit, its neighbours by shard.

    Rows of the unit itself count only while it is in several shards.
    """
    if keys is None:
        return hist
    named = keys.select(*[F.col(c).alias(f"k_{c}") for c in UNIT], "k1", "k2")
    on = [F.col(c) == F.col(f"k_{c}") for c in UNIT]
    by_key = hist.join(named, on).groupBy("k1", "k2", "shard").agg(F.sum("n").alias("n")).select(F.col("k1").alias("a"), F.col("k2").alias("b"), "shard", "n")
    met = keys.join(by_key, (F.col("k1") == F.col("a")) & (F.col("k2") == F.col("b"))).select(*UNIT, "shard", "n", F.lit(1).alias("keys"), F.lit(0).cast("long").alias("own"))
    own = hist.select(*UNIT, "shard", F.lit(0).cast("long").alias("n"), F.lit(0).alias("keys"), F.col("n").alias("own"))
    sums = met.union(own).groupBy(*UNIT, "shard").agg(F.sum("n").alias("n"), F.sum("keys").alias("keys"), F.sum("own").alias("own"))
    spread = hist.groupBy(*[F.col(c).alias(f"k_{c}") for c in UNIT]).agg((F.min("shard") != F.max("shard")).alias("cut"))
    return sums.join(spread, on).select(*UNIT, "shard", F.when(F.col("cut"), F.col("n")).otherwise(F.col("n") - F.col("keys") * F.col("own")).alias("n"), (F.col("own") > 0).alias("here"))


def _propagated(linked: DataFrame, keys: DataFrame | None, shards: int, capacity: list[int]) -> DataFrame:
    """``linked`` (rid, u1, u2, shard) with shards after the packing and the rounds."""
    state = stored(linked, "labels")
    spark, on = linked.sparkSession, [F.col(c) == F.col(f"w_{c}") for c in UNIT]
    named = [F.col(c).alias(f"w_{c}") for c in UNIT]
    hist = stored(state.groupBy(*UNIT, "shard").agg(F.count(F.lit(1)).alias("n")), "label-counts")
    most = max(1, min(capacity, default=0) // CLASSES)
    large = hist.groupBy(*UNIT).agg(F.sum("n").alias("total")).where(F.col("total") > most).select(*named)
    counts: dict[tuple, dict[int, int]] = {}
    for r in hist.join(large, on, "left_semi").collect():  # at most shards * CLASSES units
        counts.setdefault((r["u1"], r["u2"]), {})[r["shard"]] = r["n"]
    packed, room = _packed(counts, capacity)
    fixed = spark.createDataFrame([(*u, s) for u, s in packed.items()] or [], "w_u1 long, w_u2 long, target int")
    moved = state.join(F.broadcast(fixed), on, "left").select("rid", *UNIT, F.coalesce("target", "shard").alias("shard"), (F.col("target").isNotNull() & F.lit(keys is None)).alias("fixed"))
    room = room if keys is None else capacity  # with several keys a packed unit may still follow its neighbours
    new = stored(moved, "labels")
    discard(state, hist)
    state, full, idle = new, [], 0
    for step in range(ROUNDS):
        held = [0] * shards
        hist = stored(state.groupBy(*UNIT, "shard", "fixed").agg(F.count(F.lit(1)).alias("n")), "label-counts")
        free = hist.where("not fixed").select(*UNIT, "shard", "n")
        for r in free.groupBy("shard").agg(F.sum("n").alias("n")).collect():
            held[r["shard"]] = r["n"]
        open_to = [s for s in range(shards) if s not in full] or list(range(shards))
        usable = F.col("shard").isin(open_to)
        here = F.lit(False) if keys is None else F.col("here")
        best = F.max(F.when(usable | here & F.lit(keys is not None), F.struct("n", here.alias("here"), F.xxhash64(*UNIT, "shard").alias("tie"), "shard")))["shard"]
        other = F.get(F.array(*[F.lit(s) for s in open_to]), F.pmod(F.xxhash64(*UNIT, F.lit(step)), F.lit(len(open_to))).cast("int"))
        votes = _votes(hist.select(*UNIT, "shard", "n"), keys).groupBy(*UNIT).agg(best.alias("best")).select(*named, F.coalesce("best", other).alias("target"))
        places = free.groupBy(*UNIT).agg(F.min("shard").alias("lo"), F.max("shard").alias("hi")).join(votes, on)
        cls = F.pmod(F.xxhash64(*UNIT, F.lit(step)), F.lit(CLASSES)).cast("int")
        # Whole units without other neighbours stay; of those with some, half may move in a round, so that two don't change places.
        turn = F.lit(keys is not None) & (F.pmod(F.xxhash64(*UNIT, F.lit(100 + step)), F.lit(2)) == 0)
        wish = places.where(((F.col("lo") != F.col("hi")) | turn) & ((F.col("lo") != F.col("target")) | (F.col("hi") != F.col("target"))))
        wish = stored(wish.select("w_u1", "w_u2", "target", cls.alias("cls")), "wishes")
        flows = free.join(wish, on).where("shard <> target").groupBy("cls", "shard", "target").agg(F.sum("n").alias("n")).collect()
        codes = _admitted(flows, held, room)
        full = [s for s in range(shards) if held[s] >= room[s] - most]
        discard(hist)
        if codes:
            go = wish.where((F.col("target") * CLASSES + F.col("cls")).isin(codes)).drop("cls")
            moved = state.join(go, on, "left").select("rid", *UNIT, F.coalesce(F.when(~F.col("fixed"), F.col("target")), "shard").alias("shard"), "fixed")
            new = stored(moved, "labels")
            discard(state)
            state = new
        discard(wish)
        idle = 0 if codes else idle + 1
        if idle > (keys is not None) or not flows and keys is None:
            break
    return state


def _keys(docs: DataFrame, links: list[str] | None, edges: DataFrame | None) -> DataFrame:
    """(rid, k1, k2): the link keys of each row."""
    both = lambda *c: (F.xxhash64(*c).alias("k1"), F.xxhash64(F.lit(7), *c).alias("k2"))
    if links is None:
        parts = [docs.select("rid", F.col("t1").alias("k1"), F.col("t2").alias("k2"))]
    else:
        parts = [docs.where(F.col(f"l{i}").isNotNull()).select("rid", *both(F.lit(i), F.col(f"l{i}"))) for i in range(len(links))]
    if edges is not None:
        ends = edges.select(F.explode(F.array("a", "b")).alias("end"), *both(F.lit("edge"), F.least("a", "b"), F.greatest("a", "b"))).distinct()
        parts.append(ends.join(docs.select("rid", "doc_id"), F.col("doc_id") == F.col("end")).select("rid", "k1", "k2"))
    return reduce(DataFrame.union, parts)


def cut_edges(members: DataFrame, keys: list[str], shard: str = "shard") -> DataFrame:
    """One row: pairs of rows that share a key, and how many of them are in different shards."""
    by = members.groupBy(*keys, shard).agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.sum("n").alias("m"), F.sum(F.expr("n * (n - 1) div 2")).alias("inside"))
    pairs = F.coalesce(F.sum(F.expr("m * (m - 1) div 2")), F.lit(0))
    return by.agg(pairs.alias("pairs"), (pairs - F.coalesce(F.sum("inside"), F.lit(0))).alias("cut"))


def _dealt(counts: dict[tuple[int, int], int], shards: int, rows: int) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
    """From counts by (shard, kind; 0 linked, 1 not): what stays and where the surplus goes.

    Lists by shard * 2 + kind: rows that stay, slot of the first, surplus before
    this cell; and by shard: the surplus that earlier shards take, the slot of
    the first newcomer.
    """
    capacity = [rows // shards + (j < rows % shards) for j in range(shards)]
    stay, first, before, taken, slot, surplus, given = [], [], [], [], [], 0, 0
    for j in range(shards):
        used = 0
        for kind in (0, 1):
            n = counts.get((j, kind), 0)
            keep = min(n, capacity[j] - used)
            stay.append(keep)
            first.append(used)
            before.append(surplus)
            surplus += n - keep
            used += keep
        taken.append(given)
        slot.append(used)
        given += capacity[j] - used
    return stay, first, before, taken, slot


def shards_by_labels(docs: DataFrame, shards: int = 16, links: list[str] | None = None, edges: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Documents are linked by equal texts, or by equal values of any column of
    ``links``; and by ``edges``, pairs (a, b) of ids.
    """
    require(docs, "doc_id", "text", *(links or []))
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    text: list[Column] = [F.col("text"), F.col("text").isNull()]
    slim = stored(
        docs.select(
            "doc_id",
            (F.octet_length(raw) + 1).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.xxhash64(*text).alias("t1"),
            F.xxhash64(F.lit(7), *text).alias("t2"),
            F.monotonically_increasing_id().alias("rid"),
            *[F.col(f"`{c}`").alias(f"l{i}") for i, c in enumerate(links or [])],
        ),
        "documents",
    )
    rows = slim.count()
    capacity = [rows // shards + (j < rows % shards) for j in range(shards)]
    home = F.pmod(F.xxhash64("doc_id", "t1"), F.lit(shards)).cast("int")
    members = _keys(slim, links, edges)
    one = edges is None and (links is None or len(links) == 1)
    if not one:
        members = stored(members, "members")
    groups = stored(members.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "groups")
    half = max(1, rows // shards // 2)
    # At most 2 * shards groups of each kind of link are larger than half a shard.
    large = groups.where(F.col("m") > half).select(F.col("k1").alias("l1"), F.col("k2").alias("l2"), F.ceil(F.col("m") / half).cast("int").alias("blocks"))
    names = groups.select(F.col("k1").alias("g1"), F.col("k2").alias("g2"))
    members = members.join(small(names), (F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2")), "left_semi")
    members = members.join(F.broadcast(large), (F.col("k1") == F.col("l1")) & (F.col("k2") == F.col("l2")), "left")
    at = slim.select(F.col("rid").alias("r"), home.alias("shard"), F.xxhash64("doc_id", "t1", F.lit(3)).alias("h"))
    members = members.join(at, F.col("rid") == F.col("r"))
    block = F.coalesce(F.pmod("h", F.col("blocks")), F.lit(0))
    members = members.select("rid", "shard", "k1", F.when(block == 0, F.col("k2")).otherwise(F.xxhash64("k2", block)).alias("k2"))
    if one:
        keys, linked = None, members.select("rid", F.col("k1").alias("u1"), F.col("k2").alias("u2"), "shard")
    else:
        members = stored(members, "members")
        units = stored(members.groupBy("rid").agg(F.bit_xor(F.xxhash64("k1", "k2")).alias("u1"), F.bit_xor(F.xxhash64("k2", "k1")).alias("u2"), F.min("shard").alias("shard")), "units")
        linked = units
        keys = members.select(F.col("rid").alias("r"), "k1", "k2").join(units, F.col("r") == F.col("rid")).select(*UNIT, "k1", "k2").distinct()
        keys = stored(keys, "unit-keys")
    state = _propagated(linked, keys, shards, capacity)
    placed = slim.join(state.select(F.col("rid").alias("r"), F.col("shard").alias("label")), F.col("rid") == F.col("r"), "left")
    # Rows that repeat are told apart by number; in groups that large even their buckets are.
    same = F.xxhash64("doc_id", "t1")
    huge = large.select(F.col("l1").alias("k1"), F.col("l2").alias("k2")) if links is None else None
    placed = placed.join(F.broadcast(huge), (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2")), "left") if huge is not None else placed.withColumn("k1", F.lit(None))
    placed = stored(
        placed.select(
            "doc_id", "size", "text_crc32", F.struct(same.alias("h"), "rid").alias("place"),
            F.xxhash64(same, F.when(F.col("k1").isNotNull(), F.col("rid"))).alias("deal"),
            F.coalesce("label", home).alias("home"), F.when(F.col("label").isNull(), 1).otherwise(0).alias("kind"),
        ),
        "placed",
    )
    counts = {(r["home"], r["kind"]): r["n"] for r in placed.groupBy("home", "kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    stay, first, before, taken, slot = _dealt(counts, shards, rows)
    at = lambda values, i: F.get(F.array(*[F.lit(v).cast("long") for v in values]), i)
    cell = F.col("home") * 2 + F.col("kind")
    nth = ranked(placed, ["home", "kind"], "place", "_nth", rows, "deal")
    stays = F.col("_nth") < at(stay, cell)
    nth = nth.withColumn("_spare", F.when(stays, F.lit(None)).otherwise(at(before, cell) + F.col("_nth") - at(stay, cell)))
    # The surplus is dealt to shards by the last one that begins at or before its number.
    new = F.expr(f"size(filter(array({', '.join(f'{t}L' for t in taken)}), x -> x <= _spare)) - 1")
    nth = nth.withColumn("_new", F.when(F.col("_spare").isNotNull(), new))
    return nth.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.coalesce("_new", "home").cast("int").alias("shard"),
        F.when(F.col("_new").isNull(), at(first, cell) + F.col("_nth")).otherwise(at(slot, F.col("_new")) + F.col("_spare") - at(taken, F.col("_new"))).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
