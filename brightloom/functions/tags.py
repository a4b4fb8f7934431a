"""Label sequences as Column functions over array<string>: no user functions, one row at a time.

Spans are struct<label, start, end>, half open. Sequences are bounded (an
utterance has at most 1000 tokens), so in-row array functions suit them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brightloom.functions.arrays import let

TAG = r"^(?:O|[BI]-[a-z][a-z0-9]*(?:-[a-z0-9]+)*)\z"
TAG_BIOES = r"^(?:O|[BIES]-[a-z][a-z0-9]*(?:-[a-z0-9]+)*)\z"
SPANS = "array<struct<label:string,start:int,end:int>>"


def prefix(tag: Column) -> Column:
    return F.substring(tag, 1, 1)


def slot(tag: Column) -> Column:
    """The label of a tag; null for O."""
    return F.when(tag != "O", F.substring(tag, 3, 1 << 20))


def format_tag(kind: Column, label: Column) -> Column:
    return F.when(kind == "O", F.lit("O")).otherwise(F.concat(kind, F.lit("-"), label))


def is_valid_tag(tag: Column, bioes: bool = False) -> Column:
    return F.coalesce(tag.rlike(TAG_BIOES if bioes else TAG), F.lit(False))


def _before(tags: Column, i: Column) -> Column:
    return F.coalesce(F.get(tags, i - 1), F.lit("O"))


def _after(tags: Column, i: Column) -> Column:
    return F.coalesce(F.get(tags, i + 1), F.lit("O"))


def _continues(a: Column, b: Column, starts: tuple[str, ...]) -> Column:
    """Whether tag ``b`` continues the span that tag ``a`` is in."""
    return prefix(a).isin(*starts) & (F.substring(a, 3, 1 << 20) == F.substring(b, 3, 1 << 20))


def is_valid_sequence(tags: Column, bioes: bool = False) -> Column:
    """Each tag is legal and follows a tag it may follow; with BIOES open spans also end."""
    return F.coalesce(let(tags, lambda t: _valid(t, bioes)), F.lit(False))


def first_invalid(tags: Column) -> Column:
    """The place of the first BIO tag that is illegal or may not follow the one before it; -1 if there is none."""

    def bad(t: Column) -> Column:
        at = F.transform(t, lambda x, i: F.struct(x.alias("t"), _before(t, i).alias("p")))
        wrong = F.transform(at, lambda x: ~(is_valid_tag(x["t"]) & ((prefix(x["t"]) != "I") | _continues(x["p"], x["t"], ("B", "I")))))
        return F.array_position(wrong, True).cast("int") - 1

    return let(tags, bad)


def _valid(tags: Column, bioes: bool) -> Column:
    legal = F.forall(tags, lambda t: is_valid_tag(t, bioes))
    at = F.transform(tags, lambda t, i: F.struct(t.alias("t"), _before(tags, i).alias("p"), _after(tags, i).alias("n")))
    if not bioes:
        good = F.forall(at, lambda x: (prefix(x["t"]) != "I") | _continues(x["p"], x["t"], ("B", "I")))
    else:
        inner = lambda x: ~prefix(x["t"]).isin("I", "E") | _continues(x["p"], x["t"], ("B", "I"))
        ends = lambda x: ~prefix(x["t"]).isin("B", "I") | (prefix(x["n"]).isin("I", "E") & _continues(x["t"], x["n"], ("B", "I")))
        good = F.forall(at, lambda x: inner(x) & ends(x))
    return legal & good


def promoted(tags: Column) -> Column:
    """Repair by promotion: an I that continues nothing begins a span. Only the tag before counts."""
    stray = lambda a, t, i: (prefix(t) == "I") & ~_continues(_before(a, i), t, ("B", "I"))
    return let(tags, lambda a: F.transform(a, lambda t, i: F.when(stray(a, t, i), F.concat(F.lit("B-"), F.substring(t, 3, 1 << 20))).otherwise(t)))


def dropped(tags: Column) -> Column:
    """Repair by dropping: an I outside an open span of its label becomes O and leaves none open."""
    start = F.struct(F.lit(None).cast("string").alias("open"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        stray = (prefix(t) == "I") & ~acc["open"].eqNullSafe(slot(t))
        return F.struct(
            F.when(~stray, slot(t)).alias("open"), F.concat(acc["out"], F.array(F.when(stray, F.lit("O")).otherwise(t))).alias("out")
        )

    return F.aggregate(tags, start, step, lambda acc: acc["out"])


def repaired(tags: Column, policy: str = "strict") -> Column:
    """``strict``: null where the sequence isn't valid; ``drop`` and ``promote`` repair it."""
    if policy == "promote":
        return promoted(tags)
    if policy == "drop":
        return dropped(tags)
    if policy == "strict":
        return F.when(is_valid_sequence(tags), tags)
    raise ValueError(f"unknown policy {policy!r}")


def spans(tags: Column) -> Column:
    """Spans of a valid BIO sequence; neighbours of one label stay apart."""
    # Between two tags other than I lies the run of I's that the first of them goes on with.
    not_i = lambda a: F.filter(F.transform(a, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: prefix(x["t"]) != "I")

    def spans_of(a: Column, marked: Column) -> Column:
        end = lambda k: F.coalesce(F.get(marked, k + 1)["i"], F.size(a)).cast("int")
        each = F.transform(marked, lambda x, k: F.struct(x["t"].alias("t"), x["i"].alias("i"), end(k).alias("end")))
        begun = F.filter(each, lambda x: prefix(x["t"]) == "B")
        return F.transform(begun, lambda x: F.struct(F.substring(x["t"], 3, 1 << 20).alias("label"), x["i"].cast("int").alias("start"), x["end"].alias("end")))

    return let(tags, lambda a: let(not_i(a), lambda m: spans_of(a, m)))


def tags_of_spans(found: Column, n_tokens: Column) -> Column:
    """The BIO sequence of sorted disjoint spans."""

    def tag(f: Column, i: Column) -> Column:
        over = F.filter(f, lambda s: (s["start"] <= i) & (i < s["end"]))
        kind = F.when(F.get(over, F.lit(0))["start"] == i, F.lit("B-")).otherwise(F.lit("I-"))
        return F.when(F.size(over) == 0, F.lit("O")).otherwise(F.concat(kind, F.get(over, F.lit(0))["label"]))

    every = let(found, lambda f: F.transform(F.sequence(F.lit(0), n_tokens - 1), lambda i: tag(f, i)))
    return F.when(n_tokens > 0, every).otherwise(F.array().cast("array<string>"))


def bio_to_bioes(tags: Column) -> Column:
    def change(a: Column, t: Column, i: Column) -> Column:
        last = prefix(_after(a, i)) != "I"
        kind = F.when((prefix(t) == "B") & last, F.lit("S")).when((prefix(t) == "I") & last, F.lit("E")).otherwise(prefix(t))
        return F.when(t == "O", t).otherwise(F.concat(kind, F.lit("-"), F.substring(t, 3, 1 << 20)))

    return let(tags, lambda a: F.transform(a, lambda t, i: change(a, t, i)))


def bioes_to_bio(tags: Column) -> Column:
    return F.transform(tags, lambda t: F.regexp_replace(F.regexp_replace(t, "^S-", "B-"), "^E-", "I-"))


def strict_credit(gold: Column, pred: Column) -> Column:
    """Equal spans; spans of one sequence are distinct."""
    return F.size(F.array_intersect(gold, pred)).cast("double")


def partial_credit(gold: Column, pred: Column) -> Column:
    """Overlap over union of spans with one label, best pairs first, each span once; ties by gold, then pred place."""
    numbered = lambda a: F.transform(a, lambda s, i: F.struct(s.alias("s"), i.alias("i")))

    def pair(g: Column, p: Column) -> Column:
        shared = F.least(g["s"]["end"], p["s"]["end"]) - F.greatest(g["s"]["start"], p["s"]["start"])
        union = F.greatest(g["s"]["end"], p["s"]["end"]) - F.least(g["s"]["start"], p["s"]["start"])
        worth = F.when((g["s"]["label"] == p["s"]["label"]) & (shared > 0), -shared / union)
        return F.struct(worth.alias("n"), g["i"].alias("g"), p["i"].alias("p"))

    grid = let(numbered(pred), lambda ps: F.flatten(F.transform(numbered(gold), lambda g: F.transform(ps, lambda p: pair(g, p)))))
    pairs = F.sort_array(F.filter(grid, lambda x: x["n"].isNotNull()))
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("g"), none.alias("p"), F.lit(0.0).alias("c"))

    def take(acc: Column, x: Column) -> Column:
        free = ~F.array_contains(acc["g"], x["g"]) & ~F.array_contains(acc["p"], x["p"])
        new = F.struct(F.concat(acc["g"], F.array(x["g"])).alias("g"), F.concat(acc["p"], F.array(x["p"])).alias("p"), (acc["c"] - x["n"]).alias("c"))
        return F.when(free, new).otherwise(acc)

    return F.aggregate(pairs, start, take, lambda acc: acc["c"])


def frame_tags(tags: Column, frame_tokens: Column) -> Column:
    """Token tags lifted to frames; -1 is a gap."""
    return let(tags, lambda a: F.transform(frame_tokens, lambda k: F.when(k < 0, F.lit("O")).otherwise(F.get(a, k.cast("int")))))


def frame_span_tags(tags: Column, frame_tokens: Column) -> Column:
    """Each token span as one frame span, from its first covered frame to its last, gaps included."""
    placed = F.transform(frame_tokens, lambda k, i: F.struct(k.alias("k"), i.alias("i")))

    def lifted(s: Column, at: Column) -> Column:
        over = F.transform(F.filter(at, lambda x: (x["k"] >= s["start"]) & (x["k"] < s["end"])), lambda x: x["i"])
        return F.struct(s["label"].alias("label"), F.array_min(over).alias("start"), (F.array_max(over) + 1).alias("end"))

    found = F.filter(let(placed, lambda at: F.transform(spans(tags), lambda s: lifted(s, at))), lambda s: s["start"].isNotNull())
    return tags_of_spans(found, F.size(frame_tokens))
