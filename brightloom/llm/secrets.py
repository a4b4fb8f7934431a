"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is parsed on the driver into a Boolean query of
trigrams that any match must hold. One pass over the texts makes postings
(trigram, document key) for the trigrams that the rules ask for; intersecting
them leaves, for each rule, the documents that may match. Only those run its
expression. A rule without a mandatory trigram (hex runs) scans every text.

The index is exact in one direction: keys are hashes of the id column, trigrams
are taken in lower case, so a document may be a candidate in vain but is never
missed. Candidates are broadcast up to ``BROADCAST_ROWS`` rows, counted first;
beyond that they are joined by a shuffle.

Defined results: a null or empty text has no spans. Rows are kept as they come;
repeated ids or null ids share postings, which only adds candidates. Places are
in code points, the end exclusive. Columns named as results are replaced,
others pass through. An empty table gives an empty result.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.llm.common import boxed, let, require, stored, unboxed

#: Candidates of at most so many rows (16 bytes each) are broadcast.
BROADCAST_ROWS = 250_000
#: Sets of strings larger than this count as unknown in a trigram query.
MOST_STRINGS = 16


@dataclass(frozen=True)
class SecretRule:
    """Matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules, in the order in which kinds are listed, then further ones.
BASE_RULES = (
    SecretRule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20),
    SecretRule("hex", r"[0-9a-f]{24,}", 0, 24),
)
RULES = (
    *BASE_RULES,
    SecretRule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}"),
    SecretRule("url", r"://[A-Za-z0-9._-]+:[A-Za-z0-9._%+-]+@"),
)

# A query is True, a trigram, or ("and" | "or", set of queries).


def _join(op: str, parts: list) -> object:
    parts = list(dict.fromkeys(parts))
    if op == "and":
        parts = [p for p in parts if p is not True]
        if not parts:
            return True
    elif any(p is True for p in parts):
        return True
    return parts[0] if len(parts) == 1 else (op, tuple(parts))


def _of_strings(strings: set[str] | None) -> object:
    """What a text holds that contains one of ``strings``."""
    if strings is None:
        return True
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _parsed(nodes) -> tuple[set[str] | None, object]:
    """All strings that a sequence of nodes can be, if few, and its query."""
    run: set[str] | None = {""}
    whole, queries = True, []
    for op, arg in nodes:
        strings, query = _node(op, arg)
        if strings is not None and run is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a, b in product(run, strings)}
            continue
        queries += [_of_strings(run), query]
        whole, run = False, strings if strings is not None else {""}
    return (run if whole else None), _join("and", [*queries, _of_strings(run)])


def _node(op, arg) -> tuple[set[str] | None, object]:
    if op is sre.LITERAL:
        return {chr(arg).lower()}, True
    if op is sre.SUBPATTERN:
        return _parsed(arg[3])
    if op is sre.BRANCH:
        each = [_parsed(x) for x in arg[1]]
        strings = None if any(s is None for s, _ in each) else set().union(*(s for s, _ in each))
        if strings is not None and len(strings) <= MOST_STRINGS:
            return strings, _of_strings(strings)
        return None, _join("or", [_join("and", [q, _of_strings(s)]) for s, q in each])
    if op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= MOST_STRINGS:
        return {chr(c).lower() for _, c in arg}, True
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, sub = arg
        strings, query = _parsed(sub)
        if most == 1 and strings is not None:
            return (strings | {""} if not least else strings), True if not least else query
        if least == most and strings is not None and len(strings) ** least <= MOST_STRINGS:
            return {"".join(p) for p in product(strings, repeat=least)}, True
        return None, _join("and", [query, _of_strings(strings)]) if least else True
    return None, True


def trigram_query(pattern: str) -> object:
    """The Boolean trigram query that every text with a match of ``pattern`` meets, in lower case."""
    strings, query = _parsed(parser.parse(pattern))
    return _join("and", [query, _of_strings(strings)])


def trigrams(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams(q) for q in query[1]))


def _holds(query: object, has) -> Column:
    if isinstance(query, str):
        return has(query)
    return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), [_holds(q, has) for q in query[1]])


def postings(docs: DataFrame, grams: list[str], key: Column, text: str = "text") -> DataFrame:
    """The inverted index for ``grams``: a row (gram: place in ``grams``, key) for each text that holds one."""
    body = F.lower(F.coalesce(F.col(text), F.lit("")))
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(g).alias("g")) for i, g in enumerate(grams)])
    held = let(body, lambda b: F.transform(F.filter(places, lambda p: F.contains(b, p["g"])), lambda p: p["i"]))
    return docs.select(key.alias("key"), F.explode(held).alias("gram"))


def candidates(docs: DataFrame, rules: tuple[SecretRule, ...], key: Column, text: str = "text") -> DataFrame | None:
    """Keys of documents that may match, with a bit for each rule in ``rules``; None where no rule has a trigram."""
    asked = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not True}
    grams = sorted(set().union(*(trigrams(q) for q in asked.values()))) if asked else []
    if not grams:
        return None
    at = {g: i for i, g in enumerate(grams)}
    n_masks = -(-len(grams) // 62)
    bit = lambda k: F.coalesce(F.bit_or(F.when(F.floor(F.col("gram") / 62) == k, F.expr("shiftleft(1L, gram % 62)"))), F.lit(0).cast("long"))
    by_key = postings(docs, grams, key, text).groupBy("key").agg(*[bit(k).alias(f"m{k}") for k in range(n_masks)])
    has = lambda g: F.col(f"m{at[g] // 62}").bitwiseAND(F.lit(1 << at[g] % 62)) != 0
    bits = reduce(lambda a, b: a + b, [F.when(_holds(q, has), F.lit(1 << i)).otherwise(F.lit(0)) for i, q in asked.items()])
    return by_key.select(F.col("key").alias("_key"), bits.cast("long").alias("_rules")).where("_rules <> 0")


def _spans(rule: SecretRule, order: int, text: Column) -> Column:
    """Spans of one rule: its matches lie between the pieces that splitting by it leaves."""
    hits, pieces = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    sized = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda v: F.length(v))
    zipped = F.arrays_zip(
        F.transform(pieces, lambda p: F.length(p)).alias("gap"),
        F.transform(hits, lambda h: F.length(h)).alias("hit"),
        sized.alias("value"),
    )
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        found = F.struct(start.alias("start"), F.lit(order).alias("kind"), (start + x["hit"]).alias("end"))
        out = F.when(x["value"] >= rule.least, F.concat(acc["out"], F.array(found))).otherwise(acc["out"])
        return F.struct((start + F.coalesce(x["hit"], F.lit(0))).cast("long").alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))
    return F.aggregate(zipped, start, step, lambda acc: acc["out"])


def scan(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: array of (start, kind, end), kind being the place in ``rules``, by start, then kind."""
    require(docs, id_column, text)
    columns = [c for c in docs.columns if c != "spans"]
    docs = boxed(docs.select(*[F.col(f"`{c}`") for c in columns]), id_column, text)
    key = F.xxhash64(F.col(id_column))
    found = candidates(docs, rules, key, text)
    if found is not None:
        found = stored(found, "secret-candidates")
        found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
        joined = docs.withColumn("_k", key).join(found, F.col("_k") == F.col("_key"), "left").drop("_k", "_key")
    else:
        joined = docs.withColumn("_rules", F.lit(None).cast("long"))
    body, none = F.coalesce(F.col(text), F.lit("")), F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    each = []
    for i, rule in enumerate(rules):
        if trigram_query(rule.pattern) is True:
            may = body.rlike(rule.pattern)
        else:
            may = F.coalesce(F.col("_rules").bitwiseAND(F.lit(1 << i)) != 0, F.lit(False))
        each.append(F.when(may, _spans(rule, i, body)).otherwise(none))
    kept = [F.col(c) if c in (id_column, text) else F.col(f"_doc.`{c}`").alias(c) for c in columns]
    return joined.select(*kept, F.sort_array(F.concat(*each)).alias("spans"))


def spans_text(spans: Column, rules: tuple[SecretRule, ...] = RULES) -> Column:
    """Spans as kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, mark: str = "[secret]", id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``mark``; overlapping spans give one mark. Nulls stay null."""

    def cut(acc: Column, s: Column) -> Column:
        ahead = s["start"] >= acc["at"]
        gap = F.substring(F.col(text), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        out = F.when(ahead, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    end = lambda acc: F.concat(acc["out"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), F.length(text)))
    clean = F.when(F.size("spans") > 0, F.aggregate("spans", first, cut, end)).otherwise(F.col(text))
    found = scan(boxed(docs, id_column, text), rules, id_column, text).withColumn(text, clean)
    return unboxed(found, docs.columns, id_column, text)
