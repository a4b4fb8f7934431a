"""Quality rules: a threshold table compiled into one Spark projection.

Every rule compares integers (``scale * measure`` against ``bound * base``), so
a verdict never depends on floating point. No user function runs: words,
repeated windows and lines come from regular expressions and array functions,
and the table turns into one boolean expression.

Defined results: a null text has no words and fails the base rules, as do an
empty text and one of white space only. Rows are kept as they come: repeated
rows and null ids stay, other columns pass through unless they bear the name
of a result column, in which case the result replaces them. An empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.llm.common import boxed, let, require, words

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = tuple(
    "the of and to in is that it for with as was on are by this be at from an "
    "der die und den von zu das mit sich des auf ist nicht ein eine als auch "
    "le la les de et en un une du que qui est dans pour par sur au pas "
    "el los las y una con se es del al su lo".split()
)
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Rejects a text where ``scale * measure`` is above (or below) ``bound * base``."""

    name: str
    measure: str
    base: str | None
    scale: int
    bound: int
    above: bool = True

    def broken(self) -> Column:
        left = F.col(self.measure) * self.scale
        right = F.lit(self.bound) * (F.col(self.base) if self.base else F.lit(1))
        return left > right if self.above else left < right


#: Base rules come first; the rest is the method's verdict.
BASE_RULES = (
    Rule("too_short", "n_words", None, 1, 50, above=False),
    Rule("repeated_windows", "n_repeat_words", "n_words", 100, 50),
)
RULES = (
    Rule("too_long", "n_words", None, 1, 1_000_000),
    Rule("short_words", "word_chars", "n_words", 1, 2, above=False),
    Rule("long_words", "word_chars", "n_words", 1, 12),
    Rule("symbols", "n_symbols", "n_words", 100, 20),
    Rule("stop_words", "n_stop_words", None, 1, 2, above=False),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 100, 60),
    Rule("bullets", "n_bullet_lines", "n_lines", 100, 90),
    Rule("ellipses", "n_ellipsis_lines", "n_lines", 100, 50),
    Rule("no_letters", "n_letter_words", "n_words", 100, 60, above=False),
)
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
    "n_stop_words", "n_bullet_lines", "n_ellipsis_lines", "n_letter_words",
)


def _repeat_words(w: Column, n: Column) -> Column:
    """Words inside windows of three words that the text holds twice or more.

    Hashes of the windows are sorted with their places; equal neighbours are
    repeats. Texts without any repeat stop at the distinct count.
    """
    hashes = F.when(
        n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    )

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, i, x: F.get(s, i)["h"] == x["h"]
        flagged = let(
            placed,
            lambda s: F.filter(
                s, lambda x, i: F.coalesce(same(s, i - 1, x), F.lit(False)) | F.coalesce(same(s, i + 1, x), F.lit(False))
            ),
        )
        spans = F.flatten(F.transform(flagged, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.size(F.array_distinct(spans))

    count = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))
    return F.when(n >= 3, count).otherwise(F.lit(0))


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``MEASURES`` (long)."""
    require(docs, text)
    kept = [c for c in docs.columns if c not in MEASURES]
    body = F.coalesce(F.col(text), F.lit(""))
    staged = boxed(docs.select(*[F.col(f"`{c}`") for c in kept]), text).select(
        text,
        "_doc",
        words(F.col(text)).alias("_words"),
        F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    w, lines = F.col("_words"), F.col("_lines")
    n = F.size(w)
    count = lambda a, f: F.size(F.filter(a, f)).cast("long")
    bare = lambda x: F.lower(F.regexp_replace(x, r"^[.,;:!?\"'()]+|[.,;:!?\"'()]+$", ""))
    measured = staged.select(
        text,
        "_doc",
        n.cast("long").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        "n_symbols",
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(w, n).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        count(w, lambda x: bare(x).isin(*STOP_WORDS)).alias("n_stop_words"),
        count(lines, lambda x: x.rlike(r"^\s*[-*•]")).alias("n_bullet_lines"),
        count(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*$")).alias("n_ellipsis_lines"),
        count(w, lambda x: x.rlike(r"\p{L}")).alias("n_letter_words"),
    )
    # Only now, as the names of other columns could be taken for the staged ones.
    return measured.select(*[F.col(c) if c == text else F.col(f"_doc.`{c}`").alias(c) for c in kept], *MEASURES)


def quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the measures, ``base_failed``, ``kept`` and ``broken_rules`` (names, in table order)."""
    results = {*MEASURES, "base_failed", "kept", "broken_rules"}
    measured = with_measures(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in results or c == text]), text)
    any_of = lambda table: F.lit(False) if not table else F.greatest(F.lit(False), *[r.broken() for r in table])
    names = F.array_compact(F.array(*[F.when(r.broken(), F.lit(r.name)) for r in (*BASE_RULES, *rules)]))
    # Always true; a filter on ``kept`` isn't pushed below a column that Spark takes for nondeterministic. Pushed down,
    # it would carry the words' expression into lambda functions, to be computed again for each word.
    here = F.monotonically_increasing_id() >= 0
    return measured.withColumns(
        {"base_failed": any_of(BASE_RULES), "kept": ~any_of((*BASE_RULES, *rules)) & here, "broken_rules": names}
    )
