"""Text functions: normalisation, hashes, grams, tokens, templates, seeds."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from brightloom.core.errors import ValidationError
from brightloom.functions.arrays import let

#: On text of these characters alone, the built-in form of ``normalised`` equals full NFKC and case folding.
SIMPLE = r"^[\x{00}-\x{7F}\x{A1}-\x{A7}\x{A9}\x{AB}\x{AC}\x{AE}\x{B0}\x{B1}\x{B6}\x{B7}\x{BB}\x{BF}-\x{12F}\x{132}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}\x{2010}\x{2012}-\x{2016}\x{2018}-\x{2023}]*\z"


def _full(texts: pd.Series) -> pd.Series:
    import unicodedata

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        folded = unicodedata.normalize("NFKC", text).casefold()
        return "".join(c for c in folded if not c.isspace() and unicodedata.category(c)[0] not in "PZC")

    return texts.map(one)


def normalised_full(text: Column) -> Column:
    """NFKC, case folding, then without white space, punctuation, separators and control characters."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield _full(t)

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, StringType())(text)


def normalised_simple(text: Column) -> Column:
    """The same for text of characters in ``SIMPLE``, in built-in functions."""
    return F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"[\p{P}\p{Z}\p{C}\s]", "")


def normalised(text: Column) -> Column:
    """The same for any text: built-in functions where they suffice, and only other texts go through Python."""
    simple = text.rlike(SIMPLE)
    return F.when(simple, normalised_simple(text)).otherwise(normalised_full(F.when(~simple, text)))


#: Text of these characters alone is in normal form C.
COMPOSED = r"^[\x{00}-\x{2FF}\x{3001}-\x{3002}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}]*\z"


def nfc(text: Column) -> Column:
    """Normal form C; only texts that may change go through Python."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import unicodedata

        for t in texts:
            yield t.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    composed = text.rlike(COMPOSED)
    return F.when(composed, text).otherwise(F.pandas_udf(run, StringType())(F.when(~composed, text)))


def is_cjk(char: Column) -> Column:
    """Whether a character is of the CJK blocks: unified ideographs and extension A, punctuation, full width forms."""
    return F.coalesce(char.rlike(r"^[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]\z"), F.lit(False))


def tokenize(text: Column, language: str) -> Column:
    """Tokens in normal form C: characters other than white space for zh, words for en; null for a text without any."""
    if language not in ("zh", "en"):
        raise ValidationError(f"language must be zh or en: {language!r}")
    return let(nfc(text), lambda t: let(tokens_by_character(t) if language == "zh" else tokens_by_space(t), lambda a: F.when(F.size(a) > 0, a)))


def text_hash(normal: Column) -> Column:
    """SHA-256 of the canonical JSON around normalised text, which has nothing to escape."""
    return F.sha2(F.concat(F.lit('{"normalized_text":"'), normal, F.lit('"}')), 256)


def gram_buckets(normal: Column, size: int = 3) -> Column:
    """The bucket (0 to 255) of each gram; a shorter text is one gram, an empty one has none."""
    n = F.length(normal)
    cut = let(normal, lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - (size - 1)), lambda i: F.substring(t, i, F.lit(size))))
    grams = F.when(n >= size, cut).when(n > 0, F.array(normal))
    bucket = lambda g: F.conv(F.substring(F.sha2(F.concat(F.lit('"'), g, F.lit('"')), 256), 7, 2), 16, 10).cast("int")
    return F.coalesce(F.transform(grams, bucket), F.array().cast("array<int>"))


def derived_seed(payload: Column) -> Column:
    """The seed of a canonical JSON payload: hash characters 9 to 16 as a number."""
    return F.conv(F.substring(F.sha2(payload, 256), 9, 8), 16, 10).cast("bigint")


def tokens_by_space(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def tokens_by_character(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: ~c.rlike(r"(?U)^\s*$"))


def render(template: str, values: dict[str, Column]) -> Column:
    """The template with its variables filled at once, so that braces in a value are never read; null where a value is blank or has braces.

    Missing and unknown variables are a ValidationError.
    """
    parts = re.split(r"\{([a-z][a-z0-9_]*)\}", template)
    if any("{" in p or "}" in p for p in parts[::2]):
        raise ValidationError(f"stray braces: {template!r}")
    if set(parts[1::2]) != set(values):
        raise ValidationError(f"the template has {sorted(set(parts[1::2]))}, given are {sorted(values)}")
    good = [F.when((F.trim(v) != "") & ~v.contains("{") & ~v.contains("}"), v) for v in values.values()]
    filled = dict(zip(values, good, strict=True))
    return F.concat(*[filled[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def stray_braces(text: Column) -> Column:
    """Whether braces are left when a template's variables are taken out."""
    return F.regexp_replace(text, r"\{[a-z][a-z0-9_]*\}", "").rlike("[{}]")


def template_variables(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{([a-z][a-z0-9_]*)\}"), F.lit(1))))


def slots_text(slot_values: Column, names: list[str], empty: str = "none") -> Column:
    """``slot=v1/v2`` for the slots that have values, in the domain's order."""
    one = lambda s: F.concat(s, F.lit("="), F.array_join(F.element_at(slot_values, s), "/"))
    held = F.filter(F.array(*[F.lit(n) for n in names]), lambda s: F.map_contains_key(slot_values, s))
    return F.when(F.size(held) == 0, F.lit(empty)).otherwise(F.array_join(F.transform(held, one), ", "))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, z: s + z)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)
