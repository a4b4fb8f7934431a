"""How synthetic sounds follow from speakers and tokens, as Column functions over canonical hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _quoted(value: Column) -> Column:
    """A JSON string; quotes and backslashes are escaped, controls don't occur in tokens."""
    return F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _hash(kind: str, *parts: Column) -> Column:
    return F.sha2(F.concat(F.lit(f'["{kind}"'), *[x for p in parts for x in (F.lit(","), p)], F.lit("]")), 256)


def _number(digest: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")


def speaker_shift(speaker: Column) -> Column:
    """The factor of a speaker's frequencies, within 12 percent of 1."""
    return F.round(F.lit(1.0) + F.lit(0.12) * (F.lit(2.0) * (_number(_hash("speaker-shift", speaker.cast("string")), 1, 8) / F.lit(4294967295.0)) - F.lit(1.0)), 6)


def filler_hz(domain: Column, token: Column) -> Column:
    """The tone of a plain token."""
    return F.lit(150.0) + (_number(_hash("filler", _quoted(domain), _quoted(token)), 1, 8) % 1_000_000) / F.lit(1_000_000.0) * F.lit(250.0)


def value_hz(domain: Column, slot: Column, token: Column) -> Column:
    """The two formants of a slot value's token."""
    digest = _hash("value", _quoted(domain), _quoted(slot), _quoted(token))
    first = F.lit(400.0) + _number(_hash("slot-band", _quoted(slot)), 1, 8) % 8 * F.lit(120.0) + _number(digest, 1, 4) % 60
    return F.array(first, first * (F.lit(2.2) + (_number(digest, 5, 4) % 100) / F.lit(100.0) * F.lit(0.6)))
