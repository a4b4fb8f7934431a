"""Task schemas: ids, slot values and references as predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_id(value: Column) -> Column:
    """Kebab-case, 1 to 64 characters; null is not valid."""
    return F.coalesce(value.rlike(r"^[a-z][a-z0-9]*(?:-[a-z0-9]+)*\z") & (F.length(value) <= 64), F.lit(False))


def valid_hash(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[0-9a-f]{64}\z"), F.lit(False))


def value_ok(value: Column, kind: str, *, choices: list[str] | None = None, minimum: float | None = None, maximum: float | None = None, min_length: int = 1, max_length: int = 64) -> Column:
    """Whether a value suits a slot type: enum, number, time (HH:MM) or text; null does not."""
    if kind == "enum":
        good = value.isin(list(choices or []))
    elif kind == "number":
        good = ~F.isnan(value.cast("double")) & (F.abs(value.cast("double")) < float("inf"))
        good = good & (value >= minimum) if minimum is not None else good
        good = good & (value <= maximum) if maximum is not None else good
    elif kind == "time":
        good = value.rlike(r"^(?:[01][0-9]|2[0-3]):[0-5][0-9]\z")
    elif kind == "text":
        good = F.length(value).between(min_length, max_length)
    else:
        raise ValueError(f"unknown value type {kind!r}")
    return F.coalesce(good, F.lit(False))


def slots_ok(used: Column, allowed: Column, required: Column) -> Column:
    """Every used slot is declared and every required slot is used."""
    return (F.size(F.array_except(used, allowed)) == 0) & (F.size(F.array_except(required, used)) == 0)
