"""Numbers, dates, scales and vectors as Spark columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.literals import NUMBER

#: A date column's values that stand for "none" and for "open end".
NO_DATE, OPEN_END = "0", "99991231"


def guarded_number(c: Column, kind: str = "decimal(38,10)") -> Column:
    """A stored text as a number; null if it isn't one in full."""
    clean = F.replace(F.trim(c.cast("string")), F.lit(","), F.lit(""))
    return F.when(clean.rlike(NUMBER), clean.try_cast(kind))


def zero_as_null(c: Column) -> Column:
    return F.nullif(c, F.lit(0))


def rank_on(c: Column, scale: list[str]) -> Column:
    """The place of a value on a scale, 1 for the worst; null off the scale."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in scale]), c), F.lit(0))


def stored_day(c: Column) -> Column:
    """A date stored as YYYYMMDD, perhaps with .0 behind it; null for marks and for what isn't a day."""
    digits = F.regexp_replace(F.trim(c.cast("string")), r"\.0+$", "")
    return F.when(digits.rlike(r"^\d{8}$") & ~digits.isin(NO_DATE, OPEN_END), F.try_to_date(digits, "yyyyMMdd"))


def is_open_end(c: Column) -> Column:
    return F.regexp_replace(F.trim(c.cast("string")), r"\.0+$", "") == OPEN_END


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine of a stored vector and a literal one; null where lengths differ or a norm is zero."""
    norm = math.sqrt(sum(x * x for x in query))
    literal = F.array(*[F.lit(x / norm if norm else 0.0) for x in query])
    dot = F.aggregate(F.zip_with(vector, literal, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    own = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((F.size(vector) == len(query)) & (own > 0) & F.lit(norm > 0), dot / own)


def years_bucket(days: Column, buckets: list[tuple[float | None, float | None, str]], matured: str) -> Column:
    """The label of the half-open bucket [lo, hi) in years that holds a number of days; `matured` below zero."""
    years, out = days / F.lit(365), F.when(days < 0, matured)
    for lo, hi, label in buckets:
        inside = (F.lit(True) if lo is None else years >= lo) & (F.lit(True) if hi is None else years < hi)
        out = out.when(days.isNotNull() & inside, label)
    return out


def finite(c: Column) -> Column:
    value = c.cast("double")
    return ~(F.isnan(value) | (F.abs(value) == float("inf")))
