"""Derived columns, all as JVM-side expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clock_to_seconds(clock: Column | str) -> Column:
    """Race clock ``minutes.SScc`` (single precision on input) to seconds."""
    x = _col(clock).cast("float").cast("double")
    minutes = x.cast("int")
    return minutes * 60 + (x - minutes) * 100


def cyclic(c: Column | str, period: int = 12) -> tuple[Column, Column]:
    """Sine and cosine of a position on a cycle."""
    angle = F.pmod(_col(c), F.lit(period)) * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def series_key(*cols: Column | str) -> Column:
    return F.concat_ws("_", *[_col(c).cast("string") for c in cols])


def month_index(date: Column | str) -> Column:
    """January is 0."""
    return F.month(_col(date)) - 1


def age_months(birth: Column | str, at: Column | str) -> Column:
    """Calendar months between two dates, the day of the month ignored, never negative."""
    b, a = _col(birth), _col(at)
    return F.greatest((F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b), F.lit(0))


def months_later(date: Column | str, months: Column | int, clamp: bool = False) -> Column:
    """Same day ``months`` later; a day the month lacks runs over into the next (or is clamped)."""
    d = _col(date).cast("date")
    if clamp:
        return F.add_months(d, months)
    return F.date_add(F.add_months(F.trunc(d, "MM"), months), F.dayofmonth(d) - 1)


def elapsed_days(start: Column | str, end: Column | str, rounding: str = "down") -> Column:
    """Whole elapsed days; ``rounding="up"`` counts a started day and ignores direction."""
    # Subtracting zone-free times gives an exact interval whatever the session time zone.
    span = _col(end).cast("timestamp_ntz") - _col(start).cast("timestamp_ntz")
    days = F.extract(F.lit("DAY"), span).cast("long")
    if rounding != "up":
        return days
    started = sum((F.abs(F.extract(F.lit(part), span)) for part in ("HOUR", "MINUTE")), F.abs(F.extract(F.lit("SECOND"), span)))
    return F.abs(days) + (started > 0).cast("long")


def unit_hash(seed: int | str, key: Column | str) -> Column:
    """A repeatable number in [0, 1) per (seed, key), the same on any engine with md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), _col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def missing_if_nan(c: Column | str) -> Column:
    x = _col(c).cast("double")
    return F.when(~F.isnan(x), x)
