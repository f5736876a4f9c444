"""Calendar features as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIODS = ("night", "morning", "afternoon", "evening")
EVENING_FROM = 18
SESSION_GAP_MINUTES = 30


def hour(ts: Column) -> Column:
    return F.hour(ts)


def weekday(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def period(hour: Column, strict: bool = True) -> Column:
    """night [0,6), morning [6,12), afternoon [12,18), evening [18,24); other hours are an error, or null if not ``strict``."""
    bad = F.raise_error(F.concat(F.lit("Invalid hour: "), hour.cast("string"))) if strict else F.lit(None)
    valid = F.when(hour < 6, PERIODS[0]).when(hour < 12, PERIODS[1]).when(hour < 18, PERIODS[2]).otherwise(PERIODS[3])
    return F.when(hour.isNull(), F.lit(None)).when((hour >= 0) & (hour < 24), valid).otherwise(bad.cast("string"))


def is_weekend(day: Column) -> Column:
    return F.weekday(day) >= 5


def is_evening(hour: Column) -> Column:
    return hour >= EVENING_FROM


def minutes_between(start: Column, end: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(end) - micros(start)) / F.lit(6e7)


def angle(value: Column, cycle: int) -> Column:
    return value.cast("double") * F.lit(2 * math.pi / cycle)
