"""Aggregate expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(part: Column, whole: Column) -> Column:
    """0 where the denominator is 0 (or null)."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def share_where(condition: Column) -> Column:
    """Share of a group's rows for which ``condition`` holds."""
    return F.count_if(condition) / F.count(F.lit(1))


def densities(value: Column, values: Iterable[int], name: str) -> list[Column]:
    """One share per value, as ``name`` formatted with it; no pivot, so no extra job."""
    return [share_where(value == v).alias(name.format(v)) for v in values]


def entropy_bits(n: Column) -> Column:
    """Shannon entropy of the counts ``n`` of a group, 0 for a single bucket."""
    total = F.sum(n)
    return F.when(F.count(F.lit(1)) > 1, F.log2(total) - F.sum(n * F.log2(n.cast("double"))) / total).otherwise(F.lit(0.0))


def concentration(n: Column, buckets: int) -> Column:
    """1 - H / ln(buckets) of the counts ``n`` of a group."""
    total = F.sum(n).cast("double")
    spread = F.log(total) - F.sum(n * F.log(n.cast("double"))) / total
    return F.lit(1.0) - spread / F.log(F.lit(float(buckets)))


def population_std(value: Column) -> Column:
    return F.coalesce(F.stddev_pop(value), F.lit(0.0))
