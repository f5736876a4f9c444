"""Samples of rows in reproducible random orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hexflow.operators.ranking import SEED, draw


def uniform(df: DataFrame, n: int, key: str, seed: int = SEED) -> DataFrame:
    """``n`` rows without replacement, in the order of their draws; all rows if there are fewer."""
    return df.orderBy(draw(key, seed=seed), key).limit(n)


def per_group(df: DataFrame, group: str, most: int, key: str, seed: int = SEED) -> DataFrame:
    """At most ``most`` rows of each group, drawn alike (a limit per group, applied before the shuffle too)."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(draw(key, seed=seed), key))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")


def head(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first ``n`` rows in ``order``."""
    return df.orderBy(order).limit(n)


def signature(df: DataFrame) -> list[tuple[str, str]]:
    """Names and types of the columns, for a model's metadata."""
    return df.dtypes


def non_negative(df: DataFrame, column: str) -> DataFrame:
    """``df``, failing on a negative count."""
    c = F.col(column)
    return df.withColumn(column, F.when(c < 0, F.raise_error(F.concat(F.lit(f"negative {column}: "), c.cast("string")))).otherwise(c))
