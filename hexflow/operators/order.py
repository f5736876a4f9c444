"""Global orders without a single task: dense numbers and runs over range partitions.

Rows are put in order by one range partitioning and saved; what a partition must know of those before
it is one small row a partition, which the driver adds up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hexflow.store import Scratch

_IN_PART = (1 << 33) - 1


def _placed(df: DataFrame, order: list[Column | str], label: str) -> DataFrame:
    """``df`` saved in order with ``_at`` (partition and place in it) and ``_part``."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return Scratch(df.sparkSession, label).save(ranged.withColumn("_part", F.shiftright("_at", 33)), "placed")


def _with_offsets(df: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """``df`` with ``_offset`` of its partition; the table of offsets has one row a partition."""
    table = df.sparkSession.createDataFrame(offsets, "_part long, _offset long")
    return df.join(F.broadcast(table), "_part")


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``df`` with ``name``: its rows' places in ``order``, from 0; rows that tie are in any order."""
    placed = _placed(df, order, "numbered")
    offsets, total = [], 0
    for r in sorted(placed.groupBy("_part").agg(F.count("*").alias("n")).collect()):  # one row a partition
        offsets.append((r["_part"], total))
        total += r["n"]
    return _with_offsets(placed, offsets).withColumn(name, F.col("_at").bitwiseAND(F.lit(_IN_PART)) + F.col("_offset")).drop("_at", "_part", "_offset")


def runs(df: DataFrame, order: list[str], value: str) -> DataFrame:
    """(run, value, n_rows): lengths of runs of equal values (nulls are equal) in ``order``, numbered from 1 (from 0 if the first value is null)."""
    placed = _placed(df.select(*dict.fromkeys([*order, value])), order, "runs")
    by = W.partitionBy("_part").orderBy("_at")
    changed = (F.row_number().over(by) > 1) & ~F.col(value).eqNullSafe(F.lag(value).over(by))
    flagged = placed.withColumn("_run", F.sum(changed.cast("long")).over(by))
    ends = flagged.groupBy("_part").agg(F.min_by(value, "_at").alias("first"), F.max_by(value, "_at").alias("last"), F.max("_run").alias("inside"))
    offsets, before, total = [], None, 0
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):  # one row a partition
        offsets.append((r["_part"], total := total + (r["first"] != before)))
        total, before = total + r["inside"], r["last"]
    return _with_offsets(flagged, offsets).groupBy((F.col("_run") + F.col("_offset")).alias("run"), value).agg(F.count("*").alias("n_rows"))
