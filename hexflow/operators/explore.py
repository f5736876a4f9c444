"""Exploratory tables: densities, pivots, histograms, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def group_density(df: DataFrame, group: str, value: str) -> DataFrame:
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"))
    return counts.withColumn("density", F.col("n") / F.sum("n").over(W.partitionBy(group)))


def value_shares(df: DataFrame, value: str) -> DataFrame:
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select(value, "n", (F.col("n") * 100.0 / F.col("total")).alias("percent"))


def pivot_hours(df: DataFrame, group: str) -> DataFrame:
    counts = df.groupBy(group).agg(*[F.count_if(F.col("hour") == h).alias(f"h{h:02d}") for h in range(24)])
    return counts


def top_values(df: DataFrame, group: str, value: str, k: int = 3) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.col("n").desc(), value))
    return df.groupBy(group, value).agg(F.count("*").alias("n")).withColumn("rank", rank).filter(F.col("rank") <= k)


def session_summary(rollup: DataFrame, players: DataFrame) -> DataFrame:
    joined = rollup.join(players.select("player_id", "archetype"), "player_id")
    size = F.col("n_events")
    return joined.groupBy("archetype").agg(
        F.count("*").alias("n_sessions"), F.round(F.avg(size), 2).alias("mean_events"), F.round(F.median(size), 2).alias("median_events"), F.round(F.stddev_samp(size), 2).alias("std_events"),
    )


def sessions_per_player(rollup: DataFrame, players: DataFrame) -> DataFrame:
    people = players.groupBy("archetype").agg(F.count("*").alias("n_players"))
    made = rollup.join(players.select("player_id", "archetype"), "player_id").groupBy("archetype").agg(F.count("*").alias("n_sessions"))
    return made.join(people, "archetype").withColumn("sessions_per_player", F.col("n_sessions") / F.col("n_players"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int = 50) -> DataFrame:
    """Counts and densities of ``bins`` equal bins over [low, high]; the last bin is closed."""
    inside = df.filter(F.col(column).between(low, high))
    bucket = F.least(F.floor((F.col(column) - low) / F.lit((high - low) / bins)), F.lit(bins - 1)).cast("int")
    counts = inside.groupBy(bucket.alias("bin")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("bin", "n", (F.col("n") / F.col("total") / F.lit((high - low) / bins)).alias("density"))


def distribution_delta(df: DataFrame, group: str, target: DataFrame) -> DataFrame:
    """Observed and wanted percentages of each value and their difference in points."""
    seen = value_shares(df, group).select(group, F.col("percent").alias("observed"))
    return target.join(seen, group, "left").select(group, F.coalesce("observed", F.lit(0.0)).alias("observed"), "wanted", (F.coalesce("observed", F.lit(0.0)) - F.col("wanted")).alias("delta"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, mean, std, min, p25, p50, p75, max) of numeric columns, in one pass."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        quarters = [F.percentile(x, F.lit(p / 100)).alias(f"p{p}") for p in (25, 50, 75)]
        aggs.append(F.struct(F.lit(c).alias("column"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), *quarters, F.max(x).alias("max")))
    return df.agg(F.array(*aggs).alias("all")).select(F.explode("all").alias("x")).select("x.*")
