"""Visits, sessions and behavioural features, each one or a few aggregations over events.

Distinct counts are taken at their own grain (player and session, player and cell, player and day)
and joined on player_id, which avoids the row expansion of several distinct counts in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hexflow.functions import geo, stats, time

GAP_MINUTES = time.SESSION_GAP_MINUTES


def before(events: DataFrame, cutoff: str) -> DataFrame:
    return events.filter(F.col("ts") < F.lit(cutoff).cast("timestamp_ntz"))


def since(events: DataFrame, cutoff: str) -> DataFrame:
    return events.filter(F.col("ts") >= F.lit(cutoff).cast("timestamp_ntz"))


def allow(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on).distinct(), on, "left_semi")


def visits(events: DataFrame) -> DataFrame:
    return events.groupBy("player_id", "day_of_week", "period", "hex_id").agg(F.count("*").alias("n_visits"))


def pair_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("player_id", "hex_id").agg(F.count("*").alias("n_visits"))


def universe(visited: DataFrame) -> DataFrame:
    return visited.select("player_id", "hex_id").distinct()


def sessions(events: DataFrame, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """Adds ``session_seq`` (from 0) and ``session_id``: a gap of more than ``gap_minutes`` begins a session."""
    by = W.partitionBy("player_id").orderBy("ts", "event_id")
    jump = time.minutes_between(F.lag("ts").over(by), F.col("ts")) > gap_minutes
    numbered = events.withColumn("session_seq", F.sum(F.when(jump, 1).otherwise(0)).over(by).cast("long"))
    return numbered.withColumn("session_id", F.md5(F.concat_ws("|", "player_id", F.col("session_seq").cast("string"))))


def session_rollup(with_sessions: DataFrame) -> DataFrame:
    out = with_sessions.groupBy("player_id", "session_seq").agg(F.count("*").alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return out.withColumn("minutes", time.minutes_between(F.col("first_ts"), F.col("last_ts")))


def session_stats(rollup: DataFrame) -> DataFrame:
    """Per player; the mean duration is a sum of whole microseconds, so it doesn't depend on the order of the sessions."""
    micros = F.sum(F.unix_micros(F.col("last_ts").cast("timestamp")) - F.unix_micros(F.col("first_ts").cast("timestamp")))
    return rollup.groupBy("player_id").agg(
        F.count("*").alias("total_sessions"), F.avg("n_events").alias("mean_events_per_session"), F.median("n_events").alias("median_events_per_session"),
        stats.population_std(F.col("n_events")).alias("std_events_per_session"), (micros / F.lit(6e7) / F.count("*")).alias("mean_session_duration_minutes"),
    )


def with_distance(events: DataFrame) -> DataFrame:
    return events.withColumn("distance_km", geo.haversine_km(F.col("home_lat"), F.col("home_lon"), F.col("lat"), F.col("lon")))


def hour_concentration(events: DataFrame) -> DataFrame:
    return events.groupBy("player_id", "hour").agg(F.count("*").alias("n")).groupBy("player_id").agg(stats.concentration(F.col("n"), 24).alias("hour_concentration"))


def footprint(events: DataFrame) -> DataFrame:
    return pair_counts(events).groupBy("player_id").agg(F.count("*").alias("unique_hexes"), stats.entropy_bits(F.col("n_visits")).alias("hex_entropy"))


def active_days(events: DataFrame) -> DataFrame:
    return events.select("player_id", F.to_date("ts").alias("day")).distinct().groupBy("player_id").agg(F.count("*").alias("active_days"))


def cyclical(events: DataFrame) -> DataFrame:
    terms = []
    for name, column, cycle in (("hour", "hour", 24), ("dow", "day_of_week", 7)):
        angle = time.angle(F.col(column), cycle)
        terms += [F.avg(F.sin(angle)).alias(f"{name}_mean_sin"), F.avg(F.cos(angle)).alias(f"{name}_mean_cos")]
    out = events.groupBy("player_id").agg(*terms)
    length = lambda n: F.sqrt(F.pow(f"{n}_mean_sin", F.lit(2.0)) + F.pow(f"{n}_mean_cos", F.lit(2.0)))
    return out.withColumns({"hour_resultant": length("hour"), "dow_resultant": length("dow")})


def distance_stats(events: DataFrame) -> DataFrame:
    d = F.col("distance_km")
    return with_distance(events).groupBy("player_id").agg(
        F.avg(d).alias("distance_from_home_mean"), stats.population_std(d).alias("distance_from_home_std"),
        *[F.percentile(d, F.lit(p / 100)).alias(f"distance_from_home_p{p}") for p in (25, 75, 95)],
    )


def player_features(events: DataFrame, players: DataFrame, start: str, cutoff: str) -> DataFrame:
    """Nine numeric features and the archetype of every player with an event before ``cutoff``."""
    past = sessions(with_distance(before(events, cutoff)))
    days = F.date_diff(F.lit(cutoff).cast("date"), F.lit(start).cast("date"))
    base = past.groupBy("player_id").agg(
        F.count("*").alias("n"), F.max("session_seq").alias("last_session"), stats.share_where(F.col("day_of_week") < 5).alias("player_weekday_ratio"),
        stats.share_where(time.is_evening(F.col("hour"))).alias("player_evening_ratio"), F.avg("distance_km").alias("player_distance_from_home_mean_km"),
    )
    out = base.join(active_days(past), "player_id").join(footprint(past), "player_id").join(hour_concentration(past), "player_id")
    out = out.join(players.select("player_id", F.col("archetype").alias("player_archetype")), "player_id", "left")
    return out.select(
        "player_id", F.log1p(F.col("n").cast("double")).alias("player_total_events_log"), (F.col("last_session") + 1).alias("player_unique_sessions"),
        stats.safe_ratio(F.col("n"), F.col("last_session") + 1).alias("player_events_per_session_mean"), stats.safe_ratio(F.col("active_days"), days).alias("player_active_days_ratio"),
        "player_weekday_ratio", "player_evening_ratio", F.col("hour_concentration").alias("player_hour_concentration"), "player_distance_from_home_mean_km",
        F.log1p(F.col("unique_hexes").cast("double")).alias("player_unique_hexes_count_log"), "player_archetype",
    )


def hex_archetype_counts(events: DataFrame) -> DataFrame:
    """Events and distinct players by cell and archetype; rows without an archetype are left out."""
    per_player = events.filter(F.col("archetype").isNotNull()).groupBy("hex_id", "archetype", "player_id").agg(F.count("*").alias("n"))
    return per_player.groupBy("hex_id", "archetype").agg(F.sum("n").alias("n_events"), F.count("*").alias("n_players"))


def hex_features(events: DataFrame, cutoff: str) -> DataFrame:
    return hex_archetype_counts(before(events, cutoff)).groupBy("hex_id").agg(
        F.sum("n_players").alias("hex_global_popularity"), F.sum("n_events").alias("hex_total_visits"), F.count("*").alias("hex_n_unique_archetypes")
    )


def profile(events: DataFrame, players: DataFrame, observation_days: int = 180) -> DataFrame:
    """54 features and the archetype of every player with an event."""
    hour, dow = F.col("hour"), F.col("day_of_week")
    base = events.groupBy("player_id").agg(
        *stats.densities(hour, range(24), "hour_density_{:02d}"), *stats.densities(dow, range(7), "dow_density_{}"),
        stats.share_where(dow < 5).alias("weekday_ratio"), stats.share_where(time.is_evening(hour)).alias("evening_ratio"), F.count("*").alias("total_events"),
    )
    circular = cyclical(events).withColumnsRenamed({"hour_resultant": "hour_concentration", "dow_resultant": "dow_concentration"})
    out = base
    for part in (circular, distance_stats(events), footprint(events), active_days(events), session_stats(session_rollup(sessions(events)))):
        out = out.join(part, "player_id")
    out = out.withColumns({"events_per_active_day": stats.safe_ratio(F.col("total_events"), F.col("active_days")), "active_days_ratio": F.col("active_days") / F.lit(float(observation_days))})
    return out.drop("active_days").join(players.select("player_id", "archetype"), "player_id", "left")
