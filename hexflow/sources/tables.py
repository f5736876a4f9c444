"""Readers: tables with clear errors, and the adapter that gives driver events positions, homes and archetypes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexflow.functions import geo, time

# The archetypes' names.
ARCHETYPES = ("commuter", "casual_evening", "weekend_explorer", "hardcore_raider", "lunch_player", "lunch_commuter", "weekend_homebody", "morning_player", "night_owl")

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.StringType()), T.StructField("player_id", T.StringType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()), T.StructField("event_type", T.StringType()), T.StructField("session_id", T.StringType()),
        T.StructField("distance_from_home_km", T.DoubleType()), T.StructField("hour", T.IntegerType()), T.StructField("day_of_week", T.IntegerType()),
    ]
)


class NoInput(ValueError):
    """An input folder holds no table."""


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet file or folder, pruned to ``columns``; a missing or empty folder is a ``NoInput``."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise NoInput(f"no Parquet files at {path}") from e
        raise
    return df.select(*columns) if columns else df


def empty_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EVENTS)


def require_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def _home(user: Column) -> tuple[Column, Column]:
    around = lambda m: ((user * m) % 2001 - 1000).cast("double") / 1000.0
    return F.lit(geo.CENTRE[0]) + around(7919) * F.lit(10.0 / 111.0), F.lit(geo.CENTRE[1]) + around(104729) * F.lit(10.0 / 97.0)


def archetype(user: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ARCHETYPES)), (user % len(ARCHETYPES) + 1).cast("int"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events with player, home, position, cell, hour, weekday, period and archetype (all arithmetic)."""
    raw = read_table(spark, f"{sf_dir}/events.parquet", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    home_lat, home_lon = _home(F.col("user_id"))
    k = F.get_json_object("props", "$.k").cast("int")
    df = raw.select("event_id", "ts", "user_id", F.col("user_id").cast("string").alias("player_id"), "event_type", "value", k.alias("k"), home_lat.alias("home_lat"), home_lon.alias("home_lon"))
    df = df.withColumn("lat", F.col("home_lat") + ((F.col("k") % 10).cast("double") - 4.5) * F.lit(0.4) / F.lit(111.0))
    df = df.withColumn("lon", F.col("home_lon") + (F.floor(F.col("k") / 10).cast("double") - 4.5) * F.lit(0.4) / F.lit(97.0))
    df = df.withColumns({"hour": time.hour(F.col("ts")), "day_of_week": time.weekday(F.col("ts")), "archetype": archetype(F.col("user_id"))})
    return df.withColumns({"period": time.period(F.col("hour")), "hex_id": geo.hex_cell(F.col("lat"), F.col("lon"))})


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a player: id, archetype and home."""
    users = read_table(spark, f"{sf_dir}/events.parquet", ["user_id"]).distinct()
    home_lat, home_lon = _home(F.col("user_id"))
    return users.select(F.col("user_id").cast("string").alias("player_id"), archetype(F.col("user_id")).alias("archetype"), home_lat.alias("home_lat"), home_lon.alias("home_lon"))
