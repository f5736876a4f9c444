"""Tables, metrics and datasets on disk, and their readers."""

from __future__ import annotations

import json

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexflow.operators import features, ranking
from hexflow.sources import tables

PAIR_COLUMNS = (*ranking.KEY, "hex_id", "label", "group_id")
ENRICHED_COLUMNS = (*PAIR_COLUMNS, *(c for c in (*ranking.NUMERIC, *ranking.CATEGORICAL) if c not in ranking.KEY))
PLAYER_COLUMNS = ("player_id", "archetype", "home_lat", "home_lon")


def write_table(df: DataFrame, path: str, partitions: int | None = None, order: str = "player_id") -> None:
    """Writes ``df`` as snappy Parquet, in ranges of ``order`` where a number of partitions is asked for."""
    if partitions:
        df = df.repartitionByRange(partitions, order).sortWithinPartitions(order)
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_players(players: DataFrame, path: str) -> None:
    write_table(tables.require_columns(players, list(PLAYER_COLUMNS)), path)


def write_feature_matrix(matrix: DataFrame, path: str) -> None:
    """One row a player; a player with two rows is an error."""
    twice = tables.require_columns(matrix, ["player_id"]).groupBy("player_id").count().filter("count > 1")
    if not twice.isEmpty():
        raise ValueError("the feature matrix has players with more than one row")
    write_table(matrix, path)


def read_feature_matrix(spark: SparkSession, path: str, label: str = "archetype") -> tuple[DataFrame, list[str]]:
    """(player_id, features vector, label) and the names of the features: all other columns, in the table's order."""
    df = tables.require_columns(tables.read_table(spark, path), ["player_id", label])
    names = [c for c in df.columns if c not in ("player_id", label)]
    return VectorAssembler(inputCols=names, outputCol="features").transform(df).select("player_id", "features", label), names


def write_clusters(clustered: DataFrame, path: str, key: str = "player_id") -> None:
    write_table(tables.require_columns(clustered, [key]), path)


def _rounded(value: object, digits: int) -> object:
    if isinstance(value, float):
        return round(value, digits)
    if isinstance(value, dict):
        return {k: _rounded(v, digits) for k, v in value.items()}
    return [_rounded(v, digits) for v in value] if isinstance(value, list | tuple) else value


def write_json(spark: SparkSession, value: dict, path: str, digits: int = 4) -> None:
    """One JSON document of rounded values, in a folder of one text file."""
    text = json.dumps(_rounded(value, digits), sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def write_datasets(spark: SparkSession, events: DataFrame, players: DataFrame, start: str, cutoff: str, folder: str, **options) -> None:
    """Pairs, features and enriched pairs of both sides of ``cutoff``, each a table of its own below ``folder``.

    Every table is written once and read again by the next, so that none is derived twice.
    """
    events = ranking.saved_events(events)
    past = features.before(events, cutoff)
    write_table(features.player_features(events, players, start, cutoff), f"{folder}/player_features")
    write_table(features.hex_features(events, cutoff), f"{folder}/hex_features", order="hex_id")
    for side, part in (("train", past), ("test", features.since(events, cutoff))):
        write_table(ranking.pairs(features.visits(part), **options), f"{folder}/pairs_{side}")
        rows = ranking.enrich(read_pairs(spark, folder, side), past, players, *(tables.read_table(spark, f"{folder}/{t}_features") for t in ("player", "hex")))
        write_table(tables.require_columns(rows, list(ENRICHED_COLUMNS)).select(*ENRICHED_COLUMNS), f"{folder}/enriched_{side}")


def read_pairs(spark: SparkSession, folder: str, side: str) -> DataFrame:
    return tables.require_columns(tables.read_table(spark, f"{folder}/pairs_{side}"), list(PAIR_COLUMNS))


def read_enriched(spark: SparkSession, folder: str, side: str, columns: list[str] | None = None) -> DataFrame:
    """Enriched pairs, all columns or some; a missing column is an error."""
    df = tables.require_columns(tables.read_table(spark, f"{folder}/enriched_{side}"), columns or list(ENRICHED_COLUMNS))
    return df.select(*columns) if columns else df


def written_summary(spark: SparkSession, path: str) -> DataFrame:
    """One row: n_events, n_players, n_sessions, events_per_session, events_per_player, n_files, mb of written events."""
    back = tables.read_table(spark, path)
    files = back.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("b")).distinct().agg(F.count("*").alias("n_files"), (F.sum("b") / 1e6).alias("mb"))
    n = back.agg(F.count("*").alias("n_events"), F.count_distinct("player_id").alias("n_players"), F.count_distinct("session_id").alias("n_sessions"))
    return n.withColumns({"events_per_session": F.col("n_events") / F.col("n_sessions"), "events_per_player": F.col("n_events") / F.col("n_players")}).crossJoin(files)  # one row each
