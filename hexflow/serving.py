"""Serving: stored features, versions of a model, a service that ranks a player's cells, and its HTTP front."""

from __future__ import annotations

import json
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexflow import sinks
from hexflow.operators import lambdamart, ranking
from hexflow.sources import tables

PERIODS = ("night", "morning", "afternoon", "evening")


def prepare(enriched: DataFrame, ranker: lambdamart.Ranker, folder: str) -> int:
    """Writes the serving table (sorted by player, so a lookup reads few row groups), its metadata, and a new version of the model."""
    spark = enriched.sparkSession
    table = ranking.serving_table(enriched)
    table.repartitionByRange("player_id").sortWithinPartitions("player_id", "hex_id").write.mode("overwrite").parquet(f"{folder}/features")
    sinks.write_json(spark, {"features": [c for c in table.columns if c not in ("player_id", "hex_id")], "numeric": ranking.NUMERIC, "categorical": ranking.CATEGORICAL}, f"{folder}/meta")
    return register(spark, ranker, f"{folder}/models")


def versions(spark: SparkSession, registry: str) -> list[int]:
    """Versions below a folder, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(registry)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def register(spark: SparkSession, ranker: lambdamart.Ranker, registry: str) -> int:
    """Saves a ranker as the next version and returns its number."""
    version = max(versions(spark, registry), default=0) + 1
    lambdamart.save(ranker, f"{registry}/v{version:05d}", spark)
    return version


def load_model(spark: SparkSession, registry: str, version: int | None = None) -> lambdamart.Ranker:
    """A version of a model, the latest by default; none there is an error."""
    found = versions(spark, registry)
    if not found or version is not None and version not in found:
        raise KeyError(f"no {'version of the model' if version is None else f'version {version}'} in {registry}")
    return lambdamart.load(f"{registry}/v{found[-1] if version is None else version:05d}", spark)


def export(spark: SparkSession, registry: str, folder: str, version: int | None = None) -> None:
    """Copies a version of a model to a folder of its own, which is overwritten."""
    lambdamart.save(load_model(spark, registry, version), folder, spark)


class UnknownPlayer(KeyError):
    """A player without stored features."""


class Service:
    """Ranks the known cells of players by the stored features and a model."""

    def __init__(self, spark: SparkSession, folder: str, version: int | None = None):
        self.table = tables.read_table(spark, f"{folder}/features")
        self.ranker = load_model(spark, f"{folder}/models", version)

    def known_players(self) -> int:
        return self.table.agg(F.count_distinct("player_id")).first()[0]

    def rank(self, player_id: str, day_of_week: int, period: str, top_k: int = 10) -> list[dict]:
        """The best cells of one player with scores; bad arguments are a ValueError, a player without features an UnknownPlayer."""
        if not 0 <= day_of_week <= 6 or period not in PERIODS or not 1 <= top_k <= 100:
            raise ValueError("day_of_week must lie in 0 to 6, top_k in 1 to 100, period be one of " + ", ".join(PERIODS))
        mine = self.table.filter(F.col("player_id") == player_id).withColumns({"day_of_week": F.lit(day_of_week), "period": F.lit(period)})
        best = self.ranker.score(mine).orderBy(F.col("score").desc(), "hex_id").limit(top_k).select("hex_id", "score").collect()  # top_k rows
        if not best:
            raise UnknownPlayer(player_id)
        return [r.asDict() for r in best]

    def rank_batch(self, requests: DataFrame) -> DataFrame:
        """All requests (request_id, player_id, day_of_week, period, top_k) in one job."""
        keys = ["request_id", "player_id", "day_of_week", "period", "top_k"]
        scored = self.ranker.score(requests.select(*keys).join(self.table, "player_id"))
        return ranking.rank_batch(requests, scored.select("request_id", "player_id", "hex_id", "score"), F.col("score"), on=["request_id", "player_id"])


def answer(service: Service, path: str) -> tuple[int, dict]:
    """(status, body) of GET /health and GET /rank?player_id=&day_of_week=&period=&top_k=."""
    url = urlsplit(path)
    asked = {k: v[-1] for k, v in parse_qs(url.query).items()}
    if url.path == "/health":
        return 200, {"status": "ok", "known_players": service.known_players()}
    if url.path != "/rank":
        return 404, {"detail": "not found"}
    try:
        player, day, period, top = asked["player_id"], int(asked["day_of_week"]), asked["period"], int(asked.get("top_k", 10))
        return 200, {"player_id": player, "ranking": service.rank(player, day, period, top)}
    except UnknownPlayer:
        return 404, {"detail": "unknown player"}
    except (KeyError, ValueError) as e:
        return 422, {"detail": f"bad request: {e}"}


def server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """An HTTP server over ``answer``; the caller runs serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            began = time.time()
            status, body = answer(service, self.path)
            raw = json.dumps(body | {"seconds": round(time.time() - began, 3)}).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
