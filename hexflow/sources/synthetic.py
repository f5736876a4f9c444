"""Synthetic players and events as one lazy plan; every row's draws follow from the seed and its key."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexflow.functions import geo

# Archetype, weekday peaks, weekend peaks, weekday and weekend activity, events a day, radius km, share.
PROFILES = (
    ("commuter", (7, 8, 17, 18, 19), (10, 11, 17), 0.95, 0.35, 20.0, 8.0, 0.18),
    ("casual_evening", (19, 20, 21, 22), (19, 20, 21, 22), 0.70, 0.75, 12.0, 2.5, 0.22),
    ("weekend_explorer", (19, 20), (10, 11, 12, 13, 14, 15, 16, 17), 0.15, 0.95, 45.0, 12.0, 0.10),
    ("hardcore_raider", (12, 18, 19, 20, 21, 22), (11, 12, 13, 17, 18, 19, 20, 21), 0.98, 0.98, 80.0, 10.0, 0.07),
    ("lunch_player", (12, 13, 14), (13, 14), 0.90, 0.25, 8.0, 1.5, 0.13),
    ("lunch_commuter", (8, 13, 18), (11, 14), 0.90, 0.40, 18.0, 7.0, 0.10),
    ("weekend_homebody", (20, 21), (11, 14, 20, 21), 0.65, 0.85, 14.0, 3.0, 0.08),
    ("morning_player", (6, 7, 8, 9), (8, 9, 10), 0.85, 0.55, 15.0, 4.0, 0.07),
    ("night_owl", (22, 23, 0, 1), (22, 23, 0, 1, 2), 0.75, 0.80, 20.0, 3.5, 0.05),
)
HOUR_SIGMA, ATYPICAL, NIGHT_FACTOR = 2.5, 0.08, 0.3
EVENT_TYPES = (("spin_stop", 0.45), ("catch", 0.40), ("raid", 0.10), ("walk_egg", 0.05))
DEVICES = (("ios", 0.45), ("android", 0.55))
HOME_SHARE, WORK_SHARE, ANCHOR_SHARE = 0.50, 0.35, 0.4
WORK_PRESENT, WORK_KM, WORK_TRIES = 0.70, (1.0, 15.0), 5
CITY_RADIUS_KM = 15.0


@dataclass(frozen=True)
class Config:
    n_players: int = 1000
    n_days: int = 30
    start: str = "2025-01-01"
    noise: float = 0.15
    seed: int = 42


def uniform(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) that follows from the seed and the parts alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11).cast("double") / F.lit(float(1 << 53))


def normal(seed: int, *parts: Column | str) -> Column:
    """Box-Muller over two uniform draws."""
    a, b = F.greatest(uniform(seed, *parts, F.lit("a")), F.lit(1e-12)), uniform(seed, *parts, F.lit("b"))
    return F.sqrt(F.lit(-2.0) * F.log(a)) * F.cos(F.lit(2 * math.pi) * b)


def categorical(u: Column, weights: tuple[tuple[str, float], ...]) -> Column:
    total, at, out = sum(w for _, w in weights), 0.0, F.lit(None).cast("string")
    bounds = []
    for name, w in weights:
        at += w / total
        bounds.append((name, at))
    for name, bound in reversed(bounds):
        out = F.lit(name) if out is None or name == bounds[-1][0] else F.when(u < bound, name).otherwise(out)
    return out


def uuid_of(*parts: Column | str) -> Column:
    h = F.md5(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def offset_point(lat: Column, lon: Column, km: Column, angle: Column) -> tuple[Column, Column]:
    return lat + geo.km_to_degrees_lat(km * F.sin(angle)), lon + geo.km_to_degrees_lon(km * F.cos(angle), lat)


def hour_density(peaks: tuple[int, ...]) -> list[float]:
    """Wrapped bumps around the peaks, summing to 1."""
    raw = [sum(math.exp(-0.5 * (min(abs(h - p), 24 - abs(h - p)) / HOUR_SIGMA) ** 2) for p in peaks) for h in range(24)]
    return [v / sum(raw) for v in raw]


def flat_density() -> list[float]:
    raw = [NIGHT_FACTOR if h < 6 else 1.0 for h in range(24)]
    return [v / sum(raw) for v in raw]


def _cumulative(density: list[float]) -> list[float]:
    out, at = [], 0.0
    for v in density:
        at += v
        out.append(at)
    return out


def profile_table(spark: SparkSession) -> DataFrame:
    """One row an archetype, with cumulative hour densities."""
    rows = [(n, _cumulative(hour_density(wd)), _cumulative(hour_density(we)), a, b, rate, radius, share) for n, wd, we, a, b, rate, radius, share in PROFILES]
    return spark.createDataFrame(rows, "archetype string, weekday_hours array<double>, weekend_hours array<double>, weekday_active double, weekend_active double, rate double, radius double, share double")


def hour_table(spark: SparkSession) -> DataFrame:
    """(archetype, day_kind, hour, density)."""
    rows = [(p[0], kind, h, v) for p in PROFILES for kind, peaks in (("weekday", p[1]), ("weekend", p[2])) for h, v in enumerate(hour_density(peaks))]
    rows += [("any", "atypical", h, v) for h, v in enumerate(flat_density())]
    return spark.createDataFrame(rows, "archetype string, day_kind string, hour int, density double")


def players(spark: SparkSession, c: Config = Config()) -> DataFrame:
    df = spark.range(c.n_players).withColumn("player_id", uuid_of(F.lit(c.seed), "id"))
    u = lambda name: uniform(c.seed, F.col("id"), F.lit(name))
    df = df.withColumn("archetype", categorical(u("archetype"), tuple((p[0], p[7]) for p in PROFILES)))
    lat, lon = offset_point(F.lit(geo.CENTRE[0]), F.lit(geo.CENTRE[1]), F.lit(CITY_RADIUS_KM) * F.sqrt(u("home r")), F.lit(2 * math.pi) * u("home a"))
    df = df.withColumns({"home_lat": lat, "home_lon": lon, "created_at": F.date_sub(F.lit(c.start).cast("date"), (F.lit(30) + F.floor(u("created") * 335)).cast("int")).cast("timestamp_ntz"), "device_type": categorical(u("device"), DEVICES)})
    tries = []
    for k in range(WORK_TRIES):
        la, lo = offset_point(F.lit(geo.CENTRE[0]), F.lit(geo.CENTRE[1]), F.lit(CITY_RADIUS_KM) * F.sqrt(u(f"work r {k}")), F.lit(2 * math.pi) * u(f"work a {k}"))
        tries.append(F.struct(la.alias("lat"), lo.alias("lon"), geo.haversine_km(F.col("home_lat"), F.col("home_lon"), la, lo).alias("km")))
    fit = F.filter(F.array(*tries), lambda t: t["km"].between(*WORK_KM))
    works = u("works") < WORK_PRESENT
    work = lambda f, home: F.when(works, F.when(F.size(fit) > 0, fit[0][f]).otherwise(F.col(home)))
    return df.select("player_id", "archetype", "created_at", "home_lat", "home_lon", work("lat", "home_lat").alias("work_lat"), work("lon", "home_lon").alias("work_lon"), "device_type")


def _poisson(u: Column, mean: Column, most: int = 400) -> Column:
    """Inverse of the Poisson distribution by a running sum of its terms.

    The sum reaches eight deviations beyond the mean; ``most`` would cut means above 268, and the
    generator's largest is twice the largest rate, 160.
    """
    step = lambda s, k: F.struct((s["p"] * mean / k).alias("p"), (s["sum"] + s["p"] * mean / k).alias("sum"), (s["n"] + F.when(s["sum"] < u, 1).otherwise(0)).alias("n"))
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.lit(0).alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.least(F.ceil(mean + 8 * F.sqrt(mean) + 8), F.lit(most)).cast("int")), start, step, lambda s: s["n"])


def events(spark: SparkSession, people: DataFrame, c: Config = Config()) -> DataFrame:
    """(event_id, player_id, timestamp, lat, lon, event_type, session_id, distance_from_home_km, hour, day_of_week)."""
    from hexflow.operators import features

    u = lambda *parts: uniform(c.seed, F.col("player_id"), *parts)
    days = people.join(F.broadcast(profile_table(spark)), "archetype").withColumn("day_no", F.explode(F.sequence(F.lit(0), F.lit(c.n_days - 1))))
    days = days.withColumn("day", F.date_add(F.lit(c.start).cast("date"), F.col("day_no"))).withColumn("weekend", F.weekday("day") >= 5)
    active = u("day_no", F.lit("active")) < F.when(F.col("weekend"), F.col("weekend_active")).otherwise(F.col("weekday_active"))
    days = days.withColumn("atypical", u("day_no", F.lit("atypical")) < ATYPICAL).filter(active | F.col("atypical"))
    mean = F.col("rate") * F.least(F.greatest(F.lit(1.0) + F.lit(c.noise) * normal(c.seed, "player_id", "day_no", F.lit("noise")), F.lit(0.3)), F.lit(2.0))
    days = days.withColumn("mean", mean).withColumn("n", _poisson(u("day_no", F.lit("n")), F.col("mean"))).filter("n > 0")
    rows = days.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    v = lambda name: u("day_no", "k", F.lit(name))
    usual = F.when(F.col("weekend"), F.col("weekend_hours")).otherwise(F.col("weekday_hours"))
    table = F.when(F.col("atypical"), F.array(*map(F.lit, _cumulative(flat_density())))).otherwise(usual)
    rows = rows.withColumn("hour_u", v("hour")).withColumn("cumulative", table)
    rows = rows.withColumn("hour", F.least(F.size(F.filter("cumulative", lambda x: x <= F.col("hour_u"))), F.lit(23)).cast("int"))
    seconds = F.col("hour") * 3600 + F.floor(v("minute") * 60) * 60 + F.floor(v("second") * 60)
    rows = rows.withColumn("ts", F.timestamp_seconds(F.unix_timestamp(F.col("day").cast("timestamp")) + seconds).cast("timestamp_ntz"))
    place, worker = v("place"), F.col("work_lat").isNotNull()
    home = place < F.when(worker, HOME_SHARE).otherwise(HOME_SHARE + WORK_SHARE)
    work = worker & (place < HOME_SHARE + WORK_SHARE) & ~home
    anchor_lat, anchor_lon = (F.when(work, F.col(f"work_{x}")).otherwise(F.col(f"home_{x}")) for x in ("lat", "lon"))
    near = F.abs(normal(c.seed, "player_id", "day_no", "k", F.lit("near"))) * F.col("radius") * ANCHOR_SHARE
    km = F.when(home | work, near).otherwise(F.col("radius") * F.sqrt(v("roam")))
    lat, lon = offset_point(anchor_lat, anchor_lon, km, F.lit(2 * math.pi) * v("angle"))
    rows = rows.withColumns({"lat": lat, "lon": lon, "event_type": categorical(v("type"), EVENT_TYPES), "event_id": uuid_of("player_id", "day_no", "k")})
    rows = features.sessions(rows.withColumn("distance_from_home_km", geo.haversine_km(F.col("home_lat"), F.col("home_lon"), F.col("lat"), F.col("lon"))))
    return rows.select("event_id", "player_id", F.col("ts").alias("timestamp"), "lat", "lon", "event_type", "session_id", "distance_from_home_km", F.col("hour").cast(T.ByteType()).alias("hour"), F.weekday("ts").cast(T.ByteType()).alias("day_of_week"))


def write_events(made: DataFrame, path: str, partitions: int = 8) -> DataFrame:
    """Writes events in ranges of players and returns their totals and the files' size."""
    made.repartitionByRange(partitions, "player_id").sortWithinPartitions("player_id", "timestamp").write.mode("overwrite").option("compression", "snappy").parquet(path)
    back = made.sparkSession.read.parquet(path)
    files = back.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("b")).distinct().agg((F.sum("b") / 1e6).alias("mb"), F.count("*").alias("n_files"))
    return back.agg(F.count("*").alias("n_events"), F.count_distinct("session_id").alias("n_sessions")).crossJoin(files)  # one row each
