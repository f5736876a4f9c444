"""All queries of the library over the driver's tables, each with SQL that checks it where SQL can."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexflow.functions import geo, stats, time
from hexflow import sinks
from hexflow.operators import clusters, explore, features, ranking, sampling
from hexflow.plans import oracle
from hexflow.plans.oracle import CUTOFF, FUTURE, HEX_FEATURES, PAST, PLAYER_FEATURES, START, sql
from hexflow.sources import synthetic, tables
from hexflow.store import Scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KEYS = "player_id, day_of_week, period"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name}"


def n(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


def query(check: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if check:
            ORACLES[f.__name__] = check
        return f

    return add


def past(spark: SparkSession, d: str) -> DataFrame:
    return features.before(tables.events(spark, d), CUTOFF)


# scans, expressions, filters


@query(sql(f"SELECT {KEYS}, hex_id, {n('count(*)', 'n_visits')} FROM m_events GROUP BY ALL"))
def visits_by_window(spark, d):
    return features.visits(tables.events(spark, d))


@query("SELECT event_id, user_id, event_type FROM events")
def scan_pruned(spark, d):
    return tables.read_table(spark, f"{d}/events.parquet", ["event_id", "user_id", "event_type"])


@query("SELECT CAST(NULL AS VARCHAR) AS event_id, CAST(NULL AS VARCHAR) AS player_id, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon, CAST(NULL AS VARCHAR) AS event_type, CAST(NULL AS VARCHAR) AS session_id, CAST(NULL AS DOUBLE) AS distance_from_home_km, CAST(NULL AS INT) AS hour, CAST(NULL AS INT) AS day_of_week WHERE false")
def empty_relation(spark, d):
    return tables.empty_events(spark)


@query(sql(f"SELECT player_id, archetype, {r('home_lat', 'home_lat')}, {r('home_lon', 'home_lon')} FROM m_players"))
def players(spark, d):
    return tables.players(spark, d)


@query(sql(f"SELECT event_id, {r('0.5 / 111', 'lat_degrees')}, {r('0.5 / (111 * cos(radians(lat)))', 'lon_degrees')} FROM m_events"))
def km_to_degrees(spark, d):
    half = F.lit(0.5)
    return tables.events(spark, d).select("event_id", geo.km_to_degrees_lat(half).alias("lat_degrees"), geo.km_to_degrees_lon(half, F.col("lat")).alias("lon_degrees"))


@query(sql(f"SELECT event_id, {r(oracle.haversine('home_lat', 'home_lon', 'lat', 'lon'), 'distance_km')} FROM m_events"))
def haversine_home_distance(spark, d):
    return features.with_distance(tables.events(spark, d)).select("event_id", "distance_km")


@query(sql("SELECT event_id, hex_id FROM m_events"))
def hex_assign(spark, d):
    return tables.events(spark, d).select("event_id", "hex_id")


@query(sql(f"SELECT hex_id, {r(oracle.centroid('hex_id')[0], 'lat')}, {r(oracle.centroid('hex_id')[1], 'lon')} FROM (SELECT DISTINCT hex_id FROM m_events)"))
def hex_centroid(spark, d):
    lat, lon = geo.hex_centroid(F.col("hex_id"))
    return tables.events(spark, d).select("hex_id").distinct().select("hex_id", lat.alias("lat"), lon.alias("lon"))


@query(f"SELECT CAST(res AS INT) AS resolution, {r('0.737 * power(7, 8 - res)', 'area_km2')} FROM range(16) t(res)")
def hex_area(spark, d):
    return spark.createDataFrame([(k, geo.cell_area_km2(k)) for k in range(16)], "resolution int, area_km2 double")


@query(sql(f"SELECT period, {n('count(*)', 'n')} FROM m_events GROUP BY 1"))
def period_bucket_counts(spark, d):
    return tables.events(spark, d).groupBy("period").agg(F.count("*").alias("n"))


@query(sql(f"SELECT CAST(ts AS DATE) AS day, hour, day_of_week, isodow(ts) >= 6 AS is_weekend, {n('count(*)', 'n')} FROM m_events GROUP BY ALL"))
def calendar_parts(spark, d):
    ev = tables.events(spark, d).withColumn("day", F.to_date("ts"))
    return ev.groupBy("day", "hour", "day_of_week", time.is_weekend(F.col("day")).alias("is_weekend")).agg(F.count("*").alias("n"))


@query(sql(f"SELECT player_id, {r('epoch(max(ts) - min(ts)) / 60', 'minutes', 3)}, {n('''date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE))''', 'days')} FROM m_events GROUP BY 1"))
def intervals(spark, d):
    both = tables.events(spark, d).groupBy("player_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return both.select("player_id", F.round(time.minutes_between(F.col("a"), F.col("b")), 3).alias("minutes"), F.date_diff("b", "a").cast("long").alias("days"))


@query(sql(f"SELECT player_id, {r('ln(1 + count(*))', 'log_events')}, {r('''count(*) FILTER (event_type = 'click') / count(*)''', 'click_ratio')} FROM m_events GROUP BY 1"))
def log_and_ratio(spark, d):
    clicks = F.count_if(F.col("event_type") == "click")
    return tables.events(spark, d).groupBy("player_id").agg(F.log1p(F.count("*").cast("double")).alias("log_events"), stats.safe_ratio(clicks, F.count("*")).alias("click_ratio"))


@query(sql(f"SELECT player_id, {r('avg(CASE WHEN day_of_week < 5 THEN 1.0 ELSE 0 END)', 'weekday_ratio')}, {r('avg(CASE WHEN hour >= 18 THEN 1.0 ELSE 0 END)', 'evening_ratio')} FROM m_events GROUP BY 1"))
def weekday_evening_ratio(spark, d):
    return tables.events(spark, d).groupBy("player_id").agg(stats.share_where(F.col("day_of_week") < 5).alias("weekday_ratio"), stats.share_where(time.is_evening(F.col("hour"))).alias("evening_ratio"))


@query(sql(f"SELECT CASE WHEN ts < TIMESTAMP '{CUTOFF}' THEN 'train' ELSE 'test' END AS split, {n('count(*)', 'n')} FROM m_events GROUP BY 1"))
def temporal_split_counts(spark, d):
    ev = tables.events(spark, d)
    train, test = features.before(ev, CUTOFF), features.since(ev, CUTOFF)
    return train.agg(F.count("*").alias("n")).select(F.lit("train").alias("split"), "n").unionByName(test.agg(F.count("*").alias("n")).select(F.lit("test").alias("split"), "n"))


@query(sql("SELECT event_id, player_id FROM m_events WHERE player_id IN (SELECT player_id FROM m_players WHERE archetype = 'night_owl')"))
def allow_list_semi_join(spark, d):
    return features.allow(tables.events(spark, d), tables.players(spark, d).filter("archetype = 'night_owl'"), "player_id").select("event_id", "player_id")


@query(f"SELECT {n('count(value)', 'n_value')}, {n('count(*) - count(props)', 'n_null_props')} FROM events")
def null_tests(spark, d):
    ev = tables.read_table(spark, f"{d}/events.parquet", ["value", "props"])
    return ev.agg(F.count_if(F.col("value").isNotNull()).alias("n_value"), F.count_if(F.col("props").isNull()).alias("n_null_props"))


# aggregations


@query(sql(f"SELECT player_id, hex_id, {n('count(*)', 'n_visits')} FROM m_events GROUP BY ALL"))
def player_hex_counts(spark, d):
    return features.pair_counts(tables.events(spark, d))


@query(sql(f"SELECT hex_id, archetype, {n('count(*)', 'n_events')}, {n('count(DISTINCT player_id)', 'n_players')} FROM m_events GROUP BY ALL"))
def hex_archetype_counts(spark, d):
    return features.hex_archetype_counts(tables.events(spark, d))


@query(sql(f"SELECT e.hex_id, p.archetype, {n('count(*)', 'n_events')}, {n('count(DISTINCT e.player_id)', 'n_players')} FROM m_events e JOIN m_players p USING (player_id) GROUP BY ALL"))
def hex_archetype_join(spark, d):
    """The archetype comes from the table of players, as it does where events carry none."""
    ev = tables.events(spark, d).drop("archetype").join(tables.players(spark, d).select("player_id", "archetype"), "player_id")
    return features.hex_archetype_counts(ev)


@query(sql("SELECT * FROM hex_features", PAST, HEX_FEATURES))
def hex_features(spark, d):
    return features.hex_features(tables.events(spark, d), CUTOFF)


_PF = ["player_total_events_log", "player_events_per_session_mean", "player_active_days_ratio", "player_weekday_ratio", "player_evening_ratio", "player_hour_concentration", "player_distance_from_home_mean_km", "player_unique_hexes_count_log"]
_PF_SQL = ", ".join(r(c, c) for c in _PF)


@query(sql(f"SELECT player_id, player_unique_sessions, player_archetype, {_PF_SQL} FROM player_features", PAST, PLAYER_FEATURES))
def player_features(spark, d):
    return features.player_features(tables.events(spark, d), tables.players(spark, d), START, CUTOFF)


@query(sql(f"SELECT player_id, {r('1 + sum(p * ln(p)) / ln(24)', 'hour_concentration')} FROM (SELECT player_id, count(*) / sum(count(*)) OVER (PARTITION BY player_id) AS p FROM m_events GROUP BY player_id, hour) GROUP BY 1"))
def hour_concentration(spark, d):
    return features.hour_concentration(tables.events(spark, d))


_ENTROPY = "CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) ELSE 0 END"
_FOOT = "(SELECT player_id, count(*) / sum(count(*)) OVER (PARTITION BY player_id) AS p FROM m_events GROUP BY player_id, hex_id)"


@query(sql(f"SELECT player_id, {n('count(*)', 'unique_hexes')}, {r(_ENTROPY, 'hex_entropy')} FROM {_FOOT} GROUP BY 1"))
def hex_entropy(spark, d):
    return features.footprint(tables.events(spark, d))


_HOURS = [r(f"count(*) FILTER (hour = {h}) / count(*)", f"hour_density_{h:02d}") for h in range(24)]
_DOWS = [r(f"count(*) FILTER (day_of_week = {k}) / count(*)", f"dow_density_{k}") for k in range(7)]


@query(sql(f"SELECT player_id, {', '.join(_HOURS)} FROM m_events GROUP BY 1"))
def hour_histogram(spark, d):
    return tables.events(spark, d).groupBy("player_id").agg(*stats.densities(F.col("hour"), range(24), "hour_density_{:02d}"))


@query(sql(f"SELECT player_id, {', '.join(_DOWS)} FROM m_events GROUP BY 1"))
def dow_histogram(spark, d):
    return tables.events(spark, d).groupBy("player_id").agg(*stats.densities(F.col("day_of_week"), range(7), "dow_density_{}"))


_DIST = oracle.haversine("home_lat", "home_lon", "lat", "lon")
_DISTANCE = ["avg(d)", "stddev_pop(d)", *[f"quantile_cont(d, {p})" for p in (0.25, 0.75, 0.95)]]
_DISTANCE_NAMES = [f"distance_from_home_{x}" for x in ("mean", "std", "p25", "p75", "p95")]
_DISTANCE_SQL = f"SELECT player_id, {', '.join(r(e, m) for e, m in zip(_DISTANCE, _DISTANCE_NAMES, strict=True))} FROM (SELECT player_id, {_DIST} AS d FROM m_events) GROUP BY 1"


@query(sql(_DISTANCE_SQL))
def distance_stats(spark, d):
    return features.distance_stats(tables.events(spark, d))


def _cyclical(names: dict[str, str]) -> str:
    cols = []
    for name, col, cycle in (("hour", "hour", 24), ("dow", "day_of_week", 7)):
        a = f"{col} * {oracle.num(2 * math.pi / cycle)}"
        s, c = f"avg(sin({a}))", f"avg(cos({a}))"
        cols += [r(s, f"{name}_mean_sin"), r(c, f"{name}_mean_cos"), r(f"sqrt(power({s}, 2) + power({c}, 2))", names[name])]
    return f"SELECT player_id, {', '.join(cols)} FROM m_events GROUP BY 1"


@query(sql(_cyclical({"hour": "hour_resultant", "dow": "dow_resultant"})))
def cyclical_features(spark, d):
    return features.cyclical(tables.events(spark, d))


@query(sql("SELECT event_id, player_id, session_seq, md5(player_id || '|' || session_seq) AS session_id FROM numbered", oracle.sessions("m_events", 360)))
def sessions(spark, d):
    return features.sessions(tables.events(spark, d), 360).select("event_id", "player_id", "session_seq", "session_id")


_ROLLUP = "rollup_ AS (SELECT player_id, session_seq, count(*) AS n_events, epoch(max(ts) - min(ts)) / 60 AS minutes FROM numbered GROUP BY ALL)"
_SESSION_STATS = f"SELECT player_id, {n('count(*)', 'total_sessions')}, {r('avg(n_events)', 'mean_events_per_session')}, {r('median(n_events)', 'median_events_per_session')}, {r('stddev_pop(n_events)', 'std_events_per_session')}, {r('avg(minutes)', 'mean_session_duration_minutes')} FROM rollup_ GROUP BY 1"


@query(sql(_SESSION_STATS, oracle.sessions("m_events", 360), _ROLLUP))
def session_stats(spark, d):
    return features.session_stats(features.session_rollup(features.sessions(tables.events(spark, d), 360)))


_PROFILE = f"""SELECT * FROM (SELECT player_id, {', '.join(_HOURS)}, {', '.join(_DOWS)}, {r('avg(CASE WHEN day_of_week < 5 THEN 1.0 ELSE 0 END)', 'weekday_ratio')},
  {r('avg(CASE WHEN hour >= 18 THEN 1.0 ELSE 0 END)', 'evening_ratio')}, {n('count(*)', 'total_events')}, {r('count(*) / count(DISTINCT CAST(ts AS DATE))', 'events_per_active_day')},
  {r('count(DISTINCT CAST(ts AS DATE)) / 180', 'active_days_ratio')} FROM m_events GROUP BY 1)
  JOIN ({_cyclical({"hour": "hour_concentration", "dow": "dow_concentration"})}) USING (player_id) JOIN ({_DISTANCE_SQL}) USING (player_id)
  JOIN (SELECT player_id, {n('count(*)', 'unique_hexes')}, {r(_ENTROPY, 'hex_entropy')} FROM {_FOOT} GROUP BY 1) USING (player_id)
  JOIN ({_SESSION_STATS}) USING (player_id) LEFT JOIN (SELECT player_id, archetype FROM m_players) USING (player_id)"""


@query(sql(_PROFILE, oracle.sessions("m_events"), _ROLLUP))
def features_54(spark, d):
    return features.profile(tables.events(spark, d), tables.players(spark, d))


@query(sql(f"SELECT {n('count(*)', 'n_events')}, {n('''count(DISTINCT player_id || '|' || session_seq)''', 'n_sessions')} FROM numbered", oracle.sessions("m_events")))
def batch_totals(spark, d):
    return features.sessions(tables.events(spark, d)).agg(F.count("*").alias("n_events"), F.count_distinct("player_id", "session_seq").alias("n_sessions"))


# learning to rank

_P = oracle.pairs("past", "pairs")


@query(sql("SELECT DISTINCT player_id, hex_id FROM m_events"))
def player_universe(spark, d):
    return features.universe(features.visits(tables.events(spark, d)))


@query(sql(f"SELECT {KEYS}, hex_id, {n('n_visits', 'n_visits')} FROM pairs_top", PAST, _P))
def topk_positives(spark, d):
    return ranking.positives(features.visits(past(spark, d))).select(*ranking.KEY, "hex_id", "n_visits")


@query(sql(f"SELECT {KEYS}, group_id FROM pairs_ids", PAST, _P))
def query_ids(spark, d):
    return ranking.query_ids(features.visits(past(spark, d)))


@query(sql(f"SELECT {KEYS}, hex_id FROM pairs_cand", PAST, _P))
def negatives_anti_join(spark, d):
    visited = features.visits(past(spark, d))
    return ranking.candidates(visited, ranking.positives(visited)).select(*ranking.KEY, "hex_id")


@query(sql(f"SELECT {KEYS}, hex_id FROM pairs_neg", PAST, _P))
def negatives_sample(spark, d):
    return ranking.negatives(features.visits(past(spark, d)))


_PAIR_COLUMNS = f"{KEYS}, hex_id, CAST(label AS INT) AS label, group_id"


@query(sql(f"SELECT {_PAIR_COLUMNS} FROM pairs", PAST, _P))
def ltr_pairs_train(spark, d):
    return ranking.pairs(features.visits(past(spark, d)))


@query(sql(f"SELECT {_PAIR_COLUMNS} FROM pairs", FUTURE, oracle.pairs("future", "pairs")))
def ltr_pairs_test(spark, d):
    return ranking.pairs(features.visits(features.since(tables.events(spark, d), CUTOFF)))


@query(sql(f"SELECT {_PAIR_COLUMNS} FROM pairs", PAST, oracle.pairs("past", "pairs", all_visited=True)))
def ltr_pairs_unvisited(spark, d):
    return ranking.pairs(features.visits(past(spark, d)), exclude_all_visited=True)


@query(sql(f"SELECT {n('count(*)', 'n_rows')}, {n('sum(label)', 'n_positives')}, {n('count(DISTINCT group_id)', 'n_queries')}, {r('count(*) / count(DISTINCT group_id)', 'rows_per_query', 4)} FROM pairs", PAST, _P))
def dataset_summary(spark, d):
    rows = ranking.pairs(features.visits(past(spark, d)))
    out = rows.agg(F.count("*").alias("n_rows"), F.sum("label").alias("n_positives"), F.count_distinct("group_id").alias("n_queries"))
    return out.withColumn("rows_per_query", F.round(F.col("n_rows") / F.col("n_queries"), 4))


_ENRICHED_CTES = (PAST, PLAYER_FEATURES, HEX_FEATURES, _P, oracle.enriched("pairs"))
_ENRICHED_COLUMNS = f"{_PAIR_COLUMNS}, pair_past_visits, {r('pair_distance_from_home_km', 'pair_distance_from_home_km')}, player_unique_sessions, player_archetype, {_PF_SQL}, hex_global_popularity, hex_total_visits, hex_n_unique_archetypes"


def _enriched(spark: SparkSession, d: str, side: int = 0, serving: bool = False) -> DataFrame:
    """Enriched pairs before (side 0) or since the cutoff; for serving, distinct (player, cell) pairs, whose features no window changes."""
    ev, people = ranking.saved_events(tables.events(spark, d)), tables.players(spark, d)
    rows = ranking.pairs(features.visits((features.before, features.since)[side](ev, CUTOFF)))
    rows = rows.select("player_id", "hex_id").distinct() if serving else rows
    return ranking.enrich(rows, features.before(ev, CUTOFF), people, features.player_features(ev, people, START, CUTOFF), features.hex_features(ev, CUTOFF))


@query(sql(f"SELECT {_PAIR_COLUMNS}, pair_past_visits, {r('pair_distance_from_home_km', 'pair_distance_from_home_km')} FROM enriched", *_ENRICHED_CTES))
def pair_features(spark, d):
    ev = tables.events(spark, d)
    return ranking.add_pair_features(ranking.pairs(features.visits(past(spark, d))), features.pair_counts(features.before(ev, CUTOFF)), tables.players(spark, d))


@query(sql(f"SELECT {_ENRICHED_COLUMNS} FROM enriched", *_ENRICHED_CTES))
def enriched_train(spark, d):
    return _enriched(spark, d)


_HEX = ("hex_global_popularity", "hex_total_visits", "hex_n_unique_archetypes")
_ENRICHED_TEST = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _HEX)}) FROM (SELECT {_ENRICHED_COLUMNS} FROM enriched)"


@query(sql(_ENRICHED_TEST, PAST, FUTURE, PLAYER_FEATURES, HEX_FEATURES, oracle.pairs("future", "pairs"), oracle.enriched("pairs")))
def enriched_test(spark, d):
    return _enriched(spark, d, 1).withColumns({c: F.col(c).cast("double") for c in _HEX})  # null for cells first seen in the test period


@query(sql(f"SELECT group_id, {n('count(*)', 'n_rows')} FROM pairs GROUP BY 1", PAST, _P))
def group_sizes(spark, d):
    return ranking.group_sizes(ranking.pairs(features.visits(past(spark, d))))


@query(sql(f"SELECT CAST(run AS BIGINT) AS run, event_type, {n('count(*)', 'n_rows')} FROM (SELECT event_type, sum(new) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) THEN 1 ELSE 0 END AS new FROM m_events)) GROUP BY ALL"))
def contiguous_runs(spark, d):
    return ranking.contiguous_runs(tables.read_table(spark, f"{d}/events.parquet", ["event_id", "event_type"]), ["event_id"], "event_type")


_GROUPS = "grp AS (SELECT group_id, row_number() OVER (ORDER BY md5('42|' || group_id), group_id) AS rank, count(*) OVER () AS total FROM (SELECT DISTINCT group_id FROM pairs))"


@query(sql(f"SELECT {_PAIR_COLUMNS} FROM pairs WHERE group_id IN (SELECT group_id FROM grp WHERE rank <= floor(total * 0.2))", PAST, _P, _GROUPS))
def group_holdout(spark, d):
    return ranking.split_groups(ranking.pairs(features.visits(past(spark, d))), 0.2)[1]


@query(sql(f"SELECT {_PAIR_COLUMNS} FROM pairs WHERE group_id IN (SELECT group_id FROM grp WHERE rank <= 100)", PAST, _P, _GROUPS))
def group_subsample(spark, d):
    return ranking.subsample_groups(ranking.pairs(features.visits(past(spark, d))), 100)


@query(sql("SELECT player_id, archetype FROM (SELECT *, row_number() OVER (PARTITION BY archetype ORDER BY md5('42|' || player_id), player_id) AS rank, count(*) OVER (PARTITION BY archetype) AS n FROM m_players) WHERE rank <= ceil(n * 0.5)"))
def stratified_players(spark, d):
    return ranking.stratified(tables.players(spark, d), 0.5).select("player_id", "archetype")


_METRICS = ", ".join(r(f"avg({e})", m) for e, m in (("ndcg_10", "ndcg_10"), ("ndcg_20", "ndcg_20"), ("ap", "map"), ("rr", "mrr"), ("p5", "precision_5"), ("p10", "precision_10"))) + ", " + n("count(*)", "n_queries")
_TEST_CTES = (PAST, FUTURE, PLAYER_FEATURES, HEX_FEATURES, oracle.pairs("future", "pairs"), oracle.enriched("pairs"))


@query(sql(f"SELECT {_METRICS} FROM mt_query", *_TEST_CTES, "scored AS (SELECT group_id, hex_id, label, pair_past_visits AS score FROM enriched)", oracle.metrics("scored")))
def rank_metrics_past_visits(spark, d):
    ev = tables.events(spark, d)
    rows = ranking.pairs(features.visits(features.since(ev, CUTOFF)))
    scored = ranking.add_pair_features(rows, features.pair_counts(features.before(ev, CUTOFF)), tables.players(spark, d))
    return ranking.ranking_metrics(scored.withColumn("score", F.col("pair_past_visits")))


_HASH_SCORE = "CAST(ascii(substr(md5('7|' || group_id || '|' || hex_id), 1, 1)) * 256 + ascii(substr(md5('7|' || group_id || '|' || hex_id), 2, 1)) AS DOUBLE)"


def _random_score():
    h = ranking.draw("group_id", "hex_id", seed=7)
    return (F.ascii(F.substring(h, 1, 1)) * 256 + F.ascii(F.substring(h, 2, 1))).cast("double")


@query(sql(f"SELECT {_METRICS} FROM mt_query", FUTURE, oracle.pairs("future", "pairs"), f"scored AS (SELECT group_id, hex_id, label, {_HASH_SCORE} AS score FROM pairs)", oracle.metrics("scored")))
def rank_metrics_random(spark, d):
    rows = ranking.pairs(features.visits(features.since(tables.events(spark, d), CUTOFF)))
    return ranking.ranking_metrics(rows.withColumn("score", _random_score()))


@query(sql(f"SELECT group_id, {r('ndcg_10', 'ndcg_10')}, {r('ap', 'average_precision')}, {r('rr', 'reciprocal_rank')}, {r('p5', 'precision_5')} FROM mt_query", FUTURE, oracle.pairs("future", "pairs"), f"scored AS (SELECT group_id, hex_id, label, {_HASH_SCORE} AS score FROM pairs)", oracle.metrics("scored")))
def query_metrics(spark, d):
    rows = ranking.pairs(features.visits(features.since(tables.events(spark, d), CUTOFF))).withColumn("score", _random_score())
    return ranking.query_metrics(rows).select("group_id", "ndcg_10", "average_precision", "reciprocal_rank", "precision_5")


_SERVING = "serving AS (SELECT DISTINCT player_id, hex_id, pair_past_visits, round(pair_distance_from_home_km, 6) AS pair_distance_from_home_km, hex_total_visits FROM enriched)"


@query(sql("SELECT player_id, hex_id, pair_past_visits, pair_distance_from_home_km + 0.0 AS pair_distance_from_home_km, hex_total_visits FROM serving", *_ENRICHED_CTES, _SERVING))
def serving_features(spark, d):
    return ranking.serving_table(_enriched(spark, d, serving=True)).select("player_id", "hex_id", "pair_past_visits", "pair_distance_from_home_km", "hex_total_visits")


@query(sql("SELECT player_id AS request_id, player_id, CAST(rn AS INT) AS position, hex_id, CAST(pair_past_visits AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY pair_past_visits DESC, hex_id) AS rn FROM serving) WHERE rn <= 5", *_ENRICHED_CTES, _SERVING))
def serve_rank_batch(spark, d):
    requests = tables.players(spark, d).select(F.col("player_id").alias("request_id"), "player_id", F.lit(2).alias("day_of_week"), F.lit("evening").alias("period"), F.lit(5).alias("top_k"))
    return ranking.rank_batch(requests, ranking.serving_table(_enriched(spark, d, serving=True)), F.col("pair_past_visits").cast("double"))


@query(sql(f"SELECT {n('count(DISTINCT player_id)', 'known_players')} FROM serving", *_ENRICHED_CTES, _SERVING))
def known_players(spark, d):
    return ranking.serving_table(_enriched(spark, d, serving=True)).agg(F.count_distinct("player_id").alias("known_players"))


# clustering evaluation; the clusters are a fixed function of the first two coordinates

_CLUSTERED = "clustered AS (SELECT vec_id, label, CASE WHEN abs(embedding[1]) < 0.01 THEN -1 ELSE (CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END) + (CASE WHEN embedding[2] > 0 THEN 2 ELSE 0 END) END AS cluster FROM embeddings), cells AS (SELECT cluster, label, count(*) AS n FROM clustered GROUP BY ALL)"


def _clustered(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    cluster = F.when(F.abs(e[0].cast("double")) < 0.01, -1).otherwise(F.when(e[0] > 0, 1).otherwise(0) + F.when(e[1] > 0, 2).otherwise(0))
    return tables.read_table(spark, f"{d}/embeddings.parquet").select("vec_id", "label", cluster.alias("cluster"))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return clusters.contingency(_clustered(spark, d), "cluster", "label")


@query(f"WITH {_CLUSTERED} SELECT cluster, label, {n('n', 'n')} FROM cells")
def contingency(spark, d):
    return _cells(spark, d)


@query(f"WITH {_CLUSTERED} SELECT cluster, {r('max(n) / sum(n)', 'purity')} FROM cells GROUP BY 1")
def cluster_purity(spark, d):
    return clusters.purity(_cells(spark, d))


@query(f"WITH {_CLUSTERED} SELECT cluster, label AS dominant, {n('n', 'n')} FROM cells QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) = 1")
def cluster_dominant(spark, d):
    return clusters.dominant(_cells(spark, d))


@query(f"WITH {_CLUSTERED} SELECT cluster, label, {n('n', 'n')}, {r('n / sum(n) OVER (PARTITION BY cluster)', 'share')} FROM cells")
def confusion_normalised(spark, d):
    return clusters.row_shares(_cells(spark, d))


@query(f"WITH {_CLUSTERED} SELECT {n('count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END)', 'n_clusters')}, {r('avg(CASE WHEN cluster = -1 THEN 1.0 ELSE 0 END)', 'noise_fraction')} FROM clustered")
def cluster_counts(spark, d):
    return clusters.cluster_counts(_clustered(spark, d), "cluster")


@query(f"""WITH {_CLUSTERED}, a AS (SELECT cluster, sum(n) AS a FROM cells GROUP BY 1), b AS (SELECT label, sum(n) AS b FROM cells GROUP BY 1), t AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM cells),
 s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM cells) AS ij, (SELECT sum(a * (a - 1) / 2) FROM a) AS ai, (SELECT sum(b * (b - 1) / 2) FROM b) AS bj, (SELECT t * (t - 1) / 2 FROM t) AS tt,
  (SELECT sum(n / t * ln(n * t / (a * b))) FROM cells JOIN a USING (cluster) JOIN b USING (label), t) AS mi, (SELECT -sum(a / t * ln(a / t)) FROM a, t) AS hc, (SELECT -sum(b / t * ln(b / t)) FROM b, t) AS hl)
 SELECT {r('(ij - ai * bj / tt) / ((ai + bj) / 2 - ai * bj / tt)', 'ari')}, {r('mi / hl', 'homogeneity')}, {r('mi / hc', 'completeness')}, {r('mi / ((hc + hl) / 2)', 'nmi')}, {r('2 * (mi / hl) * (mi / hc) / (mi / hl + mi / hc)', 'v_measure')} FROM s""")
def cluster_metrics(spark, d):
    return clusters.agreement(_cells(spark, d))


@query(f"WITH x AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x0, CAST(embedding[2] AS DOUBLE) AS x1 FROM embeddings), m AS (SELECT avg(x0) AS a0, stddev_pop(x0) AS s0, avg(x1) AS a1, stddev_pop(x1) AS s1 FROM x) SELECT vec_id, {r('(x0 - a0) / s0', 'x0')}, {r('(x1 - a1) / s1', 'x1')} FROM x, m")
def zscore_features(spark, d):
    e = F.col("embedding")
    two = tables.read_table(spark, f"{d}/embeddings.parquet").select("vec_id", e[0].cast("double").alias("x0"), e[1].cast("double").alias("x1"))
    return clusters.standardise(two, ["x0", "x1"])


# exploration


@query(sql(f"SELECT archetype, hour, {n('count(*)', 'n')}, {r('count(*) / sum(count(*)) OVER (PARTITION BY archetype)', 'density')} FROM m_events GROUP BY archetype, hour"))
def eda_archetype_hour_density(spark, d):
    return explore.group_density(tables.events(spark, d), "archetype", "hour")


@query(sql(f"SELECT archetype, {', '.join(n(f'count(*) FILTER (hour = {h})', f'h{h:02d}') for h in range(24))} FROM m_events GROUP BY 1"))
def eda_pivot_hours(spark, d):
    return explore.pivot_hours(tables.events(spark, d), "archetype")


@query(sql(f"SELECT archetype, hour, {n('n', 'n')}, CAST(rank AS INT) AS rank FROM (SELECT archetype, hour, count(*) AS n, row_number() OVER (PARTITION BY archetype ORDER BY count(*) DESC, hour) AS rank FROM m_events GROUP BY 1, 2) WHERE rank <= 3"))
def eda_top_hours(spark, d):
    return explore.top_values(tables.events(spark, d), "archetype", "hour")


@query(sql(f"SELECT archetype, {n('count(*)', 'n')}, {r('100.0 * count(*) / sum(count(*)) OVER ()', 'percent')} FROM m_players GROUP BY 1"))
def eda_value_shares(spark, d):
    return explore.value_shares(tables.players(spark, d), "archetype")


_SESSION_EDA = f"SELECT archetype, {n('count(*)', 'n_sessions')}, {r('avg(n_events)', 'mean_events', 2)}, {r('median(n_events)', 'median_events', 2)}, {r('stddev_samp(n_events)', 'std_events', 2)} FROM rollup_ JOIN m_players USING (player_id) GROUP BY 1"


@query(sql(_SESSION_EDA, oracle.sessions("m_events", 360), _ROLLUP))
def eda_session_stats(spark, d):
    return explore.session_summary(features.session_rollup(features.sessions(tables.events(spark, d), 360)), tables.players(spark, d))


@query(sql(f"SELECT archetype, {n('s', 'n_sessions')}, {n('p', 'n_players')}, {r('s / p', 'sessions_per_player')} FROM (SELECT archetype, count(*) AS s FROM rollup_ JOIN m_players USING (player_id) GROUP BY 1) JOIN (SELECT archetype, count(*) AS p FROM m_players GROUP BY 1) USING (archetype)", oracle.sessions("m_events", 360), _ROLLUP))
def eda_sessions_per_player(spark, d):
    return explore.sessions_per_player(features.session_rollup(features.sessions(tables.events(spark, d), 360)), tables.players(spark, d))


@query(sql(f"SELECT min(ts) AS first_ts, max(ts) AS last_ts, {n('''date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1''', 'n_days')}, {r('min(value)', 'min_value')}, {r('max(value)', 'max_value')} FROM m_events"))
def eda_ranges(spark, d):
    ev = tables.events(spark, d).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))
    return ev.select("first_ts", "last_ts", (F.date_diff("last_ts", "first_ts") + 1).cast("long").alias("n_days"), "min_value", "max_value")


@query(sql(f"SELECT bin, {n('count(*)', 'n')}, {r('count(*) / sum(count(*)) OVER () / 0.08', 'density')} FROM (SELECT CAST(least(floor(d / {oracle.num(4 / 50)}), 49) AS INT) AS bin FROM (SELECT {_DIST} AS d FROM m_events) WHERE d BETWEEN 0 AND 4) GROUP BY bin"))
def eda_histogram(spark, d):
    return explore.histogram(features.with_distance(tables.events(spark, d)), "distance_km", 0.0, 4.0)


_WANTED = ", ".join(f"('{p[0]}', {oracle.num(100 * p[7])})" for p in synthetic.PROFILES)


@query(sql(f"SELECT archetype, {r('coalesce(o, 0)', 'observed')}, {r('w', 'wanted')}, {r('coalesce(o, 0) - w', 'delta')} FROM (VALUES {_WANTED}) v(archetype, w) LEFT JOIN (SELECT archetype, 100.0 * count(*) / sum(count(*)) OVER () AS o FROM m_players GROUP BY 1) USING (archetype)"))
def distribution_delta(spark, d):
    wanted = spark.createDataFrame([(p[0], 100 * p[7]) for p in synthetic.PROFILES], "archetype string, wanted double")
    return explore.distribution_delta(tables.players(spark, d), "archetype", wanted)


_BUMPS = " UNION ALL ".join(f"SELECT '{p[0]}' AS archetype, '{kind}' AS day_kind, h, {' + '.join(f'exp(-0.5 * power(least(abs(h - {k}), 24 - abs(h - {k})) / 2.5, 2))' for k in peaks)} AS v FROM hours" for p in synthetic.PROFILES for kind, peaks in (("weekday", p[1]), ("weekend", p[2])))


@query(f"WITH hours AS (SELECT CAST(range AS INT) AS h FROM range(24)), bumps AS ({_BUMPS} UNION ALL SELECT 'any', 'atypical', h, CASE WHEN h < 6 THEN 0.3 ELSE 1 END FROM hours) SELECT archetype, day_kind, h AS hour, {r('v / sum(v) OVER (PARTITION BY archetype, day_kind)', 'density')} FROM bumps")
def hour_density_table(spark, d):
    return synthetic.hour_table(spark)


# set operations


@query(sql("(SELECT DISTINCT player_id, hex_id FROM past EXCEPT SELECT DISTINCT player_id, hex_id FROM future)", PAST, FUTURE))
def set_difference(spark, d):
    ev = tables.events(spark, d)
    return features.universe(features.before(ev, CUTOFF)).exceptAll(features.universe(features.since(ev, CUTOFF)))


@query(sql("SELECT player_id, hex_id FROM past UNION SELECT player_id, hex_id FROM future", PAST, FUTURE))
def set_union(spark, d):
    ev = tables.events(spark, d)
    return features.universe(features.before(ev, CUTOFF)).union(features.universe(features.since(ev, CUTOFF))).distinct()


# samples and summaries


_DRAWN = "md5('42|' || event_id)"


@query(f"SELECT event_id, event_type FROM events ORDER BY {_DRAWN}, event_id LIMIT 500")
def uniform_sample(spark, d):
    return sampling.uniform(tables.read_table(spark, f"{d}/events.parquet", ["event_id", "event_type"]), 500, "event_id")


@query(sql("SELECT player_id, archetype FROM m_players QUALIFY row_number() OVER (PARTITION BY archetype ORDER BY md5('42|' || player_id), player_id) <= 5"))
def sample_per_archetype(spark, d):
    return sampling.per_group(tables.players(spark, d), "archetype", 5, "player_id").select("player_id", "archetype")


@query("SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id LIMIT 50")
def head_rows(spark, d):
    return sampling.head(tables.read_table(spark, f"{d}/events.parquet", ["event_id", "user_id", "event_type", "value"]), 50, "event_id")


_DESCRIBED = ("value", "hour", "lat")


@query(sql(" UNION ALL ".join(f"SELECT '{c}' AS column, {n(f'count({c})', 'n')}, {r(f'avg({c})', 'mean', 4)}, {r(f'stddev_samp({c})', 'std', 4)}, {r(f'min({c})', 'min')}, {', '.join(r(f'quantile_cont(CAST({c} AS DOUBLE), {p / 100})', f'p{p}') for p in (25, 50, 75))}, {r(f'max({c})', 'max')} FROM m_events" for c in _DESCRIBED)))
def describe_events(spark, d):
    out = explore.describe(tables.events(spark, d), list(_DESCRIBED))
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@query(sql(f"SELECT hex_id, {n('count(*)', 'n_visits')} FROM m_events GROUP BY 1"))
def non_negative_counts(spark, d):
    return sampling.non_negative(tables.events(spark, d).groupBy("hex_id").agg(F.count("*").alias("n_visits")), "n_visits")


_SHARES = "cut AS (SELECT group_id FROM grp WHERE rank <= CAST(floor(total * 0.3) AS BIGINT))"


@query(sql(f"SELECT {_PAIR_COLUMNS} FROM pairs WHERE group_id IN (SELECT group_id FROM cut)", PAST, _P, _GROUPS, _SHARES))
def train_validation_shares(spark, d):
    rows = ranking.pairs(features.visits(past(spark, d)))
    return ranking.subsample_train_validation(rows, rows, 0.3, 0.1)[0]


# tables on disk, read back


def _datasets(spark: SparkSession, d: str) -> str:
    folder = Scratch(spark, "datasets").base
    sinks.write_datasets(spark, tables.events(spark, d), tables.players(spark, d), START, CUTOFF, folder)
    return folder


@query(sql(f"SELECT {_ENRICHED_COLUMNS} FROM enriched", *_ENRICHED_CTES))
def stored_enriched_train(spark, d):
    return sinks.read_enriched(spark, _datasets(spark, d), "train")


@query(sql(f"SELECT {_PAIR_COLUMNS} FROM pairs", FUTURE, oracle.pairs("future", "pairs")))
def stored_pairs_test(spark, d):
    return sinks.read_pairs(spark, _datasets(spark, d), "test")


@query(sql(f"SELECT player_id, archetype, {r('home_lat', 'home_lat')}, {r('home_lon', 'home_lon')} FROM m_players"))
def stored_players(spark, d):
    path = Scratch(spark, "players").path("players")
    sinks.write_players(tables.players(spark, d), path)
    return tables.read_table(spark, path)


_MATRIX = ["weekday_ratio", "evening_ratio", "hour_mean_sin", "distance_from_home_mean", "mean_events_per_session", "hex_entropy"]


@query(sql(f"SELECT player_id, archetype, {', '.join(_MATRIX)} FROM ({_PROFILE})", oracle.sessions("m_events"), _ROLLUP))
def stored_feature_matrix(spark, d):
    path = Scratch(spark, "matrix").path("matrix")
    sinks.write_feature_matrix(features.profile(tables.events(spark, d), tables.players(spark, d)), path)
    split, names = sinks.read_feature_matrix(spark, path)
    x = vector_to_array("features")
    return split.select("player_id", "archetype", *[x[names.index(c)].alias(c) for c in _MATRIX])


@query(sql("SELECT player_id, hex_id, pair_past_visits, pair_distance_from_home_km + 0.0 AS pair_distance_from_home_km, hex_total_visits FROM serving", *_ENRICHED_CTES, _SERVING))
def stored_serving_features(spark, d):
    path = Scratch(spark, "serving").path("features")
    sinks.write_table(ranking.serving_table(_enriched(spark, d, serving=True)), path)
    return tables.read_table(spark, path, ["player_id", "hex_id", "pair_past_visits", "pair_distance_from_home_km", "hex_total_visits"])


# properties of random draws and models: what must hold of any right result


def _all_true(*names: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{x}', TRUE)" for x in names) + ") t(property, holds)"


def _properties(one: DataFrame, **holds) -> DataFrame:
    """(property, holds) of conditions over a table of one row."""
    rows = [F.struct(F.lit(k).alias("property"), F.coalesce(v, F.lit(False)).alias("holds")) for k, v in holds.items()]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.property", "x.holds")


@query(_all_true("ids_unique", "homes_in_city", "works_share", "works_distance", "archetype_shares", "devices"))
def generated_players_properties(spark, d):
    made = synthetic.players(spark, synthetic.Config(n_players=4000))
    km = geo.haversine_km(F.lit(geo.CENTRE[0]), F.lit(geo.CENTRE[1]), F.col("home_lat"), F.col("home_lon"))
    work = geo.haversine_km(F.col("home_lat"), F.col("home_lon"), F.col("work_lat"), F.col("work_lon"))
    shares = [F.abs(F.avg((F.col("archetype") == p[0]).cast("double")) - p[7]) < 4 * math.sqrt(p[7] / 4000) for p in synthetic.PROFILES]
    one = made.agg(
        F.count_distinct("player_id").alias("ids"), F.max(km).alias("far"), F.avg(F.col("work_lat").isNotNull().cast("double")).alias("works"), F.max(work).alias("work_far"),
        F.array(*shares).alias("shares"), F.avg((F.col("device_type") == "ios").cast("double")).alias("ios"),
    )
    return _properties(
        one, ids_unique=F.col("ids") == 4000, homes_in_city=F.col("far") <= synthetic.CITY_RADIUS_KM * 1.02, works_share=F.abs(F.col("works") - synthetic.WORK_PRESENT) < 0.03, works_distance=F.col("work_far") <= synthetic.WORK_KM[1] + 1e-9,
        archetype_shares=F.forall("shares", lambda x: x), devices=F.abs(F.col("ios") - 0.45) < 0.03,
    )


@query(_all_true("ids_unique", "in_period", "hours_fit_timestamps", "weekdays_fit_timestamps", "types", "mean_rate", "distances_follow_positions", "sessions_by_gap"))
def generated_events_properties(spark, d):
    c = synthetic.Config(n_players=200, n_days=14)
    people = synthetic.players(spark, c)
    made = Scratch(spark, "generated").save(synthetic.events(spark, people, c), "events")
    rate = sum(p[5] * p[7] * (5 * p[3] + 2 * p[4]) / 7 for p in synthetic.PROFILES)
    km = geo.haversine_km(F.col("home_lat"), F.col("home_lon"), F.col("lat"), F.col("lon"))
    rows = made.join(people.select("player_id", "home_lat", "home_lon"), "player_id")
    again = features.sessions(made.select("player_id", "event_id", F.col("timestamp").alias("ts"), F.col("session_id").alias("given")))
    same = again.agg(F.count_if(F.col("given") != F.col("session_id")).alias("other_sessions"))
    one = rows.agg(
        F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count_if(F.col("hour") != F.hour("timestamp")).alias("hours"),
        F.count_if(F.col("day_of_week") != F.weekday("timestamp")).alias("days"), F.avg((F.col("event_type") == "spin_stop").cast("double")).alias("spins"), F.max(F.abs(km - F.col("distance_from_home_km"))).alias("off"),
    ).crossJoin(same)  # one row each
    return _properties(
        one, ids_unique=F.col("ids") == F.col("n"), in_period=(F.col("first") >= F.lit("2025-01-01").cast("timestamp_ntz")) & (F.col("last") < F.lit("2025-01-15").cast("timestamp_ntz")), hours_fit_timestamps=F.col("hours") == 0,
        weekdays_fit_timestamps=F.col("days") == 0, types=F.abs(F.col("spins") - 0.45) < 0.03, mean_rate=F.abs(F.col("n") / (200 * 14) / rate - 1) < 0.5, distances_follow_positions=F.col("off") < 1e-6, sessions_by_gap=F.col("other_sessions") == 0,
    )


@query(_all_true("kmeans_has_k_clusters", "kmeans_beats_one_cluster", "gmm_probabilities_sum_to_1", "gmm_takes_the_likeliest", "pca_components_uncorrelated", "pca_variances_descend"))
def models_properties(spark, d):
    points = Scratch(spark, "models").save(_vectors(spark, d).select("vec_id", "embedding", "label"), "scaled").transform(lambda df: clusters.vectors(df, "embedding"))
    by_means = clusters.kmeans(points, 10, range(42, 44))
    x = F.posexplode(vector_to_array("features")).alias("at", "x")
    spread = by_means.select("kmeans_cluster", x).groupBy("kmeans_cluster", "at").agg(F.var_pop("x").alias("v"), F.count("*").alias("n")).agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("within"))
    counts = by_means.agg(F.count_distinct("kmeans_cluster").alias("k"))
    projected = clusters.pca(points, 3)[0]
    p = vector_to_array("pca")
    axes = projected.select(*[p[k].alias(f"c{k}") for k in range(3)]).agg(*[F.abs(F.corr(f"c{a}", f"c{b}")).alias(f"r{a}{b}") for a, b in ((0, 1), (0, 2), (1, 2))], *[F.var_pop(f"c{k}").alias(f"v{k}") for k in range(3)])
    mixed = clusters.gaussian_mixture(projected.select("vec_id", F.col("pca").alias("features")), 4).select("gmm_cluster", vector_to_array("gmm_probability").alias("q"))
    soft = mixed.agg(F.max(F.abs(F.aggregate("q", F.lit(0.0), lambda a, v: a + v) - 1)).alias("off"), F.count_if(F.array_max("q") > F.element_at("q", F.col("gmm_cluster") + 1)).alias("unlikely"))
    one = spread.crossJoin(counts).crossJoin(axes).crossJoin(soft)  # one row each
    return _properties(
        one, kmeans_has_k_clusters=F.col("k") == 10, kmeans_beats_one_cluster=F.col("within") < 1, gmm_probabilities_sum_to_1=F.col("off") < 1e-6, gmm_takes_the_likeliest=F.col("unlikely") == 0,
        pca_components_uncorrelated=F.greatest("r01", "r02", "r12") < 1e-6, pca_variances_descend=(F.col("v0") >= F.col("v1")) & (F.col("v1") >= F.col("v2")),
    )


@query(_all_true("all_rows_scored", "learns_its_training_rows", "importance_names_all_features", "saved_model_scores_alike"))
def ranker_properties(spark, d):
    from hexflow import serving
    from hexflow.operators import lambdamart

    folder = _datasets(spark, d)
    train, test = (sinks.read_enriched(spark, folder, side) for side in ("train", "test"))
    ranker = lambdamart.fit(train, params=lambdamart.Params(n_trees=2, min_rows=20))
    scored = Scratch(spark, "ranked").save(ranker.score(test), "scored")
    serving.register(spark, ranker, f"{folder}/models")
    again = serving.load_model(spark, f"{folder}/models").score(test)
    gap = scored.join(again.select("group_id", "hex_id", F.col("score").alias("again")), ["group_id", "hex_id"]).agg(F.max(F.abs(F.col("score") - F.col("again"))).alias("gap"), F.count("*").alias("both"))
    best = ranking.ranking_metrics(ranker.score(train)).select(F.col("ndcg_10").alias("fitted"))
    chance = ranking.ranking_metrics(train.withColumn("score", _random_score())).select(F.col("ndcg_10").alias("random"))
    named = ranker.importance(spark).agg(F.count_distinct("feature").alias("named"))
    one = gap.crossJoin(best).crossJoin(chance).crossJoin(named).crossJoin(test.agg(F.count("*").alias("n")))  # one row each
    return _properties(one, all_rows_scored=F.col("both") == F.col("n"), learns_its_training_rows=F.col("fitted") > F.col("random"), importance_names_all_features=F.col("named") == len(ranker.columns), saved_model_scores_alike=F.col("gap") < 1e-12)


# models and generator (rows only)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    df = tables.read_table(spark, f"{d}/embeddings.parquet").select("vec_id", "embedding", "label")
    return clusters.vectors(clusters.standardise_array(df, "embedding", "vec_id"), "embedding")


@query()
def kmeans(spark, d):
    return clusters.kmeans(_vectors(spark, d), 10).select("vec_id", "label", "kmeans_cluster")


@query()
def clustering_comparison(spark, d):
    """The three segmentations of the embeddings, each with its agreement with the labels."""
    from hexflow.plans import clustering

    df = tables.read_table(spark, f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("features"), "label")
    made = Scratch(spark, "comparison").save(clustering.segmentations(df, "vec_id", "label", 10, 10, 5), "clusters")
    rows = [made.select(F.lit(a).alias("algorithm"), F.col(f"{a}_cluster").cast("long").alias("cluster"), "label") for a in clustering.ALGORITHMS]
    scores = [clusters.agreement(clusters.contingency(x, "cluster", "label")).crossJoin(clusters.cluster_counts(x, "cluster")).select(F.lit(a).alias("algorithm"), "*") for a, x in zip(clustering.ALGORITHMS, rows, strict=True)]  # one row each
    return scores[0].unionByName(scores[1]).unionByName(scores[2])


@query()
def gmm(spark, d):
    reduced = clusters.pca(_vectors(spark, d), 4)[0].select("vec_id", "label", F.col("pca").alias("features"))
    return clusters.gaussian_mixture(reduced, 5).select("vec_id", "label", "gmm_cluster", vector_to_array("gmm_probability").alias("probability"))


@query(f"""WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
 s AS (SELECT i, avg(v) AS m, stddev_pop(v) AS d FROM x GROUP BY 1) SELECT CAST(count(*) AS INT) AS components, {r('sum(CASE WHEN d = 0 THEN 0 ELSE 1 END) / count(*)', 'scaled_variance')}, {r('1.0', 'explained')} FROM s""")
def pca_total_variance(spark, d):
    """All components together explain everything that standardising left: one per coordinate that varies."""
    points = _vectors(spark, d)
    dim = points.select(F.size("embedding").alias("n")).first()["n"]
    total = clusters.explained_variance(points, dim).agg(F.sum("share").alias("explained"), F.max("component").alias("components"))
    each = points.select("vec_id", F.posexplode("embedding").alias("at", "v")).groupBy("at").agg(F.var_pop("v").alias("v")).agg(F.avg("v").alias("scaled_variance"))
    return total.crossJoin(each).select("components", "scaled_variance", "explained")  # one row each


@query()
def pca(spark, d):
    point = vector_to_array("pca")
    return clusters.pca(_vectors(spark, d))[0].select("vec_id", "label", point[0].alias("x"), point[1].alias("y"))


@query()
def hdbscan(spark, d):
    from hexflow.operators.hdbscan import hdbscan as run

    return run(_vectors(spark, d), "vec_id", "embedding", min_cluster_size=10, min_samples=5)


@query()
def lambdamart_scores(spark, d):
    from hexflow.operators import lambdamart

    ranker = lambdamart.fit(_enriched(spark, d), params=lambdamart.Params(n_trees=3, min_rows=20))
    return ranker.score(_enriched(spark, d, 1)).select("group_id", "hex_id", "label", "score")


@query()
def synthetic_players(spark, d):
    return synthetic.players(spark, synthetic.Config(n_players=500))


@query()
def synthetic_events(spark, d):
    c = synthetic.Config(n_players=60, n_days=14)
    return synthetic.events(spark, synthetic.players(spark, c), c)
