"""Learning-to-rank data: queries, positives, sampled negatives, enrichment, splits and metrics.

A query is (player_id, day_of_week, period).  Random choices are orders of md5 over a seed and the
row's key, so they are the same on any cluster and in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hexflow.functions import geo
from hexflow.operators import features, order
from hexflow.store import Scratch

KEY = ["player_id", "day_of_week", "period"]
SEED = 42
MAX_POSITIVES = 10
NEG_RATIO = 5
# The columns of the enriched tables.
NUMERIC = [
    "day_of_week", "pair_past_visits", "pair_distance_from_home_km", "player_total_events_log", "player_unique_sessions", "player_events_per_session_mean", "player_active_days_ratio", "player_weekday_ratio",
    "player_evening_ratio", "player_hour_concentration", "player_distance_from_home_mean_km", "player_unique_hexes_count_log", "hex_global_popularity", "hex_total_visits", "hex_n_unique_archetypes",
]
CATEGORICAL = ["period", "player_archetype"]


def draw(*parts: Column | str, seed: int = SEED) -> Column:
    """A reproducible random order over the rows' keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") for p in parts]))


def positives(visited: DataFrame, most: int = MAX_POSITIVES) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*KEY).orderBy(F.col("n_visits").desc(), "hex_id"))
    return visited.withColumn("rank", rank).filter(F.col("rank") <= most)


def candidates(visited: DataFrame, top: DataFrame, exclude_all_visited: bool = False) -> DataFrame:
    """Cells of the player's universe that are no positives of the query (or were not visited in it at all)."""
    queries = top.groupBy(*KEY).agg(F.count("*").alias("n_positives"))
    taken = visited if exclude_all_visited else top
    return queries.join(features.universe(visited), "player_id").join(taken.select(*KEY, "hex_id"), [*KEY, "hex_id"], "left_anti")


def drawn_queries(visited: DataFrame, ratio: int = NEG_RATIO, most: int = MAX_POSITIVES, seed: int = SEED, exclude_all_visited: bool = False) -> DataFrame:
    """One row a query: (player_id, day_of_week, period, top, drawn), its positive cells and its sampled negatives.

    Visits are dealt by player once; a query's cells and a player's universe, both as long as the
    player has cells, are then arrays of one row each, so candidates are never rows of a shuffle.
    (Exploded by the outer form: the other would draw twice, once to tell whether the array is empty.)
    """
    dealt = visited.select(*KEY, "hex_id", "n_visits").repartition("player_id")
    seen = F.sort_array(F.collect_list(F.struct((-F.col("n_visits")).alias("n"), "hex_id")))
    queries = dealt.groupBy(*KEY).agg(F.transform(seen, lambda x: x["hex_id"]).alias("seen")).withColumn("top", F.slice("seen", 1, most))
    queries = queries.join(dealt.groupBy("player_id").agg(F.collect_set("hex_id").alias("universe")), "player_id")
    left = F.array_except("universe", "seen" if exclude_all_visited else "top")
    in_order = F.sort_array(F.transform(left, lambda h: F.struct(draw(*KEY, h, seed=seed).alias("draw"), h.alias("hex_id"))))
    picked = F.slice(in_order, F.lit(1), F.lit(ratio) * F.size("top"))
    return queries.select(*KEY, "top", F.transform(picked, lambda x: x["hex_id"]).alias("drawn"))


def negatives(visited: DataFrame, **options) -> DataFrame:
    """(player_id, day_of_week, period, hex_id): up to ``ratio`` sampled cells for each positive of a query."""
    return drawn_queries(visited, **options).select(*KEY, F.explode_outer("drawn").alias("hex_id")).filter("hex_id is not null")


def query_ids(visited: DataFrame, most: int = MAX_POSITIVES, exclude_all_visited: bool = False) -> DataFrame:
    """(player_id, day_of_week, period, group_id) of the queries that leave a cell of their player to draw, numbered in the keys' order."""
    seen = visited.groupBy(*KEY).agg(F.count("*").alias("n"))
    known = features.universe(visited).groupBy("player_id").agg(F.count("*").alias("cells"))
    taken = F.col("n") if exclude_all_visited else F.least("n", F.lit(most))
    return order.numbered(seen.join(known, "player_id").filter(F.col("cells") > taken).select(*KEY), KEY, "group_id")


def pairs(visited: DataFrame, ratio: int = NEG_RATIO, most: int = MAX_POSITIVES, seed: int = SEED, exclude_all_visited: bool = False) -> DataFrame:
    """(player_id, day_of_week, period, hex_id, label, group_id); queries without a negative are left out, ids follow the keys' order."""
    visited = Scratch(visited.sparkSession, "pairs").save(visited.select(*KEY, "hex_id", "n_visits"), "visits")
    ids = query_ids(visited, most, exclude_all_visited)
    queries = drawn_queries(visited, ratio, most, seed, exclude_all_visited).join(ids, KEY)

    def labelled(cells: str, label: int) -> Column:
        return F.transform(cells, lambda h: F.struct(h.alias("hex_id"), F.lit(label).alias("label")))

    return queries.select(*KEY, "group_id", F.explode_outer(F.concat(labelled("top", 1), labelled("drawn", 0))).alias("x")).select(*KEY, "x.hex_id", "x.label", "group_id")


def train_test(events: DataFrame, cutoff: str, **options) -> tuple[DataFrame, DataFrame]:
    return pairs(features.visits(features.before(events, cutoff)), **options), pairs(features.visits(features.since(events, cutoff)), **options)


def add_pair_features(rows: DataFrame, past: DataFrame, homes: DataFrame, legacy_origin_fallback: bool = False) -> DataFrame:
    """Visits of the pair before the cutoff, and the distance from home to the cell's centre (0, 0 stands in for unknown ones if asked for)."""
    lat, lon = geo.hex_centroid(F.col("hex_id"))
    out = rows.join(past.withColumnRenamed("n_visits", "pair_past_visits"), ["player_id", "hex_id"], "left").join(homes.select("player_id", "home_lat", "home_lon"), "player_id", "left")
    out = out.withColumn("pair_past_visits", F.coalesce("pair_past_visits", F.lit(0)))
    points = [F.col("home_lat"), F.col("home_lon"), lat, lon]
    if legacy_origin_fallback:
        points = [F.coalesce(p, F.lit(0.0)) for p in points]
    return out.withColumn("pair_distance_from_home_km", geo.haversine_km(*points)).drop("home_lat", "home_lon")


def saved_events(events: DataFrame) -> DataFrame:
    """The columns of derived events that features and pairs read, saved once for a run of several of them."""
    columns = ["event_id", "player_id", "ts", "hour", "day_of_week", "period", "hex_id", "archetype", "home_lat", "home_lon", "lat", "lon"]
    return Scratch(events.sparkSession, "events").save(events.select(*columns), "events")


def enrich(rows: DataFrame, past_events: DataFrame, players: DataFrame, player_features: DataFrame, hex_features: DataFrame) -> DataFrame:
    out = add_pair_features(rows, features.pair_counts(past_events), players)
    return out.join(player_features, "player_id", "left").join(hex_features, "hex_id", "left")


def _groups(df: DataFrame) -> DataFrame:
    return df.select("group_id").distinct()


def subsample_groups(df: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """The rows of ``n`` whole groups, drawn in a reproducible random order."""
    some = _groups(df).orderBy(draw("group_id", seed=seed), "group_id").limit(n)
    return df.join(some, "group_id", "left_semi")


def split_groups(df: DataFrame, share: float, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rest, held out): whole groups, ``int(share * groups)`` of them held out."""
    ranked = order.numbered(_groups(df).withColumn("_draw", draw("group_id", seed=seed)), ["_draw", "group_id"], "rank")
    held = ranked.filter(F.col("rank") < int(ranked.count() * share)).select("group_id")
    return df.join(held, "group_id", "left_anti"), df.join(held, "group_id", "left_semi")


def subsample_train_validation(train: DataFrame, validation: DataFrame, train_share: float, validation_share: float, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Both tables cut to whole groups: a share of each table's groups, rounded down."""
    return tuple(subsample_groups(df, int(_groups(df).count() * share), seed) for df, share in ((train, train_share), (validation, validation_share)))


def stratified(players: DataFrame, share: float, seed: int = SEED) -> DataFrame:
    """ceil(share * size) players of each archetype."""
    by = W.partitionBy("archetype")
    ranked = players.withColumn("rank", F.row_number().over(by.orderBy(draw("player_id", seed=seed), "player_id"))).withColumn("n", F.count("*").over(by))
    return ranked.filter(F.col("rank") <= F.ceil(F.col("n") * F.lit(share))).drop("rank", "n")


def sorted_groups(df: DataFrame) -> DataFrame:
    """Whole groups per partition, their rows in order: what a trainer that reads groups one after another needs."""
    return df.repartition("group_id").sortWithinPartitions("group_id", "hex_id")


def group_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("group_id").agg(F.count("*").alias("n_rows"))


def contiguous_runs(df: DataFrame, by: list[str], value: str = "group_id") -> DataFrame:
    """(run, value, n_rows): lengths of runs of equal values in the given order."""
    return order.runs(df, by, value)


def query_metrics(scored: DataFrame, ks: tuple[int, ...] = (10, 20), precision_at: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Per-query NDCG, average precision, reciprocal rank and precision of (group_id, hex_id, label, score).

    A query's rows (its positives and sampled negatives) are one array in the order of the scores, so
    one shuffle serves all metrics.
    """
    score = F.col("score").cast("double")
    row = F.struct(score.isNull().alias("none"), (-score).alias("score"), "hex_id", F.col("label").cast("double").alias("label"))
    rows = scored.groupBy("group_id").agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["label"]).alias("labels"))
    rows = rows.withColumn("best", F.sort_array("labels", asc=False))

    def gain(labels: str, k: int) -> Column:
        terms = F.transform(F.slice(labels, 1, k), lambda v, i: v / F.log2(i + F.lit(2.0)))
        return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)

    start = F.struct(F.lit(0.0).alias("hits"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("first"), F.lit(0.0).alias("at"))

    def walk(s: Column, v: Column) -> Column:
        at, hit = s["at"] + 1.0, v > 0
        hits = s["hits"] + F.when(hit, 1.0).otherwise(0.0)
        return F.struct(hits.alias("hits"), (s["sum"] + F.when(hit, hits / at).otherwise(0.0)).alias("sum"), F.when(hit & (s["first"] == 0), at).otherwise(s["first"]).alias("first"), at.alias("at"))

    rows = rows.withColumn("walk", F.aggregate("labels", start, walk))
    ndcg = [F.when(gain("best", k) > 0, gain("labels", k) / gain("best", k)).otherwise(0.0).alias(f"ndcg_{k}") for k in ks]
    hits = F.col("walk.hits")
    top = [(F.size(F.filter(F.slice("labels", 1, k), lambda v: v > 0)) / F.least(F.lit(k), F.size("labels"))).alias(f"precision_{k}") for k in precision_at]
    return rows.select("group_id", *ndcg, F.when(hits > 0, F.col("walk.sum") / hits).otherwise(0.0).alias("average_precision"), F.when(hits > 0, 1.0 / F.col("walk.first")).otherwise(0.0).alias("reciprocal_rank"), *top)


def ranking_metrics(scored: DataFrame) -> DataFrame:
    """One row of means over queries; queries without a relevant item count as 0."""
    per = query_metrics(scored)
    names = {"average_precision": "map", "reciprocal_rank": "mrr"}
    return per.agg(*[F.avg(c).alias(names.get(c, c)) for c in per.columns if c != "group_id"], F.count("*").alias("n_queries"))


def serving_table(enriched: DataFrame) -> DataFrame:
    """One row of window-independent features per (player, cell)."""
    static = [c for c in enriched.columns if c.startswith(("pair_", "player_", "hex_")) and c not in ("player_id", "hex_id")]
    return enriched.select("player_id", "hex_id", *static).dropDuplicates(["player_id", "hex_id"])


def rank_batch(requests: DataFrame, serving: DataFrame, score: Column, on: str | list[str] = "player_id") -> DataFrame:
    """Each request's ``top_k`` cells by ``score`` (a column of the serving table and the request).

    Unknown players have no rows; ``top_k`` outside 1 to 100, a weekday outside 0 to 6 or an unknown
    period is an error.
    """
    bad = ~(F.col("top_k").between(1, 100) & F.col("day_of_week").between(0, 6) & F.col("period").isin("night", "morning", "afternoon", "evening"))
    checked = requests.withColumn("top_k", F.when(bad, F.raise_error(F.lit("invalid request"))).otherwise(F.col("top_k")))
    rows = checked.join(serving, on).withColumn("score", score)
    by = W.partitionBy("request_id").orderBy(F.col("score").desc(), "hex_id")
    return rows.withColumn("position", F.row_number().over(by)).filter(F.col("position") <= F.col("top_k")).select("request_id", "player_id", "position", "hex_id", "score")
