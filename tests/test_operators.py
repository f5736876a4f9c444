"""Hand-computed cases and properties of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from hexflow.functions import geo, stats, time
from hexflow.operators import clusters, features, lambdamart, ranking
from hexflow.plans.oracle import CUTOFF, START
from hexflow.sources import synthetic, tables
from hexflow.streaming import events as streams


def test_periods(spark):
    rows = spark.createDataFrame([(h,) for h in (0, 5, 6, 11, 12, 17, 18, 23)], "h int").select(time.period(F.col("h")).alias("p")).collect()
    assert [r.p for r in rows] == ["night", "night", "morning", "morning", "afternoon", "afternoon", "evening", "evening"]


@pytest.mark.parametrize("hour", [-1, 24, 100])
def test_invalid_hour(spark, hour):
    with pytest.raises(Exception, match="Invalid hour"):
        spark.createDataFrame([(hour,)], "h int").select(time.period(F.col("h"))).collect()
    assert spark.createDataFrame([(hour,)], "h int").select(time.period(F.col("h"), strict=False).alias("p")).first().p is None


def _metrics(spark, labels, scores, groups):
    rows = [(g, f"c{k:03d}", float(label), float(s)) for k, (label, s, g) in enumerate(zip(labels, scores, groups))]
    return ranking.ranking_metrics(spark.createDataFrame(rows, "group_id long, hex_id string, label double, score double")).first()


def test_metrics_of_a_perfect_query(spark):
    m = _metrics(spark, [1, 1, 0, 0], [4, 3, 2, 1], [0] * 4)
    assert (m.ndcg_10, m.mrr, m.map, m.n_queries) == (1.0, 1.0, 1.0, 1)


def test_metrics_average_over_queries(spark):
    m = _metrics(spark, [1, 0, 1, 0], [2, 1, 1, 2], [0, 0, 1, 1])
    assert m.ndcg_10 == pytest.approx((1 + 1 / math.log2(3)) / 2) and m.n_queries == 2


@pytest.mark.parametrize(("labels", "field", "want"), [([1, 0, 1], "ndcg_10", 1.5 / (1 + 1 / math.log2(3))), ([0, 0, 0], "ndcg_10", 0.0), ([1, 0, 1, 0], "map", 5 / 6), ([0, 1, 0], "mrr", 0.5), ([0, 0], "mrr", 0.0), ([1, 1, 0, 0, 1], "precision_5", 0.6), ([1, 1, 0], "precision_10", 2 / 3)])
def test_metric_cases(spark, labels, field, want):
    assert _metrics(spark, labels, range(len(labels), 0, -1), [0] * len(labels))[field] == pytest.approx(want)


@pytest.mark.parametrize(("ids", "want"), [([0, 0, 0, 1, 1, 2, 2, 2, 2], [3, 2, 4]), ([7, 7, 7], [3]), ([0, 1, 2], [1, 1, 1]), ([], []), ([1, 1, 2, 1], [2, 1, 1])])
def test_runs_of_groups(spark, ids, want):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(ids)], "k int, group_id int")
    assert [r.n_rows for r in ranking.contiguous_runs(df, ["k"]).orderBy("run").collect()] == want


def test_percentile_and_deviation(spark):
    r = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "x double").agg(F.percentile("x", F.lit(0.25)).alias("a"), F.percentile("x", F.lit(0.95)).alias("b"), stats.population_std(F.col("x")).alias("s")).first()
    assert r.a == 1.75 and r.b == pytest.approx(8.25) and r.s == pytest.approx(3.0822, abs=1e-4)


def test_session_gap_is_strict(spark):
    rows = spark.sql("SELECT 'p' AS player_id, k AS event_id, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,s) AS ts FROM VALUES (1, 0), (2, 1800), (3, 3601) t(k, s)")
    assert [r.session_seq for r in features.sessions(rows).orderBy("event_id").collect()] == [0, 0, 1]


def test_cell_contains_its_centre(spark):
    df = spark.range(200).select((F.lit(29.0) + F.col("id") / 900).alias("lat"), (F.lit(-111.0) + F.col("id") / 700).alias("lon")).withColumn("cell", geo.hex_cell(F.col("lat"), F.col("lon")))
    lat, lon = geo.hex_centroid(F.col("cell"))
    df = df.withColumns({"clat": lat, "clon": lon}).checkpoint()
    assert df.filter(geo.hex_cell(F.col("clat"), F.col("clon")) != F.col("cell")).count() == 0
    assert df.filter(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon")) > 0.6).count() == 0


def test_pairs_keep_their_bounds(spark, small):
    rows = ranking.pairs(features.visits(tables.events(spark, small)))
    per = rows.groupBy("group_id").agg(F.sum("label").alias("pos"), F.count_if(F.col("label") == 0).alias("neg"), F.count_distinct("hex_id").alias("cells"), F.count("*").alias("n"))
    assert per.filter("pos < 1 or pos > 10 or neg < 1 or neg > 5 * pos or cells <> n").count() == 0


def test_features_ignore_the_test_period(spark, small):
    ev, people = tables.events(spark, small), tables.players(spark, small)
    late = F.col("ts") >= F.lit(CUTOFF).cast("timestamp_ntz")
    changed = ev.withColumn("hex_id", F.when(late, "r8:99:99").otherwise(F.col("hex_id"))).withColumn("hour", F.when(late, 3).otherwise(F.col("hour")))
    for build in (lambda e: features.player_features(e, people, START, CUTOFF), lambda e: features.hex_features(e, CUTOFF)):
        a, b = build(ev), build(changed)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_result_does_not_depend_on_partitions(spark, small):
    ev = tables.events(spark, small)
    a, b = (ranking.pairs(features.visits(x)) for x in (ev, ev.repartition(7)))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_profile_densities(spark, small):
    p = features.profile(tables.events(spark, small), tables.players(spark, small))
    assert len(p.columns) == 56
    total = sum((F.col(f"hour_density_{h:02d}") for h in range(24)), F.lit(0.0))
    assert p.filter((F.abs(total - 1) > 1e-9) | ~F.col("evening_ratio").between(0, 1)).count() == 0


def test_agreement_of_the_published_table(spark):
    cells = [("0", "night_owl", 2417), ("1", "morning_player", 3586), ("2", "hardcore_raider", 3437), ("3", "weekend_explorer", 5111), ("4", "casual_evening", 11023), ("4", "weekend_homebody", 3995)]
    cells += [("5", "lunch_player", 6401), ("6", "commuter", 9011), ("7", "lunch_commuter", 4948), ("-1", "lunch_commuter", 65), ("-1", "commuter", 6)]
    df = spark.createDataFrame(cells, "cluster string, label string, n long")
    m = clusters.agreement(df).first()
    assert [round(m[c], 4) for c in ("ari", "nmi", "homogeneity", "completeness")] == [0.8640, 0.9546, 0.9166, 0.9959]
    assert {r.cluster: round(r.purity, 3) for r in clusters.purity(df).collect()}["4"] == 0.734


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in clusters.standardise(df, ["a", "b"]).orderBy("a").collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_hdbscan_finds_blobs(spark):
    from hexflow.operators.hdbscan import hdbscan

    rows = [(k, [float(k % 2) * 50 + (k * 7919 % 97) / 97, (k * 104729 % 89) / 89]) for k in range(120)] + [(999, [25.0, 400.0])]
    out = {r.id: r.hdbscan_cluster for r in hdbscan(spark.createDataFrame(rows, "id long, x array<double>"), "id", "x", 20, 5).collect()}
    assert out[999] == -1 and len({out[k] for k in range(0, 120, 2)} - {-1}) == 1 and out[0] != out[1]


def test_ranker_beats_random_and_survives_saving(spark, tmp_path):
    rows = [(g, f"c{k}", int(k < 2), 0, float(10 - k if k < 2 else g % 3), 1.0, "night", "commuter") for g in range(60) for k in range(8)]
    df = spark.createDataFrame(rows, "group_id long, hex_id string, label int, day_of_week int, pair_past_visits double, pair_distance_from_home_km double, period string, player_archetype string")
    columns = ["day_of_week", "pair_past_visits", "pair_distance_from_home_km", "period", "player_archetype"]
    ranker = lambdamart.fit(df, columns, lambdamart.Params(n_trees=2, min_rows=5, feature_share=1.0))
    assert ranking.ranking_metrics(ranker.score(df)).first().ndcg_10 > 0.99
    lambdamart.save(ranker, str(tmp_path / "m"), spark)
    again = lambdamart.load(str(tmp_path / "m"), spark)
    assert ranker.score(df).exceptAll(again.score(df)).count() == 0
    assert ranker.importance(spark).first().feature == "pair_past_visits"
    lambdamart.log_run(spark, str(tmp_path / "runs"), "a", {"x": 1}, {"ndcg": 1.0})
    assert lambdamart.latest_run(spark, str(tmp_path / "runs"), "a")["metrics"] == '{"ndcg": 1.0}'


def test_serving_rejects_bad_requests(spark):
    serving = spark.createDataFrame([("p", "c", 1.0)], "player_id string, hex_id string, pair_past_visits double")
    ask = lambda who, k: spark.createDataFrame([("r", who, 0, "night", k)], "request_id string, player_id string, day_of_week int, period string, top_k int")
    assert ranking.rank_batch(ask("p", 1), serving, F.col("pair_past_visits")).count() == 1
    assert ranking.rank_batch(ask("nobody", 1), serving, F.col("pair_past_visits")).count() == 0
    with pytest.raises(Exception, match="invalid request"):
        ranking.rank_batch(ask("p", 101), serving, F.col("pair_past_visits")).collect()


def test_missing_and_incomplete_inputs(spark, tmp_path):
    with pytest.raises(tables.NoInput):
        tables.read_table(spark, str(tmp_path / "nothing"))
    with pytest.raises(ValueError, match="missing columns: b"):
        tables.require_columns(spark.range(1), ["id", "b"])


def test_generator_repeats_and_writes(spark, tmp_path):
    c = synthetic.Config(n_players=20, n_days=7)
    people = synthetic.players(spark, c)
    a, b = synthetic.events(spark, people, c), synthetic.events(spark, people.repartition(3), c)
    assert a.exceptAll(b).count() == 0
    assert a.count() == a.select("event_id").distinct().count()
    assert a.filter(~F.col("hour").between(0, 23) | (F.col("distance_from_home_km") > 60)).count() == 0
    total = synthetic.write_events(a, str(tmp_path / "events"), 3).first()
    assert total.n_events == a.count() and total.mb > 0


def test_streamed_sessions_are_batch_sessions(spark, small, tmp_path):
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{small}/events.parquet").write.parquet(str(tmp_path / "in/a.parquet"))
    stream = streams.read_stream(spark, str(tmp_path / "in/a.parquet"))
    streams.to_parquet(streams.sessions(stream, "6 hours"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    batch = streams.sessions(spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "6 hours")
    out = spark.read.parquet(str(tmp_path / "out"))
    assert 0 < out.count() <= batch.count() and out.exceptAll(batch).count() == 0
