"""Orders, sampling, clustering over all rows, sinks, configuration, command line and serving."""

import json
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexflow import cli, config, serving, sinks
from hexflow.operators import clusters, explore, hdbscan, lambdamart, order, ranking, sampling
from hexflow.plans import clustering
from hexflow.plans.oracle import CUTOFF, START
from hexflow.sources import synthetic, tables


@pytest.mark.parametrize("parts", [1, 5])
def test_numbers_are_dense_and_in_order(spark, parts):
    rows = [(k * 7919 % 1009, f"v{k}") for k in range(300)]
    df = order.numbered(spark.createDataFrame(rows, "k int, v string").repartition(parts), ["k", "v"], "at")
    assert [(r.k, r.v) for r in df.orderBy("at").collect()] == sorted(rows) and sorted(r["at"] for r in df.collect()) == list(range(300))
    assert order.numbered(spark.createDataFrame([], "k int"), ["k"], "at").count() == 0


def test_runs_across_partitions(spark):
    values = [None, None, "a", "a", "b", None] + ["c"] * 200 + ["a"] * 3 + ["c"]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v string").repartition(6)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = [(r.run, r.v, r.n_rows) for r in order.runs(df, ["k"], "v").orderBy("run").collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert got == [(0, None, 2), (1, "a", 2), (2, "b", 1), (3, None, 1), (4, "c", 200), (5, "a", 3), (6, "c", 1)]


def _direct(x, k, least):
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    core = np.sort(d, 1)[:, k - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core))
    a, b = np.triu_indices(len(x), 1)
    a, b, w = hdbscan.forest(a, b, reach[a, b])
    return hdbscan.labels_of_tree(zip(a.tolist(), b.tolist(), w.tolist()), len(x), least)


def _same_partition(a, b):
    pairs = set(zip(a, b))
    return len(pairs) == len(set(a)) == len(set(b)) and all((x == -1) == (y == -1) for x, y in pairs)


@pytest.mark.parametrize("block", [2048, 37])
def test_hdbscan_over_blocks_is_the_direct_one(spark, block):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (50, 4)) for c in (0, 3, 6)] + [rng.uniform(-5, 12, (30, 4))])
    rows = [(3 * k, v.tolist()) for k, v in enumerate(x)] + [(1, None), (2, []), (4, [float("nan")] * 4), (5, [None] * 4)]
    got = {r.id: r.hdbscan_cluster for r in hdbscan.hdbscan(spark.createDataFrame(rows, "id long, x array<double>"), "id", "x", 15, 5, block=block, fan_in=2).collect()}
    assert len(got) == len(rows) and all(got[k] == -1 for k in (1, 2, 4, 5))
    assert _same_partition([got[3 * k] for k in range(len(x))], _direct(x, 5, 15).tolist())


def test_hdbscan_of_few_rows(spark):
    for rows in ([], [(1, [1.0])], [(1, [1.0]), (1, [1.0])]):
        assert [r.hdbscan_cluster for r in hdbscan.hdbscan(spark.createDataFrame(rows, "id long, x array<double>"), "id", "x", 2, 1).collect()] == [-1] * len(rows)


def test_samples(spark):
    df = spark.createDataFrame([(k, f"g{k % 3}") for k in range(90)], "id int, g string")
    some = sampling.uniform(df, 20, "id")
    assert some.count() == 20 and some.exceptAll(sampling.uniform(df.repartition(7), 20, "id")).count() == 0 and sampling.uniform(df, 900, "id").count() == 90
    assert {r["count"] for r in sampling.per_group(df, "g", 4, "id").groupBy("g").count().collect()} == {4}
    assert [r.id for r in sampling.head(df, 3, "id").collect()] == [0, 1, 2] and sampling.signature(df) == [("id", "int"), ("g", "string")]
    assert sampling.non_negative(df, "id").count() == 90
    with pytest.raises(Exception, match="negative id: -1"):
        sampling.non_negative(df.withColumn("id", F.col("id") - 1), "id").collect()


def test_train_and_validation_shares(spark):
    df = spark.createDataFrame([(g, k) for g in range(11) for k in range(3)], "group_id long, k int")
    a, b = ranking.subsample_train_validation(df, df, 0.5, 0.19)
    assert a.count() == 15 and b.count() == 6 and a.select("group_id").distinct().count() == 5


def test_describe(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, None), (4.0, 7)], "a double, b int")
    rows = {r.column: r for r in explore.describe(df, ["a", "b"]).collect()}
    assert rows["a"].n == 3 and rows["a"].p50 == 2.0 and rows["b"].n == 2 and rows["b"].max == 7.0 and rows["a"].std == pytest.approx(1.5275, abs=1e-4)


def test_datasets_on_disk(spark, small, tmp_path):
    ev, people = tables.events(spark, small), tables.players(spark, small)
    sinks.write_datasets(spark, ev, people, START, CUTOFF, str(tmp_path))
    for side in ("train", "test"):
        pairs, rows = sinks.read_pairs(spark, str(tmp_path), side), sinks.read_enriched(spark, str(tmp_path), side)
        assert rows.count() == pairs.count() > 0 and rows.columns == list(sinks.ENRICHED_COLUMNS)
    assert sinks.read_enriched(spark, str(tmp_path), "train", ["group_id", "label"]).columns == ["group_id", "label"]
    with pytest.raises(ValueError, match="missing columns: nothing"):
        sinks.read_enriched(spark, str(tmp_path), "train", ["nothing"])
    with pytest.raises(tables.NoInput):
        sinks.read_pairs(spark, str(tmp_path / "no"), "train")


def _blobs(spark, n=120):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(f"p{k}", *map(float, rng.normal(9 * (k % 3), 0.5, 3)), f"a{k % 3}") for k in range(n)], "player_id string, f1 double, f2 double, f3 double, archetype string")


def test_clustering_run(spark, tmp_path):
    matrix = _blobs(spark).withColumn("player_id", F.expr("cast(substring(player_id, 2) as long)"))
    sinks.write_feature_matrix(matrix, str(tmp_path / "matrix"))
    out = clustering.run(spark, str(tmp_path / "matrix"), str(tmp_path), min_cluster_size=15, seeds=range(42, 45))
    assert all(out[a]["ari"] == pytest.approx(1.0) and out[a]["n_clusters"] == 3 for a in clustering.ALGORITHMS)
    back = tables.read_table(spark, str(tmp_path / "clusters"))
    assert back.count() == 120 and {"hdbscan_cluster", "kmeans_cluster", "gmm_cluster", "gmm_probability", "x", "y"} <= set(back.columns)
    centres = clusters.centroids(back.withColumn("pca", F.expr("array(x, y)")).transform(lambda d: clusters.vectors(d, "pca", "pca")), "kmeans_cluster")
    assert centres.count() == 3
    assert sinks.read_json(spark, str(tmp_path / "metrics"))["kmeans"]["n_clusters"] == 3
    with pytest.raises(ValueError):
        sinks.write_feature_matrix(matrix.union(matrix), str(tmp_path / "twice"))


def test_row_shares_of_an_empty_cluster(spark):
    cells = spark.createDataFrame([("a", "x", 0), ("b", "x", 1), ("b", "y", 3)], "cluster string, label string, n long")
    assert sorted((r.cluster, r.label, r.share) for r in clusters.row_shares(cells).collect()) == [("a", "x", 0.0), ("b", "x", 0.25), ("b", "y", 0.75)]


def test_generated_shares_and_hours(spark):
    c = synthetic.Config(n_players=3000, n_days=7, seed=3)
    people = synthetic.players(spark, c).checkpoint()
    shares = {r.archetype: r["count"] / 3000 for r in people.groupBy("archetype").count().collect()}
    for p in synthetic.PROFILES:
        assert abs(shares[p[0]] - p[7]) < 4 * (p[7] * (1 - p[7]) / 3000) ** 0.5 + 1e-9
    assert abs(people.filter("work_lat is not null").count() / 3000 - synthetic.WORK_PRESENT) < 0.04
    made = synthetic.events(spark, people.limit(300), c)
    r = made.agg(F.min("hour").alias("a"), F.max("hour").alias("b"), F.max("distance_from_home_km").alias("far"), F.count_distinct("event_type").alias("kinds"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).first()
    assert 0 <= r.a and r.b <= 23 and r.kinds == 4 and r.far < 80 and str(r.first) >= "2025-01-01" and str(r["last"]) < "2025-01-08"


def test_settings_from_defaults_environment_and_arguments():
    c = config.generation({"n_days": 3, "seed": None}, {"HEXFLOW_N_DAYS": "9", "HEXFLOW_SEED": "7", "HEXFLOW_NOISE": "0.5"})
    assert (c.n_days, c.seed, c.noise, c.n_players) == (3, 7, 0.5, 1000)
    for bad in ({"HEXFLOW_SEED": "x"}, {"HEXFLOW_N_DAYS": "-1"}, {"HEXFLOW_NOISE": "2"}):
        with pytest.raises(ValueError):
            config.generation({}, bad)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    assert cli.main(["version"]) == 0 and capsys.readouterr().out.strip() == cli.VERSION
    cli.main(["info"])
    assert json.loads(capsys.readouterr().out)["generator"]["n_players"] == 1000
    cli.main(["generate", str(tmp_path), "--n-players", "12", "--n-days", "4", "--partitions", "2"])
    told = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert told["n_players"] <= 12 and told["n_events"] > 0 and told["mb"] > 0 and told["events_per_session"] >= 1
    assert tables.read_table(spark, str(tmp_path / "players")).count() == 12
    with pytest.raises(SystemExit):
        cli.main(["nothing"])


@pytest.fixture(scope="module")
def served(spark, tmp_path_factory):
    rows = [(g, f"p{g % 3}", f"c{k}", int(k < 2), g % 7, "night", "commuter", float(10 - k), float(k) if k % 3 else None) for g in range(30) for k in range(8)]
    df = spark.createDataFrame(rows, "group_id long, player_id string, hex_id string, label int, day_of_week int, period string, player_archetype string, pair_past_visits double, pair_distance_from_home_km double")
    columns = ["day_of_week", "pair_past_visits", "pair_distance_from_home_km", "period", "player_archetype"]
    ranker = lambdamart.fit(df, columns, lambdamart.Params(n_trees=3, min_rows=5, feature_share=1.0))
    folder = str(tmp_path_factory.mktemp("serving"))
    assert serving.prepare(df, ranker, folder) == 1 and serving.register(spark, ranker, f"{folder}/models") == 2
    return df, ranker, folder, serving.Service(spark, folder)


def test_service_and_registry(spark, served, tmp_path):
    df, ranker, folder, service = served
    assert service.known_players() == 3 and serving.versions(spark, f"{folder}/models") == [1, 2] and serving.versions(spark, f"{folder}/no") == []
    best = service.rank("p1", 2, "night", 3)
    assert len(best) == 3 and {b["hex_id"] for b in best[:2]} == {"c0", "c1"}
    with pytest.raises(serving.UnknownPlayer):
        service.rank("nobody", 2, "night")
    for bad in ((7, "night", 1), (0, "noon", 1), (0, "night", 0), (0, "night", 101)):
        with pytest.raises(ValueError):
            service.rank("p1", *bad)
    with pytest.raises(KeyError):
        serving.load_model(spark, f"{folder}/models", 9)
    serving.export(spark, f"{folder}/models", str(tmp_path / "copy"), 1)
    assert lambdamart.load(str(tmp_path / "copy"), spark).columns == ranker.columns
    ask = spark.createDataFrame([("r1", "p1", 2, "night", 3), ("r2", "p2", 0, "evening", 1), ("r3", "nobody", 0, "night", 1)], "request_id string, player_id string, day_of_week int, period string, top_k int")
    got = service.rank_batch(ask).collect()
    assert [r.hex_id for r in sorted((r for r in got if r.request_id == "r1"), key=lambda r: r.position)] == [b["hex_id"] for b in best] and len(got) == 4
    assert "pair_past_visits" in sinks.read_json(spark, f"{folder}/meta")["features"]


def test_http(served):
    server = serving.server(served[3], port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def get(path):
        try:
            with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}") as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    assert get("/health")[1]["known_players"] == 3
    status, body = get("/rank?player_id=p1&day_of_week=2&period=night&top_k=2")
    assert status == 200 and len(body["ranking"]) == 2
    assert [get(p)[0] for p in ("/rank?player_id=x&day_of_week=2&period=night", "/rank?player_id=p1&day_of_week=9&period=night", "/rank?day_of_week=2", "/nothing")] == [404, 422, 422, 404]
    server.shutdown()


def test_early_stopping_keeps_the_best_round(spark, served):
    df = served[0]
    columns = ["day_of_week", "pair_past_visits", "pair_distance_from_home_km"]
    ranker = lambdamart.fit(df, columns, lambdamart.Params(n_trees=8, min_rows=5, feature_share=1.0), validation=df, patience=2)
    assert 1 <= len(ranker.trees) <= 3 and ranker.best["ndcg_10"] == pytest.approx(1.0)


def test_folded_trees_score_like_the_trees(spark, served):
    df, ranker = served[:2]
    wanted = ranker.prepared(df).withColumn("wanted", F.lit(0.0))
    from pyspark.ml.feature import VectorAssembler

    for columns, tree in ranker.trees:
        wanted = tree.transform(VectorAssembler(inputCols=columns, outputCol="_v").transform(wanted)).withColumn("wanted", F.col("wanted") + ranker.params.rate * F.col("_step")).drop("_v", "_step")
    both = ranker.score(df).join(wanted.select("group_id", "hex_id", "wanted"), ["group_id", "hex_id"])
    assert both.count() == df.count() and both.filter(F.abs(F.col("score") - F.col("wanted")) > 1e-12).count() == 0


def test_missing_values_are_no_number(spark):
    """Only rows without a distance are relevant: a tree tells them from the smallest distances."""
    rows = [(g, f"c{k}", int(k == 0), None if k == 0 else float(k - 2), 1) for g in range(40) for k in range(5)]
    df = spark.createDataFrame(rows, "group_id long, hex_id string, label int, pair_distance_from_home_km double, day_of_week int")
    ranker = lambdamart.fit(df, ["pair_distance_from_home_km", "day_of_week"], lambdamart.Params(n_trees=2, min_rows=5, feature_share=1.0, bagging=1.0))
    assert ranking.ranking_metrics(ranker.score(df)).first().ndcg_10 == pytest.approx(1.0)


def test_search_and_its_records(spark, served, tmp_path):
    df = served[0]
    space = {"n_trees": [1, 2], "max_depth": [2], "rate": [0.1, 0.2], "feature_share": [1.0], "bagging": [1.0], "min_rows": [5]}
    trials = lambdamart.random_search(df, df, 2, space, columns=["day_of_week", "pair_past_visits"])
    assert len(trials) == 2 and trials[0]["ndcg_10"] >= trials[1]["ndcg_10"]
    assert lambdamart.random_search(df, df, 1, space, columns=["pair_past_visits"])[0]["n_trees"] in (1, 2)
    lambdamart.write_trials(spark, trials, str(tmp_path))
    table = spark.read.option("header", True).csv(f"{tmp_path}/trials")
    assert table.count() == 2 and {"trial_id", "ndcg_10", "rate"} <= set(table.columns)
    assert sinks.read_json(spark, f"{tmp_path}/best_params")["n_trees"] == trials[0]["n_trees"]
    lambdamart.log_search(spark, f"{tmp_path}/runs", "search", trials)
    runs = spark.read.parquet(f"{tmp_path}/runs")
    assert runs.count() == 3 and runs.filter("parent = 'search'").count() == 2
    ranker, metrics = lambdamart.train_final(df, df, trials[0], f"{tmp_path}/runs", "final", f"{tmp_path}/model", ["day_of_week", "pair_past_visits"])
    assert metrics["ndcg_10"] > 0.9 and json.loads(lambdamart.latest_run(spark, f"{tmp_path}/runs", "final")["params"])["model"] == f"{tmp_path}/model"


def test_distance_to_nowhere_is_null(spark):
    from hexflow.functions import geo

    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (1.0, None)], "lat double, lon double")
    assert [r.km is None for r in df.select(geo.haversine_km(F.lit(1.0), F.lit(2.5), F.col("lat"), F.col("lon")).alias("km")).collect()] == [False, True, True]


def test_homes_at_the_origin_only_if_asked_for(spark):
    rows = spark.createDataFrame([("p", "r8:0:0"), ("q", "r8:0:0")], "player_id string, hex_id string")
    visits = spark.createDataFrame([("p", "r8:0:0", 3)], "player_id string, hex_id string, n_visits long")
    homes = spark.createDataFrame([("p", 30.0, -110.0)], "player_id string, home_lat double, home_lon double")
    plain = {r.player_id: r for r in ranking.add_pair_features(rows, visits, homes).collect()}
    legacy = {r.player_id: r for r in ranking.add_pair_features(rows, visits, homes, legacy_origin_fallback=True).collect()}
    assert plain["p"].pair_past_visits == 3 and plain["q"].pair_past_visits == 0 and plain["q"].pair_distance_from_home_km is None
    assert legacy["q"].pair_distance_from_home_km > 5000 and legacy["p"] == plain["p"]


def test_sorted_groups(spark):
    df = spark.createDataFrame([(k % 7, f"c{k * 31 % 17:02d}") for k in range(100)], "group_id long, hex_id string").repartition(5)
    seen = set()
    for part in ranking.sorted_groups(df).rdd.glom().collect():
        rows = [(r.group_id, r.hex_id) for r in part]
        assert rows == sorted(rows) and not seen & {g for g, _ in rows}
        seen |= {g for g, _ in rows}
    assert len(seen) == 7
