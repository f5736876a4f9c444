"""LambdaMART on decision trees: boosting with listwise gradients, tuning and a table of runs.

Every round ranks the rows of a query, forms the pairs of a relevant and an irrelevant row (at most
positives x negatives of one query), weighs them by the change in NDCG, and fits a regression tree
to gradient over curvature with the curvature as weight, so a leaf holds the Newton step.
"""

from __future__ import annotations

import json
import random
import time
from dataclasses import asdict, dataclass, field, fields

import numpy as np
import pandas as pd

from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hexflow import store
from hexflow.operators import ranking

# The grid of the search and the default parameters below it.
SEARCH_SPACE = {"n_trees": [100, 200, 300, 500], "max_depth": [4, 5, 6, 7], "rate": [0.01, 0.05, 0.1, 0.2], "feature_share": [0.6, 0.8, 1.0], "bagging": [0.6, 0.8, 1.0], "min_rows": [20, 50, 100]}


#: Stands for a missing number: below any value, so that a tree's first split on a feature can tell it from all of them.
MISSING = -1e30


@dataclass(frozen=True)
class Params:
    n_trees: int = 20
    max_depth: int = 5
    rate: float = 0.1
    feature_share: float = 0.8
    bagging: float = 0.8
    min_rows: int = 50
    seed: int = 42
    checkpoint_every: int = 5


@dataclass
class Ranker:
    params: Params
    columns: list[str]
    indexers: list
    trees: list = field(default_factory=list)
    #: After early stopping: ndcg_10 on the validation rows and the number of trees it was reached with.
    best: dict = field(default_factory=dict)

    def prepared(self, df: DataFrame) -> DataFrame:
        """Numbers with nulls as ``MISSING`` and categories as indices in alphabetical order (unseen ones last)."""
        for indexer in self.indexers:
            df = indexer.transform(df)
        names = [c if c in ranking.NUMERIC else f"{c}_index" for c in self.columns]
        return df.withColumns({f"_f_{k}": F.coalesce(F.col(n).cast("double"), F.lit(MISSING)) for k, n in enumerate(names)})

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with ``score``: all trees in one vectorised function, so the plan doesn't grow with them."""
        trees, rate = [(np.array([int(c.removeprefix("_f_")) for c in columns]), *_nodes(tree)) for columns, tree in self.trees], self.params.rate

        def total(*features: pd.Series) -> pd.Series:
            x = np.column_stack([f.to_numpy(dtype=np.float64) for f in features])
            rows, out = np.arange(len(x)), np.zeros(len(x))
            for picked, feature, threshold, left, right, value in trees:
                at = np.zeros(len(x), dtype=np.int64)
                while (inner := feature[at] >= 0).any():
                    lower = x[rows, picked[np.maximum(feature[at], 0)]] <= threshold[at]
                    at = np.where(inner, np.where(lower, left[at], right[at]), at)
                out = out + rate * value[at]
            return pd.Series(out)

        names = [f"_f_{k}" for k in range(len(self.columns))]
        return self.prepared(df).withColumn("score", F.pandas_udf(total, "double")(*names)).select(*[c for c in df.columns if c != "score"], "score")

    def importance(self, spark: SparkSession) -> DataFrame:
        """(feature, gain, splits), largest gain first."""
        gain, splits = dict.fromkeys(self.columns, 0.0), dict.fromkeys(self.columns, 0)
        for columns, tree in self.trees:
            for at, value in zip(tree.featureImportances.indices.tolist(), tree.featureImportances.values.tolist(), strict=True):
                name = self.columns[int(columns[at].removeprefix("_f_"))]
                gain[name] += value
                splits[name] += 1
        rows = sorted(((c, gain[c], splits[c]) for c in self.columns), key=lambda r: (-r[1], r[0]))
        return spark.createDataFrame(rows, "feature string, gain double, splits int")


def _nodes(tree) -> tuple[np.ndarray, ...]:
    """A tree's nodes as arrays: feature (-1 in a leaf), threshold, left and right child, value."""
    lines = iter([x.strip() for x in tree.toDebugString.splitlines()[1:] if x.strip()])
    rows: list[list] = []

    def node() -> int:
        line, at = next(lines), len(rows)
        if line.startswith("Predict: "):
            rows.append([-1, 0.0, at, at, float(line[9:])])
            return at
        _, _, feature, _, threshold = line.rstrip(")").split()  # If (feature 3 <= 0.5)
        rows.append([int(feature), float(threshold), 0, 0, 0.0])
        rows[at][2] = node()
        next(lines)  # Else
        rows[at][3] = node()
        return at

    node()
    feature, threshold, left, right, value = zip(*rows, strict=True)
    return np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value)


def gradients(df: DataFrame) -> DataFrame:
    """(row_id, target, weight) of rows (group_id, hex_id, label, score, row_id)."""
    group = W.partitionBy("group_id")
    ranked = df.withColumn("rn", F.row_number().over(group.orderBy(F.col("score").desc(), "hex_id"))).withColumn("n_pos", F.sum("label").over(group))
    discount = lambda c: 1.0 / F.log2(F.col(c) + 1.0)
    up = ranked.filter("label = 1").select("group_id", F.col("row_id").alias("i"), F.col("score").alias("si"), F.col("rn").alias("ri"), "n_pos")
    down = ranked.filter("label = 0").select("group_id", F.col("row_id").alias("j"), F.col("score").alias("sj"), F.col("rn").alias("rj"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("n_pos").cast("int")), F.lit(0.0), lambda s, k: s + 1.0 / F.log2(k + 1.0))
    pairs = up.withColumn("ideal", ideal).join(down, "group_id")
    rho = 1.0 / (1.0 + F.exp(F.col("si") - F.col("sj")))
    delta = F.abs(discount("ri") - discount("rj")) / F.col("ideal")
    pairs = pairs.select("i", "j", (rho * delta).alias("g"), (rho * (1.0 - rho) * delta).alias("h"))
    both = pairs.select(F.col("i").alias("row_id"), "g", "h").unionByName(pairs.select(F.col("j").alias("row_id"), (-F.col("g")).alias("g"), "h"))
    out = both.groupBy("row_id").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    return out.filter("h > 1e-12").select("row_id", (F.col("g") / F.col("h")).alias("target"), F.col("h").alias("weight"))


def fit(train: DataFrame, columns: list[str] | None = None, params: Params = Params(), validation: DataFrame | None = None, patience: int | None = None) -> Ranker:
    """A ranker of rows (group_id, hex_id, label, features); rounds are checkpointed to the shared folder.

    With ``validation`` rows and ``patience``, rounds end when so many in a row don't raise ndcg_10 there,
    and the trees up to the best round stay.
    """
    store.shared_dir(train.sparkSession)
    columns = columns or [*ranking.NUMERIC, *ranking.CATEGORICAL]
    indexers = [StringIndexer(inputCol=c, outputCol=f"{c}_index", stringOrderType="alphabetAsc", handleInvalid="keep").fit(train) for c in columns if c in ranking.CATEGORICAL]
    ranker = Ranker(params, columns, indexers)
    names = [f"_f_{k}" for k in range(len(columns))]

    def started(df: DataFrame) -> DataFrame:
        rows = ranker.prepared(df).withColumn("row_id", F.xxhash64("group_id", "hex_id")).select("group_id", "hex_id", "label", "row_id", *names)
        return rows.withColumn("score", F.lit(0.0)).repartition("group_id").checkpoint()

    def stepped(df: DataFrame, picked: list[str], tree) -> DataFrame:
        moved = tree.transform(VectorAssembler(inputCols=picked, outputCol="_v").transform(df))
        return moved.withColumn("score", F.col("score") + params.rate * F.col("_step")).drop("_v", "_step")

    data = started(train)
    judged = started(validation) if validation is not None and patience else None
    rng = random.Random(params.seed)
    for k in range(params.n_trees):
        picked = sorted(rng.sample(names, max(1, round(params.feature_share * len(names)))), key=names.index)
        bag = data.filter(F.pmod(F.xxhash64("group_id", F.lit(params.seed + k)), F.lit(1000)) < int(1000 * params.bagging))
        goal = VectorAssembler(inputCols=picked, outputCol="_v").transform(bag.join(gradients(bag), "row_id"))
        tree = DecisionTreeRegressor(featuresCol="_v", labelCol="target", weightCol="weight", predictionCol="_step", maxDepth=params.max_depth, minInstancesPerNode=params.min_rows, maxBins=64, seed=params.seed + k).fit(goal)
        ranker.trees.append((picked, tree))
        data = stepped(data, picked, tree)
        cut = (k + 1) % params.checkpoint_every == 0
        data = data.checkpoint() if cut else data
        if judged is not None:
            judged = stepped(judged, picked, tree)
            judged = judged.checkpoint() if cut else judged
            ndcg = ranking.ranking_metrics(judged).first()["ndcg_10"]
            if not ranker.best or ndcg > ranker.best["ndcg_10"] + 1e-12:
                ranker.best = {"ndcg_10": ndcg, "n_trees": k + 1}
            elif k + 1 - ranker.best["n_trees"] >= patience:
                break
    if ranker.best:
        del ranker.trees[ranker.best["n_trees"] :]
    return ranker


def random_search(train: DataFrame, validation: DataFrame, n_trials: int = 20, space: dict | None = None, seed: int = 42, columns: list[str] | None = None) -> list[dict]:
    """Trials (parameters, ndcg_10, seconds) drawn from the grid, best first, the earlier one on a tie."""
    rng, trials = random.Random(seed), []
    for k in range(n_trials):
        drawn = {name: rng.choice(values) for name, values in (space or SEARCH_SPACE).items()}
        began = time.time()
        ranker = fit(train, columns, Params(**drawn, seed=seed))
        fitted = time.time()
        ndcg = ranking.ranking_metrics(ranker.score(validation)).first()["ndcg_10"]
        trials.append({"trial_id": k, "ndcg_10": round(ndcg, 4), "fit_seconds": round(fitted - began, 2), "eval_seconds": round(time.time() - fitted, 2), **drawn})
    return sorted(trials, key=lambda t: (-t["ndcg_10"], t["trial_id"]))


def save(ranker: Ranker, folder: str, spark: SparkSession) -> None:
    """Trees and indexers as models, columns and parameters as JSON, importance as CSV; overwrites."""
    for k, (_, tree) in enumerate(ranker.trees):
        tree.write().overwrite().save(f"{folder}/tree_{k:05d}")
    for k, indexer in enumerate(ranker.indexers):
        indexer.write().overwrite().save(f"{folder}/indexer_{k}")
    meta = {"columns": ranker.columns, "params": asdict(ranker.params), "trees": [c for c, _ in ranker.trees], "n_indexers": len(ranker.indexers)}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/params")
    ranker.importance(spark).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/importance")


def load(folder: str, spark: SparkSession) -> Ranker:
    from pyspark.ml.feature import StringIndexerModel
    from pyspark.ml.regression import DecisionTreeRegressionModel

    meta = json.loads(spark.read.text(f"{folder}/params").first()["value"])
    indexers = [StringIndexerModel.load(f"{folder}/indexer_{k}") for k in range(meta["n_indexers"])]
    trees = [(columns, DecisionTreeRegressionModel.load(f"{folder}/tree_{k:05d}")) for k, columns in enumerate(meta["trees"])]
    return Ranker(Params(**meta["params"]), meta["columns"], indexers, trees)


def log_run(spark: SparkSession, folder: str, run: str, params: dict, metrics: dict, parent: str | None = None) -> None:
    """Appends a run to the table of runs."""
    row = (run, parent, json.dumps(params, sort_keys=True), json.dumps(metrics, sort_keys=True))
    spark.createDataFrame([row], "run string, parent string, params string, metrics string").withColumn("logged_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(folder)


def latest_run(spark: SparkSession, folder: str, name: str) -> dict | None:
    row = spark.read.parquet(folder).filter(F.col("run") == name).orderBy(F.col("logged_at").desc()).limit(1).first()
    return row.asDict() if row else None


def write_trials(spark: SparkSession, trials: list[dict], folder: str) -> None:
    """Trials, best first, as CSV, and the best one's parameters as JSON."""
    from hexflow import sinks

    names = list(trials[0])
    kinds = ", ".join(f"{n} {'long' if isinstance(trials[0][n], int) else 'double'}" for n in names)
    spark.createDataFrame([tuple(t[n] for n in names) for t in trials], kinds).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/trials")
    sinks.write_json(spark, parameters(trials[0]), f"{folder}/best_params")


def parameters(trial: dict) -> dict:
    """The parameters of a trial, without its measurements."""
    known = {f.name for f in fields(Params)}
    return {k: v for k, v in trial.items() if k in known}


def log_search(spark: SparkSession, folder: str, run: str, trials: list[dict]) -> None:
    """A run for the search, with the best trial's score, and one nested run a trial."""
    log_run(spark, folder, run, {"n_trials": len(trials)} | parameters(trials[0]), {"best_ndcg_10": trials[0]["ndcg_10"]})
    for t in trials:
        given = parameters(t)
        log_run(spark, folder, f"{run}/trial_{t['trial_id']}", given, {k: v for k, v in t.items() if k not in given and k != "trial_id"}, parent=run)


def train_final(train: DataFrame, test: DataFrame, trial: dict, folder: str, run: str, model: str, columns: list[str] | None = None) -> tuple[Ranker, dict]:
    """Fits with a trial's parameters, measures on ``test``, saves the model and logs the run with the model's place."""
    spark = train.sparkSession
    given = parameters(trial)
    ranker = fit(train, columns, Params(**given))
    metrics = ranking.ranking_metrics(ranker.score(test)).first().asDict()
    save(ranker, model, spark)
    log_run(spark, folder, run, given | {"model": model, "columns": ranker.columns}, metrics)
    return ranker, metrics
