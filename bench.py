"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "visits_by_window", "sessions", "player_features", "hex_features", "features_54", "negatives_sample", "ltr_pairs_train", "pair_features", "enriched_train", "rank_metrics_past_visits", "serving_features", "serve_rank_batch", "cluster_metrics",
]


def main() -> None:
    from hexflow.plans import registry
    from hexflow.session import build_session

    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", cores=cpus, spark__sql__shuffle__partitions=str(cpus), spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["visits_by_window"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's and Spark's machinery
    took = {}
    for name in HEADLINE:
        began = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
