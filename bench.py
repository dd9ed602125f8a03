"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf"}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskloom.plans import queries as Q  # noqa: E402
from riskloom.session import get_session  # noqa: E402

HEADLINE = [
    "card_behaviour", "device_features", "entity_risk", "preprocessed", "class_balance", "fraud_by_category",
    "label_correlations", "ranking_metrics", "time_split", "graph_node_metrics", "graph_pagerank",
    "scored_fixed", "batch_summary", "rolling_fraud_rate_60s",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session(f"local[{cpus}]", partitions=int(cpus) * 2, app="riskloom-bench")
    # untimed warm-up: JVM class loading and the first Parquet footer reads
    spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        fn = Q.REGISTRY[name]
        t0 = time.time()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else None}))
    spark.stop()


if __name__ == "__main__":
    main()
