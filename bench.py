"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

Each query is run to the end on a noop sink, once to warm up and then
$BENCH_RUNS times; the best run counts. Nothing is cached between runs.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from corpusloom.plans import catalog  # noqa: E402

HEADLINE = ["q_clean", "q_process", "q_top_keywords", "q_describe",
            "q_term_counts", "q_vocab_pruned", "q_tfidf", "q_centroids",
            "q_classify", "q_match", "q_match_filtered", "q_document"]


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory",
                     os.environ.get("BENCH_MEMORY", "12g"))
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark, times = session(), {}
    # the test tables have one row group each, which would be one task
    catalog.PARTITIONS = spark.sparkContext.defaultParallelism
    for name in names:
        took = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            catalog.REGISTRY[name](spark, sf).write.format("noop").mode(
                "overwrite").save()
            took.append(time.perf_counter() - start)
        times[name] = round(min(took[1:]), 3)
        print(name, [round(t, 2) for t in took], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total seconds of headline queries",
                      "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf).name}))
    spark.stop()


if __name__ == "__main__":
    main()
