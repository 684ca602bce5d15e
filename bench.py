"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = ["lift_direct", "lift_two_hop", "coverage_runs", "interval_overlap_join", "interval_union", "degree", "complement_symmetrize", "cigar_spans", "kmer_containment", "minimizers", "unitig_chains"]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    from pyspark.sql import SparkSession

    from strandline.plans import queries

    data = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        took = []
        for _ in range(RUNS):
            start = time.perf_counter()
            queries.QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
            spark.catalog.clearCache()
        times[name] = round(median(took), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(data).name.removeprefix("sf")}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
