"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is run once to warm up (JIT, file listing, planning) and then
timed over ``BENCH_REPS`` runs (median).  A run executes the whole plan
into Spark's no-op sink, so nothing is collected to the driver.  Prints
one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "q0_most_probable_pairs",
    "b6_clean",
    "c7_removal_impact",
    "d10_artificial_properties",
    "e10_build_space",
    "e14_all_pairs_similarity",
    "f7_prepare_sentences",
    "g9_build_vocabulary",
    "h9_classification_report",
    "h11_evaluate",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    from tessera.session import build_session
    from tessera.plans.queries import QUERIES

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    timings = {}
    for name in HEADLINE:
        fn = QUERIES[name]
        run(fn(spark, sf_dir))
        runs = []
        for _ in range(reps):
            t0 = time.perf_counter()
            run(fn(spark, sf_dir))
            runs.append(time.perf_counter() - t0)
        timings[name] = round(statistics.median(runs), 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total_median", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "sf": sf, "cpus": int(cpus), "reps": reps,
                      "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
