"""Summarise the final (post-AQE) physical plan of registered queries:
exchanges, join strategies, aggregates, windows, pushed filters and any
Python evaluation.  Usage: python tools_plans.py <sf_dir> [query-prefix ...]"""
import re
import sys
import time

from tessera.session import build_session
from tessera.plans.queries import QUERIES

KINDS = ["ShuffleExchange|Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition",
         "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin",
         "BroadcastNestedLoopJoin", "CartesianProduct", "HashAggregate", "SortAggregate",
         "ObjectHashAggregate", "Window", "BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas",
         "ReusedExchange"]
NAMES = ["exchange", "broadcast", "bhj", "smj", "shj", "bnlj", "cartesian", "hash_agg", "sort_agg",
         "obj_agg", "window", "python", "reused"]


def final_plan(plan: str) -> str:
    if "== Final Plan ==" in plan:
        plan = plan.split("== Final Plan ==", 1)[1].split("== Initial Plan ==", 1)[0]
    return plan


def summary(plan: str) -> dict:
    plan = final_plan(plan)
    out = {"scans": len(re.findall(r"FileScan|Scan parquet|Scan ExistingRDD|Scan text|Scan csv", plan))}
    for name, pat in zip(NAMES, KINDS):
        out[name] = len(re.findall(pat, plan))
    out["single_partition"] = len(re.findall(r"Exchange SinglePartition", plan))
    out["pushed_filters"] = sorted(set(re.findall(r"PushedFilters: \[([^\]]+)\]", plan)))
    return out


def main():
    sf = sys.argv[1]
    only = sys.argv[2:]
    spark = build_session(shuffle_partitions=16)
    print("| query | sec | scans | exchanges | broadcast joins | sort-merge joins | aggregates (hash/sort/object) | windows | single-partition exchanges | cartesian/BNLJ | Python | reused |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, fn in QUERIES.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        df = fn(spark, sf)
        t0 = time.perf_counter()
        plan = df._jdf.queryExecution().executedPlan()
        plan.execute().count()  # runs this plan in the JVM, so AQE finalises it
        sec = time.perf_counter() - t0
        s = summary(plan.toString())
        print(f"| {name} | {sec:.2f} | {s['scans']} | {s['exchange']} | {s['bhj']} | {s['smj']} | "
              f"{s['hash_agg']}/{s['sort_agg']}/{s['obj_agg']} | {s['window']} | {s['single_partition']} | "
              f"{s['cartesian'] + s['bnlj']} | {s['python']} | {s['reused']} |")


if __name__ == "__main__":
    main()
