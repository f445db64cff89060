"""Bench: headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Prints one JSON line.  The headline queries share one lineage in one
session (as a user's evaluation run would): the first pays for lexing,
alignment and the checkpoint of the aligned token table, the others read it.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["classification_report", "token_label_counts", "coverage_report", "entity_report",
            "report_averages", "masked_accuracy"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from spanlab.plans import checkpoints
    from spanlab.plans.lineage import lineage
    from spanlab.plans.registry import REGISTRY
    from spanlab.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="spanlab-bench")
    checkpoints.discard(spark, sf_dir)  # a cold run: nothing that an earlier session wrote is read
    times = {}
    t_all = time.perf_counter()
    for name in HEADLINE:
        t0 = time.perf_counter()
        rows = REGISTRY[name][0](spark, sf_dir).collect()
        times[name] = round(time.perf_counter() - t0, 3)
        times[f"{name}_rows"] = len(rows)
    total = time.perf_counter() - t_all
    n_tok = lineage(spark, sf_dir).geometry.count()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_wall", "value": round(total, 3), "unit": "sec",
        "queries": {k: v for k, v in times.items() if not k.endswith("_rows")},
        "rows": {k[:-5]: v for k, v in times.items() if k.endswith("_rows")},
        "tokens": n_tok, "tokens_per_sec": round(n_tok / total, 1),
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": int(cpus),
    }))
    lineage(spark, sf_dir).release()
    spark.stop()


if __name__ == "__main__":
    main()
