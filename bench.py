"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query is executed in full through the ``noop`` sink (no collect to the driver). The same queries
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rarefold.plans.catalog import load_all  # noqa: E402
from rarefold.session import get_spark  # noqa: E402

HEADLINE = [
    "left_join",
    "time_split_rows",
    "stratified_split_rows",
    "metric_row",
    "metric_row_by_group",
    "roc_curve",
    "moving_average",
    "infer_kinds",
    "ordinal_encode",
    "one_hot",
    "knn_minority",
    "smote",
    "smotenc",
    "marginal_sample",
    "episode_summary",
    "bootstrap_ci",
    "bootstrap_recall",
    "contributions_add_up",
    "flagship_metric_row",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, driver_memory=os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
    queries, _ = load_all()

    def timed(folder: str) -> dict[str, float]:
        times = {}
        for name in names:
            t0 = time.time()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
            print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
        return times

    top, sf = sf_dir.rstrip("/").rsplit("sf", 1)
    times = timed(sf_dir)
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}
    small = f"{top}sf0.0{sf[2:]}"
    if sf.startswith("0.") and os.path.isdir(small):
        before = timed(small)
        out["ratio"] = {k: round(t / max(before[k], 1e-3), 2) for k, t in times.items()}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
