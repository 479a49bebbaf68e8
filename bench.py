"""Wall time of the headline queries; one JSON line on standard output."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cellgraph.plans import catalog  # noqa: E402
from cellgraph.session import build_session  # noqa: E402

HEADLINE = ("label_counts", "radius_counts", "gt_in_patch", "match_gated", "match_global_grid", "build_links", "build_lineage",
            "node_speeds", "components", "score_tracking", "detection_scores", "distribution_by_sample", "per_sample_discrimination",
            "matched_contrast", "detect", "robust_stats", "current_state", "method_vs_baseline")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", "cellgraph-bench", shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                          driver_memory="12g")
    spark.sparkContext.setLogLevel("OFF")
    queries = catalog.load_all()
    spark.read.parquet(f"{folder}/events.parquet").count()  # start-up is not part of a query
    seconds = {}
    for name in names:
        start = time.perf_counter()
        df = catalog.spark_callable(queries[name])(spark, folder)
        df.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
