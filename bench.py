"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3).
Each query is run once to warm up; the median of the following runs counts. Results are
computed in full and thrown away by the noop sink.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from frameloom.plans.catalog import QUERIES
from frameloom.session import build_session

HEADLINE = [
    "display_histogram",
    "finite_minmax",
    "hist_exact",
    "hist_exact_big",
    "hist_tiled",
    "hist_roi",
    "hist_smooth",
    "sat_quantiles",
    "sat_quantiles_big",
    "scalemap",
    "tone_flow",
    "pyramid_avg",
    "point_lookup",
    "concat_frames",
    "align_hold",
    "pixel_program_diff",
    "whole_image_fn",
    "part_offsets",
    "natural_sort",
    "tick_clock",
    "changed_sources",
    "fuzzy_topk",
    "ingest_png",
    "ingest_npy",
    "stream_hist",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("frameloom-bench", cores=cpus, partitions=int(cpus) if cpus.isdigit() else 8, memory="12g")
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    spent = {}
    for name in HEADLINE:
        once(name)
        spent[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(spent.values()), 3),
                "unit": "sec",
                "queries": spent,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
