"""Time the registered queries; prints one JSON line.

BENCH_SF_DIR   folder of tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  names, separated by commas (default: the headline ones)
BENCH_REPEATS  timed runs of each query, of which the best counts (default 2)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from widemetrics import queries as registered  # noqa: E402
from widemetrics.session import local_session  # noqa: E402

HEADLINE = [
    "hist_panel",
    "seh_accumulate",
    "seh_merge",
    "seh_moving",
    "statset_accumulate",
    "statset_merge",
    "statset_moving",
    "tdigest_accumulate",
    "tdigest_quantile",
    "time_bucket",
    "time_range",
    "topk_semi_join",
    "json_datums",
    "request_explode",
    "prom_samples",
    "prom_histograms",
    "schema_discovery",
    "widen",
    "otlp_gauge",
    "otlp_request",
    "csv_rows",
    "chunked_write",
    "stream_wide",
    "stream_rollup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = [n for n in chosen.split(",") if n] or HEADLINE
    if chosen == "all":
        names = list(registered.queries())
    spark = local_session(cpus, "bench", **{"spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    # Every row and column is computed, none is brought to the driver.
    registered.hist_panel(spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in names:
        runs = []
        for _ in range(repeats):
            began = time.perf_counter()
            registered.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        timings[name] = round(min(runs), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
