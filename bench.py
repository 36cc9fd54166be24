"""Headline-query bench. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select the data and
``local[N]``. Each query runs to completion into Spark's ``noop`` sink (full execution, no
driver collection, nothing cached between runs). The list runs twice: the first (cold)
pass includes JVM warm-up and code generation and is reported as ``cold_sec``; the second
(warm) pass gives the per-query times and the headline value.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trafficlens.plans.catalog import load_all  # noqa: E402
from trafficlens.session import get_spark  # noqa: E402

HEADLINE = [
    "q_error_investigation",     # flagship: filter + metrics + re-aggregate + top order
    "q_metrics_hour",            # all 12 metrics, hourly, by endpoint
    "q_metrics_day",
    "q_metrics_minute",
    "q_metrics_tz_hour",         # zone-offset buckets
    "q_metrics_tz_day",          # DST-aware local days
    "q_metrics_percentiles",     # exact percentiles
    "q_metrics_rollup_30m",
    "q_logs_default_fields",     # request-log query, sorted
    "q_logs_sample_size",        # scalar-subquery sample
    "q_f_hdr_value",             # header filter
    "q_json_items",              # json_each unnest
    "q_failed_items",            # unnest + conditional agg + HAVING
    "q_json_contains",           # patterns in the JVM, Python for texts with escapes
    "q_span_tree",               # pointer doubling, checkpointed
    "q_consumer_activity",       # join to consumers
    "q_upsert_request_logs",     # anti-join + union
    "q_metrics_range_replace",
    "q_request_details_counts",
    "q_body_key_shapes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    sf = float(m.group(1)) if m else None
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    qs = load_all()

    def run_all() -> dict[str, float]:
        out = {}
        for name in HEADLINE:
            t0 = time.perf_counter()
            qs[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            out[name] = round(time.perf_counter() - t0, 3)
        return out

    cold = run_all()
    times = run_all()
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf,
                      "cold_sec": round(sum(cold.values()), 3)}))


if __name__ == "__main__":
    main()
