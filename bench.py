"""Time the headline queries: one JSON line on stdout.

    BENCH_SF_DIR   table folder (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)
    BENCH_RUNS     timed runs per query, the median counts (default 1)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

import workload
from tablegate.session import local_session

HEADLINE = (
    "table_report", "sentinel_scan", "range_check", "profile_minmax", "validate_consistency",
    "column_presence", "name_filter_fuzzy", "validate_column_names", "fields_qc",
    "validate_documents", "yaml_colon_lint", "ucd_validate", "guess_ucd", "src_documents",
    "manifest_compare", "next_table_version", "check_directory", "build_rollup", "report_rollup",
)


def run(query, spark, sf: str) -> float:
    start = time.perf_counter()
    query(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    workload.load()
    spark = local_session(cpus, partitions=int(cpus), memory="16g")
    workload.QUERIES["table_report"](spark, sf).collect()  # start-up is not measured
    timings = {}
    for name in HEADLINE:
        timings[name] = round(
            statistics.median(run(workload.QUERIES[name], spark, sf) for _ in range(runs)), 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(sf.rstrip("/")), "cpus": cpus}))


if __name__ == "__main__":
    main()
