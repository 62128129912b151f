"""Time the headline queries: one JSON line on standard output.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` choose data and cores. One untimed
query runs first.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from checks.queries import queries  # noqa: E402

HEADLINE = (
    "find_all_documents",
    "find_all_pages",
    "redact_doc_scope",
    "redact_global",
    "redact_by_source",
    "restore_global",
    "stats_by_source_lang",
    "preset_compare",
    "domain_find",
    "redact_logs_doc_scope",
    "redact_logs_by_user",
    "restore_logs_by_user",
    "risk_by_user",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 8)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = queries()
    # One untimed query starts the JVM's compilers; every timed query still plans and runs cold.
    known[HEADLINE[0]](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        began = time.time()
        known[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    result = {
        "metric": "total time of headline queries after one untimed query",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(os.path.basename(sf.rstrip("/")).removeprefix("sf") or 0),
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
