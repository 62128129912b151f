"""Documents/s and MB/s at sf0.1, beside one Python process that runs the same patterns.

``python -m checks.throughput [sf_dir]``. Second runs are reported: the first compiles.
"""

from __future__ import annotations

import re
import sys
import time

from pyspark.sql import DataFrame

from checks import queries
from checks.compare import session
from inkveil import Config, catalog, find, redact, redact_documents, restore
from inkveil.functions import pyengine


def timed(job) -> float:
    for _ in range(2):
        began = time.time()
        job().write.format("noop").mode("overwrite").save()
        took = time.time() - began
    return took


def report(name: str, df: DataFrame, doc: str) -> None:
    df = df.cache()
    rows, size = df.selectExpr("count(*)", "sum(octet_length(text))").first()
    patterns = [re.compile(spec.pattern, re.IGNORECASE) for spec in catalog.TYPES]
    began, found = time.time(), 0
    for row in df.select("text").toLocalIterator():
        for pattern in patterns:
            found += len(pyengine.spans(pattern, row.text))
    twin = time.time() - began
    print(f"{name}: {rows} documents, {size / 1e6:.1f} MB; one Python process, search only: {twin:.1f} s", flush=True)
    done = redact(df, Config(), doc=doc)
    red = done.redacted.select(doc, "redacted").cache()
    red.count()
    jobs = {
        "find, all 20 types": lambda: find(df, Config(), [doc]),
        "redact, document scope": lambda: redact_documents(df, Config()),
        "redact, global scope": lambda: redact(df, Config(), doc=doc).redacted,
        "restore, global scope": lambda: restore(red, done.mapping, doc, text="redacted"),
    }
    for label, job in jobs.items():
        took = timed(job)
        print(f"  {label}: {took:.1f} s, {rows / took:.0f} documents/s, {size / took / 1e6:.1f} MB/s, {twin / took:.1f}x", flush=True)
    df.unpersist()


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = session()
    report("documents", queries.documents(spark, sf), "doc_id")
    report("service logs", queries.service_logs(spark, sf), "event_id")


if __name__ == "__main__":
    main()
