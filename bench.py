"""Headline queries on one machine; prints one JSON line.

Reads BENCH_SF_DIR and BENCH_CPUS. Each query is run once to warm up the JVM
and then timed, including planning, with results going to a no-op sink.

With BENCH_DEALT=1 the bench first writes the documents anew, in as many files as there are
CPUs. The given file has one row group, which one task reads, so the difference shows what that costs.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from mediasift.session import build_session
from mediasift.suite.load import QUERIES

HEADLINE = (
    "understand_posts", "keywords_topk", "keyword_counts", "analyze_content", "run_analysis",
    "ingest_media", "classify_platform", "throttle_schedule", "flatten_entries", "verify_manifest",
    "evenly_sample", "cache_first_and_last", "latest_progress",
)


def dealt(spark, sf_dir: str, files: int) -> str:
    """The same tables, the documents in so many files."""
    folder = tempfile.mkdtemp(prefix="bench-dealt-")
    for path in Path(sf_dir).glob("*.parquet"):
        if path.name == "documents.parquet":
            spark.read.parquet(str(path)).repartition(files).write.parquet(f"{folder}/{path.name}")
        else:
            os.symlink(path, f"{folder}/{path.name}")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "mediasift-bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("BENCH_DEALT") == "1":
        sf_dir = dealt(spark, sf_dir, int(cpus))
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline query seconds, warm, planning included",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
