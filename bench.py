"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINES = [
    "det_01",
    "det_31_documents",
    "line_table",
    "deps_all",
    "repo_context",
    "detectors_all",
    "taint_flows",
    "dedupe_findings",
    "risk_score",
    "report_json",
    "verdict_merge",
    "quota_attempts",
    "quota_admissions",
    "evidence_status",
    "scan_risk",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)) if cpus.isdigit() else "16")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from riskloom.plans.queries import QUERIES
    from riskloom.plans.staging import staged

    names = sys.argv[1:] or HEADLINES
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # the session starts up before the clock
    seconds: dict[str, float] = {}
    for name in names:
        with staged(spark):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    result = {
        "metric": "total wall-clock of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
