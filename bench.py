"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data, BENCH_CPUS the cores. Every query is warmed up once and run
three times; the median counts. Results are written to the `noop` sink: all rows are
computed, none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import registered  # noqa: E402

HEADLINES = (
    "cell_error_report",
    "upload_verdict",
    "clean_rows",
    "csv_scan",
    "source_row_numbers",
    "ingested_rows",
    "fully_approved",
    "applied_decisions",
    "invalid_transitions",
    "integrity_audit",
    "ddl_plan",
    "expectation_log",
    "pages_as_text",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = registered()
    seconds = {}
    for name in HEADLINES:
        query = known[name][0]
        times = []
        for _ in range(RUNS + 1):
            started = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total median time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
                "cpus": int(cpus),
                "spark": spark.version,
                "runs": RUNS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
