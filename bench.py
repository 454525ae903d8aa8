"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is built from the source tables (no stage written earlier is reused) and fully executed into a no-op sink. The
time of a query is the median of its runs after one warm-up run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "agg10_period_metrics",
    "agg8_agent_metrics",
    "cln2_normalize_table",
    "cln5_classify_message",
    "cln6_duplicate_candidates",
    "prf1_inspect_table",
    "val8_relationship_findings",
    "jn2_assign_roster",
    "jn4_enrich_tickets_with_orders",
    "jn8_detect_repeat_contacts",
    "pg3_adjusted_agent_metrics",
    "sta5_period_outcomes",
    "sta8_rank_correlation",
    "agg12_case_mix_metrics",
    "eco2_ticket_economics",
    "rob4_bootstrap_summary",
    "rob5_leave_one_quarter_out",
    "txt1_eligible_text",
    "txt5_validate_predictions",
)


def session(cpus: str):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("deskgauge-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(spark, build, sf_dir: str) -> float:
    start = time.perf_counter()
    build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    from deskgauge.plans import registry

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    registered, seconds = registry.queries(), {}
    for name in HEADLINE:
        timed(spark, registered[name], sf_dir)
        seconds[name] = round(statistics.median(timed(spark, registered[name], sf_dir) for _ in range(runs)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    scale = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
