"""Headline timings: prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local threads and
``BENCH_RUNS`` the measured runs (after a warm-up of all) whose median counts.
Arguments, if any, choose queries by name.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from checks.registry import QUERIES

HEADLINE = (
    "dashboard_kpis top_products_week recent_sales sales_trend_7d category_sales_month"
    " daily_summary sales_report sales_report_summary products_report categories_report"
    " users_report daily_closing export_sales export_summary stock_list low_stock dead_stock"
    " product_history debtors_list debt_summary debtor_profile debtor_statement"
    " categories_overview pos_catalogue product_search receipts ledger_intake_merge"
    " ledger_price_sales ledger_oversell ledger_stock_drift ledger_adjustments ledger_payments"
).split()


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyhouse-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(spark: SparkSession, sf_dir: str, name: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(os.environ.get("BENCH_CPUS", str(os.cpu_count())))
    names, seconds = sys.argv[1:] or HEADLINE, {}
    for name in names:
        timed(spark, sf_dir, name)
    for name in names:
        seconds[name] = round(statistics.median(timed(spark, sf_dir, name) for _ in range(runs)), 4)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "report_seconds_total",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")),
            }
        )
    )


if __name__ == "__main__":
    main()
