"""Time the headline queries after a warm-up run each, results sent to a no-op sink.

BENCH_REPEATS sets the number of timed runs, of which the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from caudal.session import local_session  # noqa: E402
from caudal.plans.options import offer_options  # noqa: E402
from caudal.plans.profile import credit_profile  # noqa: E402
from caudal.quality.metrics import gold_metrics  # noqa: E402
from caudal.session import scratch_path  # noqa: E402
from testbed.queries import GOLD_INPUTS, QUERIES, clean, policy_of  # noqa: E402

HEADLINE = [
    "silver_transactions", "dedup_latest_composite", "dq_quarantine", "csv_by_name",
    "stream_file_append", "scd2_untracked", "scd2_stream", "fx_on_date", "range_first_match",
    "anti_linked", "exact_quantiles", "credit_profile", "offer_options", "recalculated_offers",
    "products_summary", "cashflow_summary", "case_context", "observed_catalog",
]


def seconds(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def gold_seconds(spark, sf_dir: str) -> float:
    """Profile, options and their checks from stored clean tables, the build the published figure is for."""
    base = scratch_path(spark, "bench")
    for name in GOLD_INPUTS:
        clean(spark, sf_dir, name).write.parquet(f"{base}/{name}")
    taken = 0.0
    for attempt in ("warm-up", "timed"):
        started = time.perf_counter()
        tables = {name: spark.read.parquet(f"{base}/{name}") for name in GOLD_INPUTS}
        policy = policy_of(spark)
        credit_profile(tables, policy).write.parquet(f"{base}/{attempt}/profile")
        profile = spark.read.parquet(f"{base}/{attempt}/profile")
        offer_options(profile, policy).write.parquet(f"{base}/{attempt}/options")
        options = spark.read.parquet(f"{base}/{attempt}/options")
        gold_metrics(profile, options, {}, tables["customers"], policy).collect()
        taken = time.perf_counter() - started
    return taken


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = local_session(cores, "bench")
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        seconds(spark, name, sf_dir)
        times[name] = round(statistics.median(seconds(spark, name, sf_dir) for _ in range(repeats)), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    if len(sys.argv) == 1:
        times["profile_options_checks_from_silver"] = round(gold_seconds(spark, sf_dir), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cores": int(cores),
    }))


if __name__ == "__main__":
    main()
