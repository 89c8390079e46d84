"""Whole runs: files to gold, and a policy refresh on existing clean tables.

Each stage writes its tables before the next one reads them, so a failed run
can be repeated from the last written stage and no plan grows across stages.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from caudal.contracts import ENTITIES
from caudal.plans.options import offer_options
from caudal.plans.policy import Policy, resolve_policy
from caudal.plans.profile import credit_profile
from caudal.plans.silver import silver
from caudal.plans.summaries import (
    case_context, cashflow_summary, complaints_summary, products_summary,
)
from caudal.quality.gate import record_and_gate
from caudal.quality.metrics import case_metrics, clean_counts, gold_metrics, raw_counts, written_metrics
from caudal.sinks.publish import publish
from caudal.sinks.tables import rebuild
from caudal.sources.files import read_strings

PROFILE, OPTIONS = "customer_credit_profile", "customer_credit_offer_options"
CASES = "customer_case_context"
POLICY_TABLES = (
    "ref_product_catalog", "ref_term_grid", "ref_policy_params", "ref_policy_bands",
    "ref_segment_adjustments",
)


def _tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def load_bronze(
    spark: SparkSession, landing: str, base: str, entities: Sequence[str] = tuple(ENTITIES),
    multiline: bool = True, counts: dict[str, dict] | None = None,
) -> dict[str, DataFrame]:
    """CSV folders ``<landing>/<entity>`` to raw tables; ``counts`` gets what their metrics need, taken while writing."""
    for name in entities:
        spec = ENTITIES[name]
        raw = read_strings(spark, f"{landing}/{name}", spec.names, multiline=multiline)
        seen = rebuild(raw, f"{base}/bronze/{name}", spec.partition_by, watch=raw_counts(spec))
        if counts is not None:
            counts[name] = seen
    return read_bronze(spark, base, entities)


def read_bronze(
    spark: SparkSession, base: str, entities: Sequence[str] = tuple(ENTITIES)
) -> dict[str, DataFrame]:
    """Raw tables with every source column STRING, the partition column included.

    Its type is declared, since an inferred date would change texts that are not in the usual form.
    """
    tables = {}
    for name in entities:
        folder = f"{base}/bronze/{name}"
        stored = spark.read.parquet(folder).schema
        by = ENTITIES[name].partition_by
        declared = StructType([StructField(f.name, StringType()) if f.name == by else f for f in stored])
        tables[name] = spark.read.schema(declared).parquet(folder)
    return tables


def build_silver(
    spark: SparkSession, bronze: Mapping[str, DataFrame], base: str, run_id: str = "",
    counts: Mapping[str, dict] | None = None,
) -> dict[str, DataFrame]:
    """Clean tables, their metrics, and the gate; ``counts`` are those of ``load_bronze``, without which raw tables are read for them."""
    seen = {}
    for name, raw in bronze.items():
        spec = ENTITIES[name]
        seen[name] = rebuild(silver(raw, name, stored=True), f"{base}/silver/{name}", spec.partition_by, watch=clean_counts(spec))
    clean = _tables(spark, f"{base}/silver", list(bronze))
    raw_seen = {n: (counts or {}).get(n) or raw.agg(*raw_counts(ENTITIES[n])).first().asDict() for n, raw in bronze.items()}
    metrics = reduce(DataFrame.unionByName, (written_metrics(raw_seen[n], seen[n], clean[n], n) for n in bronze))
    record_and_gate(spark, metrics, f"{base}/gold/pipeline_quality_metrics",
                    ("bronze", "silver"), run_id)
    return clean


def build_credit(
    spark: SparkSession, clean: Mapping[str, DataFrame], policy: Policy, base: str
) -> dict[str, DataFrame]:
    """Profile and offer options."""
    rebuild(credit_profile(clean, policy), f"{base}/gold/{PROFILE}")
    profile = spark.read.parquet(f"{base}/gold/{PROFILE}")
    rebuild(offer_options(profile, policy), f"{base}/gold/{OPTIONS}")
    return _tables(spark, f"{base}/gold", (PROFILE, OPTIONS))


def build_summaries(
    spark: SparkSession, clean: Mapping[str, DataFrame], policy: Policy, base: str
) -> dict[str, DataFrame]:
    fx = clean["daily_exchange_rates"]
    plans = {
        "customer_products_summary": products_summary(clean["products"], fx, policy),
        "customer_complaints_summary": complaints_summary(clean["complaints"], fx),
        "customer_cashflow_summary": cashflow_summary(clean["transactions"], fx),
    }
    cases = case_context(clean["complaints"], clean["call_center_interactions"], policy)
    for name, df in {**plans, CASES: cases}.items():
        rebuild(df, f"{base}/gold/{name}")
    return _tables(spark, f"{base}/gold", [*plans, CASES])


def check_and_publish(
    spark: SparkSession,
    clean: Mapping[str, DataFrame],
    credit: Mapping[str, DataFrame],
    summaries: Mapping[str, DataFrame],
    policy: Policy,
    base: str,
    run_id: str = "",
) -> dict:
    """Gold gate, then the export; nothing is published after a failure."""
    sums = {n: df for n, df in summaries.items() if n != CASES}
    metrics = gold_metrics(credit[PROFILE], credit[OPTIONS], sums, clean["customers"], policy)
    if CASES in summaries:
        metrics = metrics.unionByName(case_metrics(summaries[CASES], policy))
    record_and_gate(spark, metrics, f"{base}/gold/pipeline_quality_metrics", ("gold",), run_id)
    tables = {**credit, **{n: policy.tables[n] for n in POLICY_TABLES}}
    return publish(spark, tables, f"{base}/exports", {
        "run_id": run_id or "manual",
        "as_of_date": str(policy.as_of_date),
        "policy_version": policy.policy_version,
    })


def run_medallion(
    spark: SparkSession,
    landing: str,
    base: str,
    policy_tables: Mapping[str, DataFrame],
    as_of: str = "",
    run_id: str = "",
) -> dict:
    """Files to published gold; returns the manifest."""
    policy = resolve_policy(dict(policy_tables), as_of)
    counts: dict[str, dict] = {}
    clean = build_silver(spark, load_bronze(spark, landing, base, counts=counts), base, run_id, counts)
    credit = build_credit(spark, clean, policy, base)
    summaries = build_summaries(spark, clean, policy, base)
    return check_and_publish(spark, clean, credit, summaries, policy, base, run_id)


def refresh_policy(
    spark: SparkSession,
    base: str,
    policy_tables: Mapping[str, DataFrame],
    as_of: str = "",
    run_id: str = "",
    sources: Sequence[str] = tuple(ENTITIES),
) -> dict:
    """Rebuild profile, options, checks and export for another cutoff or policy; ``sources`` stay."""
    policy = resolve_policy(dict(policy_tables), as_of)
    clean = _tables(spark, f"{base}/silver", tuple(sources))
    credit = build_credit(spark, clean, policy, base)
    summaries = _tables(spark, f"{base}/gold", (
        "customer_products_summary", "customer_complaints_summary", "customer_cashflow_summary"))
    return check_and_publish(spark, clean, credit, summaries, policy, base, run_id)
