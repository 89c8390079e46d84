"""Stopping a run on its own metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal.quality.metrics import stamp
from caudal.sinks.tables import append


class QualityGateError(RuntimeError):
    """At least one metric of the run failed."""


def latest_run(history: DataFrame, layers: Sequence[str]) -> DataFrame:
    """The metrics of the newest run over ``layers``."""
    rows = history.filter(F.col("layer").isin(*layers))
    return rows.filter(F.col("run_at") == rows.agg(F.max("run_at")).scalar())


def gate_status(metrics: DataFrame) -> DataFrame:
    """One row: number of metrics, warnings, failures, and every failure as text."""
    failed = F.col("status") == "fail"
    text = F.concat_ws(
        "", "layer", F.lit("."), "table_name", F.lit("."), "metric", F.lit(" = "),
        F.coalesce(F.col("value").cast("string"), F.lit("null")), F.lit(" ("), "threshold", F.lit(")"),
    )
    return metrics.agg(
        F.count(F.lit(1)).alias("n_metrics"),
        F.count_if(F.col("status") == "warn").alias("n_warn"),
        F.count_if(failed).alias("n_fail"),
        # a run has some dozen metrics
        F.array_join(F.array_sort(F.collect_list(F.when(failed, text))), "; ").alias("failures"),
    )


def raise_on_failure(metrics: DataFrame) -> DataFrame:
    """The same as a plan that raises when it is run."""
    status = gate_status(metrics)
    return status.select(F.when(
        F.col("n_fail") > 0,
        F.raise_error(F.concat(F.lit("quality gate failed: "), F.col("failures"))),
    ).otherwise(F.concat(
        F.lit("quality gate passed: "), F.col("n_metrics"), F.lit(" metrics, "),
        F.col("n_warn"), F.lit(" warnings"))).alias("result"))


def record_and_gate(
    spark: SparkSession, metrics: DataFrame, history_path: str, layers: Sequence[str], run_id: str = ""
) -> None:
    """Store the metrics of this run first, then stop if one of them failed."""
    append(stamp(metrics, run_id), history_path)
    status = gate_status(latest_run(spark.read.parquet(history_path), layers)).first()
    if status["n_fail"]:
        raise QualityGateError(status["failures"])
