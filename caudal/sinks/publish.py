"""Checked Parquet export with a manifest."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class ExportError(RuntimeError):
    """A table of an export cannot be read back as it was written."""


def _export(spark: SparkSession, df: DataFrame, path: str, files: int | None) -> int:
    """Write one table, counting its rows on the way, and hold what is read back against the count."""
    seen = Observation()
    observed = df.observe(seen, F.count(F.lit(1)).alias("n"))
    (observed.repartition(files) if files else observed).write.parquet(path)
    there = spark.read.parquet(path).count()
    if there != seen.get["n"]:
        raise ExportError(f"{path} holds {there} rows after writing {seen.get['n']}")
    return there


def publish(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    path: str,
    manifest_fields: Mapping[str, str | None],
    files: Mapping[str, int] | None = None,
) -> dict:
    """Write every table into a new folder of this run, then the manifest that names the folder.

    A run that fails leaves the manifest, and the folder it names, as they were.
    ``files`` sets the number of files of the tables it names; others keep
    the partitions of their plan.
    """
    folder = f"run-{uuid.uuid4().hex}"
    rows = {
        name: _export(spark, df, f"{path}/{folder}/{name}", (files or {}).get(name))
        for name, df in tables.items()
    }
    # fixed values: field names of the published manifest
    manifest = {
        "exported_at": datetime.now(timezone.utc).isoformat(timespec="seconds"),
        **manifest_fields,
        "rows": rows,
        "folder": folder,
    }
    text = spark.createDataFrame([(json.dumps(manifest),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of an export: one row per table with the run's fields."""
    shape = (
        "exported_at string, run_id string, as_of_date string, policy_version string, "
        "rows map<string,bigint>, folder string"
    )
    parsed = spark.read.text(f"{path}/manifest").selectExpr(f"from_json(value, '{shape}') AS m")
    return parsed.selectExpr("m.*").selectExpr(
        "exported_at", "run_id", "as_of_date", "policy_version", "folder",
        "explode(rows) AS (table_name, n_rows)",
    )


def read_export(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of the export that the manifest names."""
    folder = read_manifest(spark, path).select("folder").first()["folder"]
    return spark.read.parquet(f"{path}/{folder}/{table}")
