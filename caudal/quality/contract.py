"""Columns and types that published tables promise."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from caudal.contracts import GOLD_CONTRACT


def contract_columns(table: str) -> list[tuple[str, str]]:
    return [tuple(item.split()) for item in GOLD_CONTRACT[table].split(",")]


def contract_violations(df: DataFrame, promised: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Promised columns that are missing or have another type; extra columns are fine."""
    actual = dict(df.dtypes)
    return [(name, kind) for name, kind in promised if actual.get(name) != kind]


def contract_metrics(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The check as metric rows."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        broken = len(contract_violations(df, contract_columns(name)))
        status = "fail" if broken else "ok"
        rows.append(("gold", name, "contract_violations", float(broken), "= 0", status))
    return spark.createDataFrame(
        rows, "layer string, table_name string, metric string, value double, threshold string, status string"
    )
