"""Sequence and identity expressions for change data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEQUENCE_COLUMN = "_scd_sequence_ts"


def business_columns(df: DataFrame) -> list[str]:
    """Columns that are not audit columns (those start with an underscore)."""
    return [c for c in df.columns if not c.startswith("_")]


def identity_hash(df: DataFrame) -> Column:
    """Key for sources without one: md5 over all business columns in name order."""
    # fixed values: separator and placeholder of the hashed text
    parts = [
        F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("__NULL__"))
        for c in sorted(business_columns(df))
    ]
    return F.md5(F.concat_ws("||", *parts))


def sequence_expr(columns: str | Sequence[str] | None, fmt: str | None = None) -> Column:
    """The value that orders changes of one key.

    ``None`` uses the load time, one column is used as it is (or parsed with
    ``fmt``), several columns are joined by a blank and parsed with ``fmt``.
    """
    if columns is None:
        return F.col("_bronze_ingested_at")
    if isinstance(columns, str):
        return F.to_timestamp(F.col(columns).cast("string"), fmt) if fmt else F.col(columns)
    if not fmt:
        raise ValueError("several sequence columns need a timestamp format")
    joined = F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])
    return F.to_timestamp(joined, fmt)
