"""Raw STRING tables to typed, cleaned tables with one row per business key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.contracts import ENTITIES
from caudal.operators.cleanse import apply_cast_spec
from caudal.operators.dedup import latest_by_key, latest_by_repeated_key, not_null


def typed_rows(
    bronze: DataFrame, entity: str, keep: Sequence[str] = ("_bronze_ingested_at",), keyless: bool = False
) -> DataFrame:
    """Cast and clean every row that has a key, or all with ``keyless``; duplicates are kept."""
    spec = ENTITIES[entity]
    df = bronze.withColumns({c: F.trim(c) for c in spec.trim})
    if entity == "transactions":
        df = df.withColumns({
            "transaction_country": F.when(
                F.trim("transaction_country") == "Mexico", F.lit("México")
            ).otherwise(F.col("transaction_country")),
            # the source leaves the USD amount out where the amount is in USD
            "amount_usd": F.coalesce(
                "amount_usd", F.when(F.col("currency") == "USD", F.col("amount"))
            ),
        })
    typed = apply_cast_spec(df, spec.types, keep=keep)
    return typed if keyless else not_null(typed, spec.key)


def silver(bronze: DataFrame, entity: str, wanted: Sequence[str] | None = None, stored: bool = False) -> DataFrame:
    """The current row per business key; ``wanted`` as in ``latest_by_key``.

    A ``stored`` raw table is cheap to read again: its keys are looked through first, and rows with a key of their own are not ranked.
    """
    spec = ENTITIES[entity]
    latest = latest_by_repeated_key if stored else latest_by_key
    return latest(typed_rows(bronze, entity), spec.key, spec.latest_by, wanted).withColumn(
        "_silver_processed_at", F.current_timestamp()
    )
