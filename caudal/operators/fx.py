"""Currency conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal.operators.small import join_small


def rates_as_of(fx: DataFrame, cutoff: Column | None = None, target: str = "USD") -> DataFrame:
    """Latest rate per currency, on or before ``cutoff`` if given: (currency, to_usd, fx_date).

    The target currency itself has rate 1 and no date.
    """
    if cutoff is not None:
        fx = fx.filter(F.col("date") <= cutoff)
    latest = (
        fx.filter(F.col("target_currency") == target)
        .groupBy(F.col("source_currency").alias("currency"))
        .agg(F.max_by("exchange_rate", "date").alias("to_usd"), F.max("date").alias("fx_date"))
    )
    own = fx.sparkSession.range(1).select(
        F.lit(target).alias("currency"), F.lit(1.0).alias("to_usd"),
        F.lit(None).cast("date").alias("fx_date"),
    )
    return latest.unionByName(own)


def convert_on_date(
    df: DataFrame,
    fx: DataFrame,
    amounts: dict[str, str],
    currency: str,
    on_date: Column,
    clamp: Column | None = None,
    target: str = "USD",
) -> DataFrame:
    """Add converted amounts ``{column: output}`` at the rate of exactly ``on_date``.

    Dates after the last known rate use the last date (``clamp`` overrides
    it); a NULL date does the same, because LEAST skips NULLs.  Amounts in the
    target currency are kept, a missing rate gives NULL.
    """
    rates = fx.filter(F.col("target_currency") == target).select(
        F.col("source_currency").alias("_ccy"), F.col("date").alias("_day"),
        F.col("exchange_rate").alias("_rate"),
    )
    if clamp is None:
        clamp = fx.agg(F.max("date")).scalar()
    keyed = df.withColumns({"_ccy": F.col(currency), "_day": F.least(on_date, clamp)})
    joined = join_small(keyed, rates, ["_ccy", "_day"])
    return joined.withColumns({
        out: F.when(F.col(currency) == target, F.col(amount)).otherwise(F.col(amount) * F.col("_rate"))
        for amount, out in amounts.items()
    }).drop("_ccy", "_day", "_rate")
