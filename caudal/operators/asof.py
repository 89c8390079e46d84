"""The latest row on or before a moment, for each row of another table.

Facts and rates of a key are put in one order, and the last rate is carried forward. Facts only ask for their distinct
moments, so a key with most of the rows costs no more than its moments; keys with more moments than one task should
hold are cut into ranges, and what is known at the end of a range is carried to the next by a table
with a row per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caudal.operators.dedup import latest_by_key, not_null
from caudal.operators.ranges import HOT_ROWS, cuts, with_ranges
from caudal.operators.small import join_small


def as_of_join(
    facts: DataFrame, rates: DataFrame, on: Sequence[str], at: str, rate_at: str, take: Sequence[str],
    out: str = "_as_of", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``facts`` with the struct ``out``: ``rate_at`` and ``take`` of the latest row of ``rates`` with the same ``on``
    whose ``rate_at`` is at most ``at``.

    NULL where there is none, or a key or moment is NULL. Rates without key or moment take no part; of rates of
    the same key and moment the greatest counts.
    """
    on = list(on)
    known = latest_by_key(not_null(rates.select(*on, rate_at, *take), [*on, rate_at]), [*on, rate_at], [])
    known = known.select(*on, F.col(rate_at).alias("_at"), F.struct(rate_at, *take).alias("_rate"))
    asked = not_null(facts, [*on, at]).select(*on, F.col(at).alias("_at")).distinct()
    moments = (
        asked.withColumn("_asked", F.lit(True)).unionByName(known.withColumn("_asked", F.lit(False)), allowMissingColumns=True)
        # one row for a moment, whichever side it is from
        .groupBy(*on, "_at").agg(F.max("_asked").alias("_asked"), F.max("_rate").alias("_rate"))
    )
    ranged = with_ranges(moments, on, "_at", cuts(moments, on, "_at", hot_rows))
    key_range = [*on, "_range"]
    so_far = Window.partitionBy(*key_range).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*on).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        ranged.filter("_hot").groupBy(*key_range).agg(F.max_by("_rate", F.when(F.col("_rate").isNotNull(), F.col("_at"))).alias("_end"))
        .withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    )
    found = (
        ranged.withColumn("_own", F.last("_rate", ignorenulls=True).over(so_far))
        .join(carried, key_range, "left").filter("_asked")
        .select(*on, F.col("_at").alias(at), F.coalesce("_own", "_carried").alias(out))
    )
    return join_small(facts, found, [*on, at])


def convert_as_of(
    df: DataFrame, fx: DataFrame, amounts: dict[str, str], currency: str, on_date: Column, target: str = "USD",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add converted amounts ``{column: output}`` and ``fx_date``: the latest rate on or before ``on_date``.

    Days without a rate take the one before, however long ago. Amounts in the target currency are kept and have no
    date; before the first rate, and without a date, the result is NULL.
    """
    rates = fx.filter(F.col("target_currency") == target).select(
        F.col("source_currency").alias("_ccy"), F.col("date").alias("_day"), F.col("exchange_rate").alias("_value"))
    keyed = df.withColumns({"_ccy": F.col(currency), "_on": on_date})
    joined = as_of_join(keyed, rates, ["_ccy"], "_on", "_day", ["_value"], "_fx", hot_rows)
    own = F.col(currency) == target
    made = {out: F.when(own, F.col(amount)).otherwise(F.col(amount) * F.col("_fx._value")) for amount, out in amounts.items()}
    return joined.withColumns({**made, "fx_date": F.when(~own, F.col("_fx._day"))}).drop("_ccy", "_on", "_fx")
