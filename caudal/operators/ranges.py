"""Ordered work on keys that are too large for one task.

A window over a key puts all its rows into one task.  ``with_ranges`` cuts the
keys that are too large for that into consecutive ranges of the order column,
so a window over (key, range) stays bounded; what crosses a range border is
then carried by a table with one row per range.

A key is cut when it holds more than ``hot_rows`` rows, into ranges of about that
many.  Cuts are values of a sample, so any type that has an order will do.  The
table of cuts has at most one value per ``hot_rows`` rows and is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
_SAMPLE = 64
_HALVINGS = 24


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The keys that are too large for one task, and into how many ``_pieces`` to cut them."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter(F.col("_n") > hot_rows).select(
        *keys, F.ceil(F.col("_n") / max(hot_rows, 1)).cast("int").alias("_pieces")
    )


def cuts(df: DataFrame, keys: Sequence[str], order: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per large key: ``_cuts``, the inner borders of its ranges in ``order``.

    ``df`` has each value of ``order`` once per key, or nearly so.  About
    ``_SAMPLE`` values for each range are sampled, by a hash of the value, and sorted.
    """
    large = hot_keys(df, keys, hot_rows)
    share = min(1.0, _SAMPLE / max(hot_rows, 1))
    drawn = F.pmod(F.xxhash64(order), F.lit(1 << 30)) < int(share * (1 << 30))
    sampled = (
        df.select(*keys, order).filter(drawn)
        .join(F.broadcast(large), list(keys))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_set(order)).alias("_sorted"), F.max("_pieces").alias("_pieces"))
    )
    # as long: the product of two counts is soon beyond an int
    at = lambda i: F.ceil(i.cast("long") * F.size("_sorted") / F.col("_pieces")).cast("int")
    picked = F.transform(F.sequence(F.lit(1), F.col("_pieces") - 1), lambda i: F.element_at("_sorted", at(i)))
    return (
        sampled.filter("_pieces > 1 AND size(_sorted) > 0")
        .select(*keys, F.array_distinct(picked).alias("_cuts"))
    )


def _below(sorted_values: str, value: Column) -> Column:
    """Number of ``sorted_values`` below ``value``, by halving; ``_steps`` are the powers of two up to their number."""
    return F.aggregate("_steps", F.lit(0), lambda low, step: F.when(
        (low + step <= F.size(sorted_values)) & (F.get(sorted_values, low + step - 1) < value), low + step).otherwise(low))


def with_ranges(df: DataFrame, keys: Sequence[str], order: str, cut_points: DataFrame) -> DataFrame:
    """Add ``_range`` (0 for keys that need no cut) and ``_hot``.

    A row meets every ``_width``-th cut of its key, then the cuts between two of those, so that of n cuts it carries
    about two times the root of n.
    """
    keys = list(keys)
    wide = cut_points.withColumn("_width", F.ceil(F.sqrt(F.size("_cuts"))).cast("int"))
    powers = F.filter(F.lit([1 << k for k in reversed(range(_HALVINGS))]), lambda step: step <= F.col("_width"))
    coarse = wide.select(*keys, "_width", powers.alias("_steps"), F.filter(
        "_cuts", lambda c, i: i % F.col("_width") == F.col("_width") - 1).alias("_coarse"))
    chunks = F.sequence(F.lit(0), F.floor((F.size("_cuts") - 1) / F.col("_width")).cast("int"))
    fine = wide.select(*keys, F.explode(chunks).alias("_chunk"), "_cuts", "_width").select(
        *keys, "_chunk", F.slice("_cuts", F.col("_chunk") * F.col("_width") + 1, F.col("_width")).alias("_fine"))
    placed = df.join(F.broadcast(coarse), keys, "left").withColumns({
        "_hot": F.col("_coarse").isNotNull(), "_chunk": _below("_coarse", F.col(order))}).drop("_coarse")
    ranged = placed.join(F.broadcast(fine), [*keys, "_chunk"], "left").withColumn("_range", F.when(
        F.col("_hot"), F.col("_chunk") * F.col("_width") + F.coalesce(F.when(F.col("_fine").isNotNull(), _below("_fine", F.col(order))), F.lit(0))
    ).otherwise(F.lit(0)))
    return ranged.select(*df.columns, "_range", "_hot")
