"""Clustering by several columns at once: interleaved bits of their ranks.

A column's rank is the number of quantile cuts below its value, so skewed columns use all ranks. Cuts come from a bounded
sample and are literals in the plan; a row finds its rank by comparing with a list of every sixteenth cut and
then with the sixteen that follow.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000
BITS = 8
STRIDE = 16


def quantile_cuts(df: DataFrame, column: str, parts: int, rows: int = SAMPLE_ROWS) -> list:
    """At most ``parts`` - 1 values that cut the column into parts of about equal size, of any type that has an order.

    From ``rows`` rows, those whose values, repeated ones told apart by their place, have the least hashes.
    """
    spread = F.xxhash64(F.col(column), F.monotonically_increasing_id())
    drawn = df.select(F.col(column).alias("v"), spread.alias("h")).filter("v IS NOT NULL").orderBy("h").limit(rows)
    at = F.ntile(parts).over(Window.orderBy("v"))  # one task, for the sample only
    lows = drawn.withColumn("part", at).groupBy("part").agg(F.min("v").alias("low")).filter("part > 1")
    return [r["low"] for r in lows.select("low").distinct().orderBy("low").collect()]


def rank_among(value: Column, cuts: Sequence) -> Column:
    """How many of the sorted ``cuts`` are not above the value; 0 for NULL."""
    if not cuts:
        return F.lit(0)
    every = F.array(*[F.lit(c) for c in cuts])
    coarse = F.array(*[F.lit(c) for c in cuts[STRIDE - 1 :: STRIDE]]) if len(cuts) >= STRIDE else None
    before = F.lit(0) if coarse is None else F.size(F.filter(coarse, lambda c: c <= value)) * STRIDE
    near = F.slice(every, before + 1, F.lit(STRIDE))
    return F.coalesce(before + F.size(F.filter(near, lambda c: c <= value)), F.lit(0))


def with_zorder(df: DataFrame, columns: Sequence[str], bits: int = BITS, out: str = "_z") -> DataFrame:
    """Add a number whose bits are those of the columns' ranks in turn: rows near in it are near in every column."""
    if not 0 < bits * len(columns) <= 62:
        raise ValueError(f"{bits} bits of {len(columns)} columns do not fit a long")
    ranks = [f"_rank_{i}" for i in range(len(columns))]
    ranked = df.withColumns({
        r: rank_among(F.col(c), quantile_cuts(df, c, 1 << bits)).cast("long") for r, c in zip(ranks, columns)
    })
    one = F.lit(1).cast("long")
    bit = lambda r, b: F.shiftright(F.col(r), b).bitwiseAND(one)
    key = reduce(add, (F.shiftleft(bit(r, b), b * len(ranks) + i) for b in range(bits) for i, r in enumerate(ranks)))
    return ranked.withColumn(out, key).drop(*ranks)


def rebuild_zordered(df: DataFrame, path: str, columns: Sequence[str], bits: int = BITS, files: int | None = None) -> None:
    """Replace the table at ``path``, clustered so that a filter on any of ``columns`` skips most files and row groups."""
    keyed = with_zorder(df, columns, bits)
    dealt = keyed.repartitionByRange(files, "_z") if files else keyed.repartitionByRange("_z")
    dealt.sortWithinPartitions("_z").drop("_z").write.mode("overwrite").parquet(path)
