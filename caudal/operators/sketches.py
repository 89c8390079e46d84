"""Quantiles from mergeable sketches: one pass, bounded memory, a known error of rank.

A sketch is Spark's KLL aggregate: tasks build them, the shuffle moves a few kilobytes a group and task, and stored
sketches of days or runs are merged into those of months without the rows. A quantile's rank is off by at most
``rank_error(k)`` of the rows with 99 % confidence, whatever the distribution; ``operators.quantiles`` is the exact form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 400
SKETCH, ROWS = "_sketch", "_rows"


def rank_error(k: int = K) -> float:
    """The published bound of a KLL sketch for a single quantile, as a share of the rows."""
    return 2.296 / k**0.9021


def sketch(df: DataFrame, group: Sequence[str], value: str, k: int = K) -> DataFrame:
    """A sketch and the number of values for each group; NULL and NaN values take no part."""
    number = F.col(value).cast("double")
    kept = df.filter(number.isNotNull() & ~F.isnan(number))
    return kept.groupBy(*group).agg(F.kll_sketch_agg_double(number, k).alias(SKETCH), F.count(F.lit(1)).alias(ROWS))


def merge(sketches: DataFrame, group: Sequence[str], k: int = K) -> DataFrame:
    """Sketches of finer groups, of days say, as those of coarser ones."""
    return sketches.groupBy(*group).agg(F.kll_merge_agg_double(SKETCH, k).alias(SKETCH), F.sum(ROWS).alias(ROWS))


def quantiles(shares: Sequence[float], column: str = SKETCH) -> Column:
    """An array with the value at each share of the rows, from the least (0) to the greatest (1)."""
    return F.array(*[F.kll_sketch_get_quantile_double(column, F.lit(float(s))) for s in shares])


def rank_of(value: Column, column: str = SKETCH) -> Column:
    """The share of rows at or below a value."""
    return F.kll_sketch_get_rank_double(column, value)
