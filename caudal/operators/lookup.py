"""Range lookups in policy tables (a dozen rows) without a join row per candidate.

The policy table becomes sorted arrays, which every row searches by itself:
the large side is neither shuffled nor multiplied.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


POLICY_ROWS = 10_000


def require_policy_size(policy: DataFrame, max_rows: int = POLICY_ROWS) -> DataFrame:
    """Refuse a policy table that is no policy table; nothing is cut off."""
    if policy.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"policy table has more than {max_rows} rows: {policy.columns}")
    return policy


def first_covering(
    df: DataFrame,
    ranges: DataFrame,
    value: Column,
    upper: str,
    order: str,
    take: Sequence[str],
    group: str | None = None,
    out: str = "_match",
    checked: bool = False,
) -> DataFrame:
    """Add struct ``out``: the first range in ``order`` whose ``upper`` bound is >= ``value``.

    NULL when none covers the value.  ``group`` names a column both sides share;
    ``checked`` says that the size of ``ranges`` is known to be a policy table's.
    """
    entry = F.struct(order, *[c for c in dict.fromkeys([upper, *take]) if c != order])
    rows = ranges if checked else require_policy_size(ranges)
    rows = rows.groupBy(group) if group else rows.groupBy()
    arrays = F.broadcast(rows.agg(F.sort_array(F.collect_list(entry)).alias("_ranges")))
    joined = df.join(arrays, group, "left") if group else df.crossJoin(arrays)
    match = F.try_element_at(F.filter("_ranges", lambda r: value <= r[upper]), F.lit(1))
    return joined.withColumn(out, match).drop("_ranges")


def band_of(
    df: DataFrame, bands: DataFrame, value: Column, floor: str,
    out: str = "_band", checked: bool = False,
) -> DataFrame:
    """Add struct ``out``: the band with the highest ``floor`` <= ``value``; NULL for no value."""
    entry = F.struct(floor, *[c for c in bands.columns if c != floor])
    arrays = (bands if checked else require_policy_size(bands)).agg(
        F.sort_array(F.collect_list(entry), asc=False).alias("_bands")
    )
    match = F.try_element_at(F.filter("_bands", lambda b: b[floor] <= value), F.lit(1))
    return df.crossJoin(F.broadcast(arrays)).withColumn(out, match).drop("_bands")
