"""Slowly changing dimensions, types 1 and 2, as batch plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caudal.functions.keys import business_columns
from caudal.operators.dedup import latest_by_key, not_null
from caudal.operators.ranges import HOT_ROWS, cuts, with_ranges

START, END = "__START_AT", "__END_AT"


def scd1(df: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """Current row per key: the one with the greatest sequence."""
    return latest_by_key(df.filter(F.col(sequence).isNotNull()), keys, [sequence])


def scd2(
    df: DataFrame,
    keys: Sequence[str],
    sequence: str,
    tracked: Sequence[str] | None = None,
    untracked: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Full history per key with the interval of every version.

    A version begins where a ``tracked`` column differs from the row before it
    in ``sequence`` and ends where the next begins; the last one is open.
    Other columns show their value at the last change of the version, so a
    change of those alone creates no version.  Arrival order is irrelevant.
    Rows without key or sequence take no part; of several rows with the same
    key and sequence the greatest full row counts.

    ``tracked`` defaults to all business columns but the keys and ``untracked``.
    """
    keys = list(keys)
    if tracked is None:
        tracked = [c for c in business_columns(df) if c not in keys and c not in untracked]
    tracked = list(tracked)
    rows = not_null(df, [*keys, sequence])
    cut_points = cuts(rows, keys, sequence, hot_rows)
    single = latest_by_key(rows, [*keys, sequence], [])
    ranged = with_ranges(single, keys, sequence, cut_points).withColumn("_state", F.struct(*tracked))

    key_range = [*keys, "_range"]
    in_range = Window.partitionBy(*key_range).orderBy(sequence)
    so_far = in_range.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    borders = _borders(ranged, keys, sequence, cut_points)
    marked = (
        ranged.withColumns({
            "_before": F.lag("_state").over(in_range),
            "_after": F.lead("_state").over(in_range),
            "_next": F.lead(sequence).over(in_range),
        })
        .join(borders, key_range, "left")  # rows are dealt by key and range already
        .withColumns({
            "_before": F.coalesce("_before", "_state_before"),
            "_after": F.coalesce("_after", "_state_after"),
            "_next": F.coalesce("_next", "_next_range"),
        })
        .withColumns({
            "_first": F.col("_before").isNull() | ~F.col("_state").eqNullSafe(F.col("_before")),
            "_last": F.col("_after").isNull() | ~F.col("_state").eqNullSafe(F.col("_after")),
        })
    )
    started = F.max(F.when(F.col("_first"), F.col(sequence))).over(so_far)
    versions = marked.withColumn(START, F.coalesce(started, F.col("_open_start"))).filter("_last")
    return versions.select(*df.columns, START, F.col("_next").alias(END))


def _borders(ranged: DataFrame, keys: list[str], sequence: str, cut_points: DataFrame) -> DataFrame:
    """What each range of a large key must know about its neighbours; one row per range."""
    key_range = [*keys, "_range"]
    in_range = Window.partitionBy(*key_range).orderBy(sequence)
    over_ranges = Window.partitionBy(*keys).orderBy("_range")
    before = F.lag("_state").over(in_range)
    per_range = (
        ranged.filter("_hot")
        .select(*key_range, sequence, "_state")
        .withColumn("_changed", before.isNotNull() & ~F.col("_state").eqNullSafe(before))
        .groupBy(*key_range)
        .agg(
            F.min(sequence).alias("_low"),
            F.min_by("_state", sequence).alias("_low_state"),
            F.max_by("_state", sequence).alias("_high_state"),
            F.max(F.when(F.col("_changed"), F.col(sequence))).alias("_inner_start"),
        )
        .withColumns({
            "_state_before": F.lag("_high_state").over(over_ranges),
            "_state_after": F.lead("_low_state").over(over_ranges),
            "_next_range": F.lead("_low").over(over_ranges),
        })
    )
    opens = F.col("_state_before").isNull() | ~F.col("_low_state").eqNullSafe(F.col("_state_before"))
    last_start = F.coalesce("_inner_start", F.when(opens, F.col("_low")))
    earlier = over_ranges.rowsBetween(Window.unboundedPreceding, -1)
    return per_range.select(
        *key_range, "_state_before", "_state_after", "_next_range",
        F.max(last_start).over(earlier).alias("_open_start"),
    )
