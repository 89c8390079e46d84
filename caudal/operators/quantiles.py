"""Exact continuous quantiles that never hold a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caudal.operators.ranges import HOT_ROWS, cuts, with_ranges
from caudal.session import checkpointed


def exact_quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    shares: Sequence[float],
    out: str = "quantiles",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Per group an array with the interpolated quantile for each of ``shares``.

    Equal values are counted before any sort, large groups are cut into value
    ranges, and only the rows at a wanted rank leave their range.
    """
    group = list(group)
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*group, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    counted = checkpointed(counted)  # read once for the cuts and twice for the ranks
    ranged = with_ranges(counted, group, "_v", cuts(counted, group, "_v", hot_rows))
    over_ranges = Window.partitionBy(*group).orderBy("_range")
    places = F.lit([float(s) for s in shares])
    last = F.col("_n") - 1
    # one row per range of a group
    offsets = (
        ranged.groupBy(*group, "_range").agg(F.sum("_c").alias("_size"))
        .withColumns({
            "_offset": F.sum("_size").over(over_ranges) - F.col("_size"),
            "_n": F.sum("_size").over(Window.partitionBy(*group)),
        })
        .withColumn("_wanted", F.array_distinct(F.concat(
            F.transform(places, lambda s: F.floor(s * last).cast("long")),
            F.transform(places, lambda s: F.ceil(s * last).cast("long")),
        )))
    )
    in_range = Window.partitionBy(*group, "_range").orderBy("_v")
    ranked = (
        ranged.join(offsets, [*group, "_range"])
        .withColumn("_end", F.col("_offset") + F.sum("_c").over(in_range))
        .withColumn("_hits", F.filter(
            "_wanted", lambda i: (i < F.col("_end")) & (i >= F.col("_end") - F.col("_c"))))
        .filter(F.size("_hits") > 0)
        .select(*group, "_n", "_v", F.explode("_hits").alias("_rank"))
    )
    # at most two rows per share and group reach this aggregate
    found = ranked.groupBy(*group, "_n").agg(
        F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at")
    )

    def interpolated(share):
        at = share * last
        low = F.element_at("_at", F.floor(at).cast("long"))
        high = F.element_at("_at", F.ceil(at).cast("long"))
        return low + (high - low) * (at - F.floor(at))

    return found.select(*group, F.transform(places, interpolated).alias(out))
