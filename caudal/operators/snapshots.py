"""What changed between two whole deliveries of a table, and the history of a row of deliveries.

Deliveries are compared by key and a hash of the other columns, so that of unchanged rows only keys and
hashes are shuffled; whole rows are read again for the keys that changed, which usually are few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal.operators.dedup import latest_by_key, not_null
from caudal.operators.ranges import HOT_ROWS
from caudal.operators.scd import scd2
from caudal.operators.small import fits_broadcast
from caudal.session import checkpointed

CHANGE, DELETED = "_change", "_deleted"


def row_hash(columns: Sequence[str]) -> Column:
    """A hash of the values and of where NULLs are, which hashes of values alone leave out."""
    return F.xxhash64(*[part for c in columns for part in (F.col(c).isNull(), F.col(c))])


def snapshot_changes(before: DataFrame | None, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The columns of ``after`` and ``_change``: ``insert``, ``update`` or ``delete`` for each key that differs.

    A deleted row has the values it had before. Rows without a key take no part; of rows with the same key the greatest
    counts. A column that only one of the deliveries has is NULL in the other.
    """
    keys = list(keys)
    if before is None:
        return latest_by_key(not_null(after, keys), keys, []).withColumn(CHANGE, F.lit("insert"))
    for name in after.columns:
        if name not in before.columns:
            before = before.withColumn(name, F.lit(None).cast(after.schema[name].dataType))
    for name in before.columns:
        if name not in after.columns:
            after = after.withColumn(name, F.lit(None).cast(before.schema[name].dataType))
    columns = after.columns
    old, new = (latest_by_key(not_null(df.select(*columns), keys), keys, []) for df in (before, after))
    others = [c for c in columns if c not in keys]
    hashed = lambda df, name: df.select(*keys, row_hash(others).alias(name))
    kind = (F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete")
            .when(F.col("_old") != F.col("_new"), "update"))
    differ = hashed(old, "_old").join(hashed(new, "_new"), keys, "full").select(*keys, kind.alias(CHANGE))
    differ = checkpointed(differ.filter(F.col(CHANGE).isNotNull()))
    gone = differ.filter(F.col(CHANGE) == "delete")
    come = differ.filter(F.col(CHANGE) != "delete")
    if fits_broadcast(differ):
        gone, come = F.broadcast(gone), F.broadcast(come)
    return new.join(come, keys).unionByName(old.join(gone, keys)).select(*columns, CHANGE)


def with_deletions(changes: DataFrame) -> DataFrame:
    """A change feed as rows for a history: ``_deleted`` tells whether the key is gone from then on."""
    return changes.withColumn(DELETED, F.col(CHANGE) == "delete").drop(CHANGE)


def scd2_with_deletions(
    changes: DataFrame, keys: Sequence[str], sequence: str, tracked: Sequence[str] | None = None,
    untracked: Sequence[str] = (), hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The history of a feed with ``_deleted``: a deletion ends the version before it and begins none."""
    if tracked is None:
        tracked = [c for c in changes.columns if c not in (*keys, sequence, *untracked)]
    every = scd2(changes, keys, sequence, [*dict.fromkeys([*tracked, DELETED])], untracked, hot_rows)
    return existing(every)


def existing(history: DataFrame) -> DataFrame:
    """The versions of a history that are none of a deleted key."""
    return history.filter(~F.col(DELETED)).drop(DELETED)


def snapshots_to_history(
    snapshots: Sequence[tuple[object, DataFrame]], keys: Sequence[str], sequence: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Versions of all keys over whole deliveries, given as (place in the order, rows), in that order."""
    feed, before = None, None
    for place, rows in snapshots:
        changes = with_deletions(snapshot_changes(before, rows, keys)).withColumn(sequence, F.lit(place))
        feed = changes if feed is None else feed.unionByName(changes, allowMissingColumns=True)
        before = rows
    return scd2_with_deletions(feed, keys, sequence, hot_rows=hot_rows).drop(sequence)
