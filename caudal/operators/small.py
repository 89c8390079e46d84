"""Joins whose one side is expected to be small, and what happens when it is not."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal.operators.ranges import HOT_ROWS, hot_keys

BROADCAST_BYTES = 32 << 20


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: text and arrays by their content, everything else eight bytes."""
    parts = [F.lit(16)]
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        kind = field.dataType.simpleString()
        if kind in ("string", "binary"):
            parts.append(F.coalesce(F.octet_length(column), F.lit(0)) + 8)
        elif kind.startswith(("array", "map", "struct")):
            parts.append(F.coalesce(F.octet_length(F.to_json(column)) * 2, F.lit(0)) + 8)
        else:
            parts.append(F.lit(8))
    return reduce(add, parts)


def fits_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure, with a job that reads no more rows than could fit, whether ``df`` may be broadcast."""
    most = max_bytes // (16 + 8 * len(df.columns))
    rows, size = df.limit(most + 1).agg(F.count(F.lit(1)), F.sum(_row_bytes(df))).first()
    return rows <= most and (size or 0) <= max_bytes


def shuffled_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Sort-merge join whose frequent keys adaptive execution may split.

    Rows whose key holds a NULL match nothing; they go around the join instead of into one task.
    """
    if how not in ("left", "inner"):
        raise ValueError("left and inner joins only")
    complete = reduce(and_, (F.col(k).isNotNull() for k in on))
    joined = left.filter(complete).join(right.hint("merge"), list(on), how)
    return joined if how == "inner" else joined.unionByName(left.filter(~complete), allowMissingColumns=True)


def join_small(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    max_bytes: int = BROADCAST_BYTES,
    small: bool | None = None,
) -> DataFrame:
    """Broadcast ``right`` if its measured size allows it, else a shuffle join; ``small`` passes on a measurement."""
    if fits_broadcast(right, max_bytes) if small is None else small:
        return left.join(F.broadcast(right), list(on), how)
    return shuffled_join(left, right, on, how)


def unique_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Join to a side that is unique on ``on``, when the left side may have very frequent keys.

    Rows of frequent keys stay where they are and meet the few matching right
    rows by broadcast; all others take the shuffle join.
    """
    frequent = hot_keys(left, on, hot_rows).select(*on)  # one key per ``hot_rows`` rows at most
    few = F.broadcast(right.join(F.broadcast(frequent), list(on), "left_semi"))
    often = left.join(F.broadcast(frequent), list(on), "left_semi")
    rest = left.join(F.broadcast(frequent), list(on), "left_anti")
    return often.join(few, list(on), how).unionByName(rest.join(right, list(on), how))
