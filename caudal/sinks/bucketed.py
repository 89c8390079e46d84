"""Tables stored by the hash of a key, so that joins and groupings by it need no shuffle.

A bucket is read by one task. A key that alone holds more rows than a task should is therefore refused, rows without a
key included; such a table stays as it is and is shuffled, where frequent keys can be split.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from caudal.operators.ranges import HOT_ROWS, hot_keys
from caudal.session import scratch_path


class FrequentKey(ValueError):
    """One value of the key has too many rows for a bucket."""


def save_bucketed(
    df: DataFrame, table: str, key: str, buckets: int, path: str | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Store ``df`` as catalog table ``table``, one sorted file for each bucket, and read it back.

    ``path`` is where its files go, by default a folder of the catalog's warehouse.
    The rows are worked out once, into the shared folder; keys are counted and buckets dealt from there.
    """
    whole = scratch_path(df.sparkSession, "whole")
    df.write.parquet(whole)
    df = df.sparkSession.read.schema(df.schema).parquet(whole)
    worst = hot_keys(df, [key], hot_rows).first()
    if worst is not None:
        raise FrequentKey(f"{table}: {key} {worst[key]!r} has more than {hot_rows} rows")
    # as many tasks as buckets, dealt as the buckets are
    writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def bucketed_inputs(
    spark: SparkSession, tables: Mapping[str, DataFrame], key: str, buckets: int, prefix: str, hot_rows: int = HOT_ROWS
) -> dict[str, DataFrame]:
    """All tables that have the column ``key`` in buckets of it, in the shared folder; the others, and those with too
    frequent a key, as they are."""
    base, out = scratch_path(spark, "buckets"), {}
    for name, df in tables.items():
        out[name] = df
        if key in df.columns:
            try:
                out[name] = save_bucketed(df, f"{prefix}_{name}", key, buckets, f"{base}/{name}", hot_rows)
            except FrequentKey:
                continue
    return out
