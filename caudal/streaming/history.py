"""SCD tables kept up to date by a stream, on plain Parquet.

Layout below the target folder::

    log/batch=<id>/bucket=<b>       every accepted change (type 2 only)
    filters/batch=<id>              which keys each of these logs may hold (type 2 only)
    history/batch=<id>/bucket=<b>   a bucket's versions as of that batch
    commits/batch=<id>              the buckets that batch replaced, written last

A key's bucket is a hash of the key.  A batch rewrites only buckets it has
changes for, and within them recomputes only the keys it touches, from those logs of
the buckets whose filters do not rule out all of the batch's keys.  The state of a bucket is its newest committed batch, so a batch that
is run again overwrites its own folders and nothing else.  Commits also keep the
number of buckets, the columns, and how many logs were there and were read (``merge_costs``).
``compact`` merges logs and leaves replaced folders behind.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from caudal.operators.dedup import not_null
from caudal.operators.ranges import HOT_ROWS
from caudal.operators.scd import END, START, scd1, scd2
from caudal.operators.small import fits_broadcast
from caudal.sinks.tables import read_if_exists
from caudal.streaming.keyfilter import key_filters, may_hold

BUCKETS = 64


class BucketMismatch(ValueError):
    """The table was built with another number of buckets."""


def _commits(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    commits = read_if_exists(spark, f"{target}/commits")
    return commits if commits is None or before is None else commits.filter(F.col("batch") < before)


def _live_folders(commits: DataFrame | None) -> dict[int, str]:
    """The folder, below the table's, that holds each bucket's state; at most one entry per bucket."""
    if commits is None:
        return {}
    newest = commits.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()
    return {r["bucket"]: f"history/batch={r['batch']}/bucket={r['bucket']}" for r in newest}


def _stored_schema(commits: DataFrame | None) -> StructType | None:
    """Columns of all accepted changes so far, as the newest commit has them."""
    if commits is None:
        return None
    newest = commits.agg(F.max_by("columns", "batch")).first()[0]
    return StructType.fromJson(json.loads(newest)) if newest else None


def _read_folders(spark: SparkSession, target: str, folders, schema: StructType | None) -> DataFrame | None:
    """Only the named folders are listed and read, never a replaced one; columns they lack are NULL."""
    if not folders:
        return None
    reader = spark.read.option("basePath", f"{target}/{next(iter(folders)).split('/')[0]}")
    return (reader.schema(schema) if schema else reader).parquet(*sorted(f"{target}/{f}" for f in folders)).drop("batch")


def _with_versions(schema: StructType, sequence: str, scd_type: int) -> StructType:
    kind = schema[sequence].dataType
    ends = [] if scd_type == 1 else [StructField(START, kind), StructField(END, kind)]
    return StructType([*schema.fields, *ends, StructField("bucket", IntegerType())])


def _widened(known: StructType | None, batch: StructType) -> StructType:
    """Known columns, then those the batch has besides; a known column keeps its type."""
    known = known or StructType([])
    new = [StructField(f.name, f.dataType) for f in batch if f.name not in known.fieldNames()]
    return StructType([*known.fields, *new])


def _write_filters(log: DataFrame, folder: str, keys: Sequence[str]) -> None:
    key_filters(log, keys, "bucket").write.mode("overwrite").parquet(folder)


def _logs_to_read(spark: SparkSession, target: str, logs: DataFrame, touched: DataFrame, keys: list[str]) -> set[str]:
    """Folders of those ``logs`` (batch, bucket) that may hold a key of ``touched`` (bucket, keys); all that have no filter."""
    filters, name = read_if_exists(spark, f"{target}/filters"), ["batch", "bucket"]
    if filters is not None:
        filters = filters.join(logs, name, "left_semi")
        logs = logs.join(filters.select(*name).distinct(), name, "left_anti").unionByName(
            may_hold(filters, touched, keys, "bucket", name))
    return {f"log/batch={r['batch']}/bucket={r['bucket']}" for r in logs.collect()}


def merge_costs(spark: SparkSession, target: str) -> DataFrame:
    """batch, logs_seen, logs_read: earlier logs of the buckets a batch touched, and those its merge read."""
    commits = spark.read.option("mergeSchema", True).parquet(f"{target}/commits")
    return commits.groupBy("batch").agg(F.max("logs_seen").alias("logs_seen"), F.max("logs_read").alias("logs_read"))


def read_history(spark: SparkSession, target: str) -> DataFrame | None:
    """The table's current rows with their ``bucket``; None before the first commit."""
    commits = _commits(spark, target)
    if commits is None:
        return None
    last = commits.orderBy(F.desc("batch")).first()
    schema = _with_versions(_stored_schema(commits), last["sequence"], last["scd_type"])
    return _read_folders(spark, target, set(_live_folders(commits).values()), schema)


def scd_merge(
    batch: DataFrame,
    batch_id: int,
    target: str,
    keys: Sequence[str],
    sequence: str,
    scd_type: int = 2,
    tracked: Sequence[str] | None = None,
    untracked: Sequence[str] = (),
    buckets: int = BUCKETS,
    hot_rows: int = HOT_ROWS,
) -> None:
    """Merge one micro-batch into the table at ``target``; for use in ``foreachBatch``.

    A column the table does not have yet is added to it.  The number of buckets is
    the table's for good; another one is refused.
    """
    spark, keys = batch.sparkSession, list(keys)
    every_commit = _commits(spark, target)
    if every_commit is not None and not every_commit.filter(F.col("batch") == batch_id).isEmpty():
        return
    commits = None if every_commit is None else every_commit.filter(F.col("batch") < batch_id)
    if commits is not None and commits.isEmpty():
        commits = None
    if commits is not None and (kept := commits.select("buckets").first()[0]) != buckets:
        raise BucketMismatch(f"{target} has {kept} buckets, not {buckets}")
    columns = _widened(_stored_schema(commits), batch.schema)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    changes = not_null(batch, [*keys, sequence]).withColumn("bucket", bucket)
    log = f"log/batch={batch_id}"
    # a bucket that holds most of a batch is split, a small one is one file
    changes.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/{log}")
    logged = StructType([*columns.fields, StructField("bucket", IntegerType())])
    if read_if_exists(spark, f"{target}/{log}") is None:
        return
    changes = _read_folders(spark, target, {log}, logged)
    # at most ``buckets`` numbers: as literals they prune the folders of log and history
    touched = sorted(r["bucket"] for r in changes.select("bucket").distinct().collect())
    touched_keys = changes.select(*keys).distinct()
    costs = (0, 0)
    if fits_broadcast(touched_keys):
        touched_keys = F.broadcast(touched_keys)

    live = _live_folders(commits)
    current = _read_folders(spark, target, {live[b] for b in touched if b in live},
                            _with_versions(columns, sequence, scd_type))
    if scd_type == 1:
        rows = changes if current is None else current.unionByName(changes, allowMissingColumns=True)
        merged = scd1(rows, keys, sequence)
    else:
        _write_filters(changes, f"{target}/filters/batch={batch_id}", keys)
        earlier = set()
        if commits is not None:
            logs = commits.filter(F.col("bucket").isin(touched)).select(F.explode("logs").alias("batch"), "bucket").distinct()
            earlier = _logs_to_read(spark, target, logs, changes.select("bucket", *keys).distinct(), keys)
            costs = (logs.count(), len(earlier))
        own = {f"{log}/bucket={b}" for b in touched}
        every = _read_folders(spark, target, earlier | own, logged).join(touched_keys, keys, "left_semi")
        merged = scd2(every.drop("bucket"), keys, sequence, tracked, untracked, hot_rows)
        merged = merged.withColumn("bucket", bucket)
        if current is not None:
            merged = merged.unionByName(
                current.join(touched_keys, keys, "left_anti"), allowMissingColumns=True
            )
    merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(
        f"{target}/history/batch={batch_id}")
    _commit(spark, target, batch_id, [(b, [batch_id]) for b in touched], buckets, columns, sequence, scd_type, keys, costs)


def _commit(spark, target, batch_id, entries, buckets, columns: StructType, sequence, scd_type, keys, costs=(0, 0)) -> None:
    """What a batch replaced: a row per bucket with the log folders it adds, written last."""
    rows = [(b, logs, buckets, columns.json(), sequence, scd_type, keys, *costs) for b, logs in entries]
    shape = ("bucket int, logs array<int>, buckets int, columns string, sequence string, scd_type int, "
             "keys array<string>, logs_seen int, logs_read int")
    spark.createDataFrame(rows, shape).coalesce(1).write.mode("overwrite").parquet(f"{target}/commits/batch={batch_id}")


def compact(spark: SparkSession, source: str, target: str) -> None:
    """Copy a table to the new folder ``target`` as one batch: one log and one state per bucket.

    Replaced folders and the many small logs stay behind; a stream goes on with ``target`` from its next batch.
    """
    commits = _commits(spark, source)
    last = commits.orderBy(F.desc("batch")).first()
    columns = _stored_schema(commits)
    keys = last["keys"] if "keys" in commits.columns else None  # tables of earlier versions do not name them
    number, stored = last["batch"], StructType([*columns.fields, StructField("bucket", IntegerType())])
    logs = {f"log/batch={r[0]}/bucket={r[1]}" for r in
            commits.select(F.explode("logs"), "bucket").distinct().collect()}
    if last["scd_type"] == 2:
        log = _read_folders(spark, source, logs, stored)
        log.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{target}/log/batch={number}")
        if keys:
            _write_filters(log, f"{target}/filters/batch={number}", keys)
    state = read_history(spark, source)
    state.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{target}/history/batch={number}")
    held = sorted(_live_folders(commits))
    _commit(spark, target, number, [(b, [number]) for b in held], last["buckets"], columns, last["sequence"],
            last["scd_type"], keys)


def merge_stream(stream: DataFrame, target: str, checkpoint: str, **merge) -> None:
    """Apply all changes that are available now, batch by batch, and stop."""
    query = (
        stream.writeStream.foreachBatch(lambda df, i: scd_merge(df, i, target, **merge))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
