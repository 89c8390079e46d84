"""Tables of which a run replaces single partitions, all at once.

Layout below the table's folder::

    data/run=<n>/<column>=<value>   the rows that run wrote for a partition
    commits/run=<n>                 the partitions that run replaced, written last, as one file

A partition's rows are those of the newest committed run that has it. A run that ends before its commit changes nothing
a reader sees, and the next run takes its number and overwrites its leftovers. Replaced folders stay, so an
earlier state can be read with ``as_of``, until ``forget`` removes what no reader needs. One run writes at a time.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from caudal.sinks.tables import read_if_exists

class PartitionMismatch(ValueError):
    """The table is partitioned by another column, or the rows have other columns."""


def _live(commits: DataFrame, as_of: int | None) -> list[str]:
    """The folders, below the table's, that hold the rows of each partition; a name per partition."""
    if as_of is not None:
        commits = commits.filter(F.col("run") <= as_of)
    newest = commits.groupBy("value").agg(F.max_by(F.struct("run", "folder"), "run").alias("at")).select("at.*")
    return [f"data/run={r['run']}/{r['folder']}" for r in newest.filter("folder IS NOT NULL").collect()]


def replace_partitions(df: DataFrame, path: str, column: str, covers: Sequence | None = None) -> int:
    """Replace the partitions that ``df`` has rows of, and those that ``covers`` names, which are empty without rows.

    Returns the number of the run. The first run makes the table; its columns are the table's.
    """
    spark = df.sparkSession
    commits = read_if_exists(spark, f"{path}/commits")
    run, shape = 0, df.schema
    if commits is not None:
        last = commits.orderBy(F.desc("run")).first()
        run, known = last["run"] + 1, StructType.fromJson(json.loads(last["columns"]))
        if last["partition"] != column or {(f.name, f.dataType) for f in known} != {(f.name, f.dataType) for f in shape}:
            raise PartitionMismatch(f"{path} has {known.simpleString()} by {last['partition']}, not {shape.simpleString()} by {column}")
        shape = known
    folder = f"{path}/data/run={run}"
    df.select(*shape.names).hint("rebalance", column).write.mode("overwrite").partitionBy(column).parquet(folder)
    written, text = read_if_exists(spark, folder), F.col(column).cast("string")
    rows = []
    if written is not None:
        # paths come as URIs; a plus sign in them is one
        step = F.regexp_extract(F.col("_metadata.file_path"), rf"/run={run}/([^/]+)/", 1)
        name = F.url_decode(F.regexp_replace(step, r"\+", "%2B"))
        # a row per partition
        rows = [tuple(r) for r in written.select(text.alias("value"), name.alias("folder")).distinct().collect()]
    if covers is not None:
        named = spark.createDataFrame([(v,) for v in covers], StructType([shape[column]])).select(text)
        rows += [(v, None) for v in {r[0] for r in named.collect()} - {v for v, _ in rows}]
    if rows:
        _commit(spark, [(*r, column, shape.json()) for r in rows], f"{path}/commits/run={run}")
    return run


def _commit(spark: SparkSession, rows: list[tuple], folder: str) -> None:
    shape = "value string, folder string, partition string, columns string"
    spark.createDataFrame(rows, shape).coalesce(1).write.mode("overwrite").parquet(folder)


def read_partitions(spark: SparkSession, path: str, as_of: int | None = None) -> DataFrame | None:
    """The table after its last run, or after run ``as_of``; None before the first."""
    commits = read_if_exists(spark, f"{path}/commits")
    if commits is None:
        return None
    shape = StructType.fromJson(json.loads(commits.orderBy(F.desc("run")).first()["columns"]))
    folders = _live(commits, as_of)
    if not folders:
        return spark.createDataFrame([], shape)
    # only live folders are listed; filters on the partition column prune them
    rows = spark.read.schema(shape).option("basePath", f"{path}/data").parquet(*sorted(f"{path}/{f}" for f in folders))
    return rows.select(*shape.names)


def forget(spark: SparkSession, path: str, as_of: int | None = None) -> int:
    """Delete the folders of partitions that no run from ``as_of`` (the last) on shows; how many."""
    commits = read_if_exists(spark, f"{path}/commits")
    last = commits.agg(F.max("run")).first()[0]
    kept = {f for n in range(last if as_of is None else as_of, last + 1) for f in _live(commits, n)}
    written = {f"data/run={r['run']}/{r['folder']}" for r in commits.filter("folder IS NOT NULL").collect()}
    home = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = home.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = sorted(written - kept)
    # deleted one by one: a folder per replaced partition
    return sum(files.delete(spark._jvm.org.apache.hadoop.fs.Path(home, f), True) for f in gone)
