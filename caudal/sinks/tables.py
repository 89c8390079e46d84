"""Writing tables: rebuild, append, physical layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession

from caudal.session import shuffles_freed

REBALANCE_PARTS = 2000
"""Parts into which rows are dealt by date before Spark joins small ones and splits large ones. With fewer, a part holds many
dates, and each piece it is split into writes a file of every one of them; with more, Spark keeps only mean sizes of parts."""


def rebuild(
    df: DataFrame,
    path: str,
    partition_by: str | None = None,
    cluster_by: Sequence[str] = (),
    watch: Sequence[Column] = (),
) -> dict | None:
    """Replace the table at ``path``, schema included.

    With ``partition_by`` the rows are rebalanced by that column: few files per
    folder however large the table is, and a date that holds most of the rows is
    split over many tasks.
    ``cluster_by`` sorts the table into ranges of those columns.
    ``watch`` are named aggregates of the written rows; they are counted in the tasks that write, so none is counted twice
    if a task is repeated, and returned. What was shuffled for the table is deleted once it is written, so that tables written
    one after the other take the disk of one.
    """
    if cluster_by:
        layout = [c for c in (partition_by, *cluster_by) if c]
        df = df.repartitionByRange(*layout).sortWithinPartitions(*layout)
    elif partition_by:
        df = df.hint("rebalance", REBALANCE_PARTS, partition_by)
    seen = Observation() if watch else None
    if seen:
        df = df.observe(seen, *watch)
    writer = df.write.mode("overwrite")
    with shuffles_freed(df.sparkSession):
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return seen.get if seen else None


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def add_by_name(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``table`` plus ``rows``, matched by column name; columns ``rows`` lacks are NULL.

    A column the table does not know is an error.
    """
    unknown = [c for c in rows.columns if c not in table.columns]
    if unknown:
        raise ValueError(f"not in the table: {unknown}")
    return table.unionByName(rows, allowMissingColumns=True)


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
