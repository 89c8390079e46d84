"""Incremental file ingestion: each file of a folder exactly once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal.operators.cleanse import drop_empty_rows, ensure_columns, sanitize_names
from caudal.sources.files import STREAMED, check_format, read_strings, with_provenance


def stream_files(spark: SparkSession, path: str, schema: str, fmt: str = "csv", **options) -> DataFrame:
    """Streaming read of a folder, stamped with file provenance.

    The schema is applied by position, and CSV files with another header are refused;
    ``stream_strings`` reads CSV by column name.

    Options go to the reader (``pathGlobFilter``, ``maxFilesPerTrigger``, ``ignoreCorruptFiles`` ...).
    """
    if fmt == "csv":
        options.setdefault("enforceSchema", False)
    reader = spark.readStream.format(check_format(fmt, STREAMED)).schema(schema).options(**options)
    return with_provenance(reader.load(path))


def stream_strings(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    take: Callable[[DataFrame, int], None],
    checkpoint: str,
    glob: str = "*.csv",
    files_per_batch: int = 1000,
    **reading,
) -> None:
    """CSV files of a folder by column name, each file once: ``take(rows, batch)`` for all that are there now.

    The stream is one of file names; a batch is then read like any other set of files,
    with the header of each, rescued values included (``sources.files.read_strings``).
    At most ``files_per_batch`` names reach the driver at a time.
    """
    names = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", glob).option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch).load(path).select("path")
    )

    def read(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.distinct().collect()]
        if paths:
            take(read_strings(batch.sparkSession, sorted(paths), columns, **reading), number)

    query = (
        names.writeStream.foreachBatch(read).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """Streaming read of an append-only Parquet table, with the table's own schema."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def to_bronze(df: DataFrame) -> DataFrame:
    """Staging to bronze, batch or stream: clean names, drop empty rows, stamp, complete audit columns."""
    clean = drop_empty_rows(sanitize_names(df))
    return ensure_columns(clean.withColumn("_bronze_ingested_at", F.current_timestamp()))


def append_stream(df: DataFrame, path: str, checkpoint: str) -> None:
    """Append all that is available now to a Parquet table and stop."""
    query = (
        df.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )
    query.awaitTermination()


def append_flow(df: DataFrame, path: str, flow: str, checkpoint: str) -> None:
    """One of several streams into the same table: append what is available now and stop.

    The file sink keeps one log per folder and so serves one query; here every
    flow has its folder and every batch its own below it, which a repeated
    batch overwrites.  The table has ``flow`` and ``batch`` as partition columns.
    """
    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/flow={flow}/batch={batch}")

    query = (
        df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
