"""Which files of a folder have not been taken yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def list_files(spark: SparkSession, path, glob: str = "*") -> DataFrame:
    """(path, length) of the files whose base name matches ``glob``; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob).option("recursiveFileLookup", True)
        .load(path)
        .select("path", "length")
    )


def new_files(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """Listed files that the ledger does not hold with the same size."""
    return listing.join(ledger.select("path", "length").distinct(), ["path", "length"], "left_anti")
