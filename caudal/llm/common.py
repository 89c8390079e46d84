"""Helpers the operators of this package share."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BROADCAST_BYTES = 16 << 20
"""A side is broadcast only if its measured rows times its row size stay below this."""


def with_row_id(df: DataFrame, name: str = "_row") -> DataFrame:
    """Number the rows. Checkpoint the result before using the numbers twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Texts that are ASCII throughout take the faster function."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    slow = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(ascii_only, F.lower(text)).otherwise(slow)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast if a job that stops at the limit finds it small enough, else leave it to the planner."""
    most = max(1, limit // row_bytes)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def row_map(
    df: DataFrame, columns: Sequence[str], schema: str, make: Callable[[], Callable[..., list[tuple]]]
) -> DataFrame:
    """Run Python over Arrow batches of the named columns.

    ``make()`` is called once per task and gives a function of column lists that
    returns rows in the order of ``schema``. Text columns arrive as UTF-8 bytes.
    """
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            step = step or make()
            lists = []
            for column in columns:
                values = batch.column(batch.schema.get_field_index(column))
                if pa.types.is_string(values.type):
                    values = values.cast(pa.binary())
                elif pa.types.is_large_string(values.type):
                    values = values.cast(pa.large_binary())
                lists.append(values.to_pylist())
            rows = step(*lists)
            if rows:
                cells = zip(*rows)
                arrays = [pa.array(values, type=field.type) for values, field in zip(cells, target)]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.select(*columns).mapInArrow(run, schema)



def unused(taken: Sequence[str], name: str) -> str:
    """``name``, or with underscores in front until no column of ``taken`` has it."""
    lowered = {c.lower() for c in taken}
    while name.lower() in lowered:
        name = f"_{name}"
    return name
