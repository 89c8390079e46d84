"""File sources: formats, provenance, CSV by column name with rescued data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal.operators.small import join_small
from caudal.session import checkpointed
from caudal.sources.avro import register_avro
from caudal.sources.excel import register_excel

#: avro and xlsx are read by sources.avro and sources.excel, in batches only
FORMATS = ("csv", "json", "parquet", "text", "xml", "orc", "binaryFile", "avro", "xlsx")
RESCUED = "_rescued_data"


STREAMED = tuple(f for f in FORMATS if f not in ("avro", "xlsx"))


def check_format(fmt: str, formats: Sequence[str] = FORMATS) -> str:
    if fmt not in formats:
        raise ValueError(f"format {fmt!r} has no reader here; use one of {formats}")
    return fmt


def read_files(spark: SparkSession, path, fmt: str, schema: str | None = None, **options) -> DataFrame:
    """Batch read of a folder; self-describing formats and XML may leave out ``schema``."""
    own = {"avro": register_avro, "xlsx": register_excel}.get(check_format(fmt))
    name = own(spark) if own else fmt
    reader = spark.read.format(name).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def with_provenance(df: DataFrame) -> DataFrame:
    """Stamp each row with its file and the load time; ``df`` must come from a file source."""
    return df.select(
        "*",
        F.current_timestamp().alias("_staging_ingested_at"),
        F.col("_metadata.file_path").alias("_source_file_path"),
        F.col("_metadata.file_name").alias("_source_file_name"),
        F.col("_metadata.file_size").cast("bigint").alias("_source_file_size"),
        F.col("_metadata.file_modification_time").alias("_source_file_modified"),
    )


def csv_headers(spark: SparkSession, path, **options) -> DataFrame:
    """(path, header): the first line of every file, found by one row per file and task."""
    lines = spark.read.options(**options).text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_line"),
    )
    return lines.filter("_start = 0").groupBy("_path").agg(
        F.regexp_replace(F.min_by("value", "_line"), "^﻿", "").alias("_header")
    )


def _positions(names: Column, columns: Sequence[str]) -> list[Column]:
    """Where each declared column is in a header, first occurrence, from 1; NULL if it is not there."""
    return [F.nullif(F.array_position(names, c), F.lit(0)).cast("int") for c in columns]


def _layouts(spark: SparkSession, path, columns: Sequence[str], sep: str, **options) -> tuple[DataFrame, int]:
    """For each file: _path, _where (of declared columns), _extra (key and position of others), _fields.

    A key is the column's name; names that are empty, repeated, begin with ``_`` or hold ``#`` get ``#``
    and the position, so keys never repeat.  The second value is the widest header's number of fields or more.
    """
    headers = checkpointed(csv_headers(spark, path, **options))  # the only pass over the lines
    separators = F.length("_header") - F.length(F.replace("_header", F.lit(sep), F.lit("")))
    width = (headers.agg(F.max(separators)).first()[0] or 0) // len(sep) + 1
    fields = ", ".join(f"_c{i} string" for i in range(width))
    parsed = F.from_csv("_header", F.lit(fields), {"sep": sep, "escape": '"'})
    cells = F.array(*[parsed[f"_c{i}"] for i in range(width)])
    count = _field_count(sep, "_header")
    names = F.transform(F.slice(cells, F.lit(1), count), lambda n: F.trim(F.coalesce(n, F.lit(""))))
    listed = headers.select("_path", names.alias("_names"))

    def other(name: Column, i: Column) -> Column:
        plain = name.rlike("^[^_#][^#]*$") & (
            F.size(F.filter("_names", lambda n: n == name)) == 1)
        key = F.when(plain, name).otherwise(F.concat(name, F.lit("#"), i + 1))
        declared = name.isin(list(columns)) & (F.array_position("_names", name) == i + 1)
        return F.when(~declared, F.struct(key.alias("name"), (i + 1).alias("at")))

    return listed.select(
        "_path", F.array(*_positions(F.col("_names"), columns)).alias("_where"),
        F.array_compact(F.transform("_names", other)).alias("_extra"), F.size("_names").alias("_fields"),
    ), width


def read_strings(
    spark: SparkSession,
    path,
    columns: Sequence[str],
    sep: str = ",",
    multiline: bool = True,
    rescue: str = RESCUED,
    **options,
) -> DataFrame:
    """CSV files to STRING ``columns`` by header name, whatever the column order of each file.

    Columns a file lacks are NULL.  Values of columns that are not declared, repeated
    names included, and the text of rows whose number of fields is wrong, go to ``rescue`` as
    JSON; no row is lost.  ``_source_file_path`` and ``_bronze_ingested_at`` are added.
    Headers are found in one pass over the lines and stored; rows are read once.
    """
    file_options = {k: v for k, v in options.items()
                    if k in ("pathGlobFilter", "recursiveFileLookup", "modifiedAfter", "modifiedBefore")}
    layouts, width = _layouts(spark, path, columns, sep, **file_options)
    positional = ", ".join(f"_c{i} string" for i in range(width))
    raw = (
        spark.read.schema(f"{positional}, _corrupt_record string")
        .options(**options)
        .option("header", True).option("sep", sep).option("escape", '"')
        .option("multiLine", multiline).option("columnNameOfCorruptRecord", "_corrupt_record")
        .csv(path)
        # below the join, so that a filter on the result, which Spark moves down to the join, does not repeat the array for each column
        .select(F.array(*[f"_c{i}" for i in range(width)]).alias("_values"), "_corrupt_record",
                F.col("_metadata.file_path").alias("_path"))
    )
    raw = join_small(raw, layouts, ["_path"])
    unknown = F.map_from_entries(F.transform(
        "_extra", lambda e: F.struct(e["name"], F.try_element_at("_values", e["at"]))
    ))
    malformed = F.col("_corrupt_record").isNotNull() & (_field_count(sep) != F.col("_fields"))
    rescued = F.map_concat(
        F.map_filter(unknown, lambda _, v: v.isNotNull()),
        F.when(malformed, F.create_map(F.lit("_malformed"), F.col("_corrupt_record")))
        .otherwise(F.create_map().cast("map<string,string>")),
    )
    # most rows have nothing to rescue and need no map
    some = (F.size("_extra") > 0) | F.col("_corrupt_record").isNotNull()
    return raw.withColumn("_rescued", F.when(some, rescued)).select(
        *[F.try_element_at("_values", F.element_at("_where", i + 1)).alias(c) for i, c in enumerate(columns)],
        F.when(
            F.size("_rescued") > 0,
            F.to_json(F.map_concat("_rescued", F.create_map(F.lit("_file_path"), F.col("_path")))),
        ).alias(rescue),
        F.col("_path").alias("_source_file_path"),
        F.current_timestamp().alias("_bronze_ingested_at"),
    )


def _field_count(sep: str, text: str = "_corrupt_record") -> Column:
    """Fields in the text of a row: separators outside of quotes, plus one."""
    bare = F.regexp_replace(text, r'"([^"]|"")*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1

