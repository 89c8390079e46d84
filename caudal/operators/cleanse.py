"""Column-level cleaning: names, casts, projection, defaults."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal.contracts import AUDIT_COLUMNS, DECLARED_TYPES
from caudal.functions.keys import business_columns


def sanitize_names(df: DataFrame) -> DataFrame:
    """Replace runs of characters that table formats refuse (a fixed set) by one underscore."""
    return df.toDF(*[re.sub(r"[ ,;{}()\n\t=\-]+", "_", c) for c in df.columns])


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows in which every business column is NULL."""
    present = [F.col(f"`{c}`").isNotNull() for c in business_columns(df)]
    return df.filter(reduce(or_, present)) if present else df


def ensure_columns(df: DataFrame, types: Mapping[str, str] = AUDIT_COLUMNS) -> DataFrame:
    """Add the missing ones of ``types`` as typed NULLs."""
    return df.withColumns(
        {c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns}
    )


def int_via_double(column: Column) -> Column:
    """Integers that may arrive as '805.0'."""
    return column.cast("double").cast("int")


def typed(name: str, type_name: str) -> Column:
    """A STRING column cast to its clean type."""
    source = F.col(name)
    if type_name == "string":
        return source
    return (int_via_double(source) if type_name == "int" else source.cast(type_name)).alias(name)


def apply_cast_spec(df: DataFrame, spec: Mapping[str, str], keep: Iterable[str] = ()) -> DataFrame:
    """Project to the columns of ``spec`` in its order, cast, followed by ``keep``."""
    return df.select(*[typed(c, t) for c, t in spec.items()], *keep)


def declared_type(sql_type: str) -> str:
    """Spark type for a database type such as ``bigint`` or ``numeric(10,2)``; unknown names become STRING."""
    name, _, arguments = sql_type.lower().replace(" ", "").rstrip(")").partition("(")
    if name in ("decimal", "numeric") and arguments.count(",") == 1:
        return f"decimal({arguments})"
    return DECLARED_TYPES.get(name, "string")


def flags_to_boolean(df: DataFrame, declared: Mapping[str, str]) -> DataFrame:
    """Cast the columns declared as ``bit`` to BOOLEAN."""
    bits = [c for c, t in declared.items() if t.strip().lower() == "bit" and c in df.columns]
    return df.withColumns({c: F.col(c).cast("boolean") for c in bits})


def project(
    df: DataFrame,
    columns: Mapping[str, str] | None = None,
    allow_missing: bool = False,
    exclude: Iterable[str] = (),
) -> DataFrame:
    """Select and rename ``{source: target}``, then drop ``exclude``.

    With ``allow_missing`` an absent source column becomes a NULL string.
    """
    if columns:
        absent = [c for c in columns if c not in df.columns]
        if absent and not allow_missing:
            raise ValueError(f"missing columns: {absent}")
        df = df.select(*[
            (F.lit(None).cast("string") if c in absent else F.col(f"`{c}`")).alias(target)
            for c, target in columns.items()
        ])
    return df.drop(*exclude)


def params_row(params: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Turn a (param_name, param_value) table into one wide typed row."""
    return params.agg(*[
        F.max(F.when(F.col("param_name") == name, F.col("param_value").cast(t))).alias(name)
        for name, t in types.items()
    ])
