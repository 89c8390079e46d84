"""Append with NOT NULL, CHECK and primary-key rules, which the session catalog cannot enforce."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.operators.dedup import latest_by_key
from caudal.operators.small import shuffled_join
from caudal.session import checkpointed
from caudal.sinks.tables import append, read_if_exists


def validate(
    df: DataFrame,
    existing: DataFrame | None,
    pk: Sequence[str],
    checks: Mapping[str, str],
    required: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Split ``df`` into rows the table accepts and rows it refuses.

    Refused rows carry the ``_violations`` and, since equal rows are counted
    instead of repeated, ``_copies``.  A CHECK whose result is unknown passes,
    as in SQL.  Of several good rows with one key the greatest is accepted.
    """
    columns = df.columns
    broken = [
        F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in dict.fromkeys([*pk, *required])
    ] + [F.when(~F.coalesce(F.expr(e), F.lit(True)), F.lit(n)) for n, e in checks.items()]
    judged = (
        df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn("_violations", F.array_compact(F.array(*broken)))
    )
    if existing is not None:
        known = existing.select(*pk).distinct().withColumn("_known", F.lit(True))
        judged = shuffled_join(judged, known, pk).withColumn(
            "_violations",
            F.when(F.col("_known"), F.array_append("_violations", F.lit("duplicate key")))
            .otherwise(F.col("_violations")),
        ).drop("_known")
    judged = checkpointed(judged)  # read for the accepted, the refused and the spare rows
    good = judged.filter(F.size("_violations") == 0)
    accepted = latest_by_key(good.select(*columns), pk, [])
    # matched on the whole row, so that rows of a frequent key are spread
    row = F.md5(F.to_json(F.struct(*columns)))
    winner = accepted.select(row.alias("_same"), F.lit(1).alias("_winner"))
    spare = (
        good.withColumn("_same", row).join(winner, "_same", "left")
        .withColumn("_copies", F.col("_copies") - F.coalesce("_winner", F.lit(0)))
        .filter("_copies > 0")
        .withColumn("_violations", F.array(F.lit("duplicate key")))
    )
    refused = judged.filter(F.size("_violations") > 0)
    shape = [*columns, "_violations", "_copies"]
    return accepted, refused.select(*shape).unionByName(spare.select(*shape))


def validated_append(
    df: DataFrame,
    target: str,
    pk: Sequence[str],
    checks: Mapping[str, str],
    required: Sequence[str] = (),
) -> DataFrame:
    """Append what the table accepts to the Parquet table ``target``; return what it refuses.

    The refused rows are computed against the table as it was before.
    """
    existing = read_if_exists(df.sparkSession, target)
    accepted, refused = validate(df, existing, pk, checks, required)
    refused = checkpointed(refused)
    append(accepted, target)
    return refused
