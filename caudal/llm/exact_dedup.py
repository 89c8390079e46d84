"""Exact duplicates: frequent digests are split off and removed map-side, the rest is shuffled.

DataFrame functions only. Texts are equal when they are identical after lower-casing A-Z; a null
text counts as empty. Equality is decided on SHA-256 of the normalised text.

Frequent digests come from mergeable Misra-Gries summaries (Spark's frequent-items sketch), built per
group of input partitions and then combined. A summary may name digests that are not frequent, so
candidates are counted exactly against all rows, and only verified winners - digests with more than
one row in ``COUNTERS``, so fewer than ``COUNTERS`` of them - are broadcast. What the summary misses
takes the ordinary way and is as right there.

Cases: an empty table gives an empty result; a null ``doc_id`` is smaller than any other; of repeated
rows with the same id and text exactly one stays; other columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caudal.llm.common import lower_ascii, unused
from caudal.session import checkpointed

COUNTERS = 1024
SUMMARY_GROUPS = 64


@dataclass
class Groups:
    """``rows``: _id, _digest, _row. ``hot`` and ``cold``: a row for each digest with _n and _keep (_id, _row)."""

    rows: DataFrame
    hot: DataFrame
    cold: DataFrame


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(lower_ascii(F.coalesce(text, F.lit(""))), 256))


def frequent_digests(rows: DataFrame) -> DataFrame:
    """Digests that more than one row in ``COUNTERS`` has, with exact counts: fewer than ``COUNTERS`` rows."""
    item = F.xxhash64("_digest")
    total = rows.count()
    summary = (
        rows.groupBy((F.spark_partition_id() % SUMMARY_GROUPS).alias("_group"))
        .agg(F.expr(f"approx_top_k_accumulate(xxhash64(_digest), {COUNTERS})").alias("_part"))
        .groupBy((F.col("_group") < 0).alias("_one"))  # the sketches of no group cannot be combined
        .agg(F.expr(f"approx_top_k_combine(_part, {COUNTERS})").alias("_all"))
        .select(F.explode(F.expr(f"approx_top_k_estimate(_all, {COUNTERS})")).alias("_found"))
        .select(F.col("_found.item").alias("_item"))
    )
    counted = rows.join(F.broadcast(summary), item == F.col("_item"), "left_semi")
    return checkpointed(_summed(counted).filter(F.col("_n") * COUNTERS > total))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_digest").agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.struct("_id", "_row")).alias("_keep")
    )


def group_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Groups:
    rows = docs.select(F.col(doc_id).alias("_id"), text_digest(F.col(text)).alias("_digest"))
    rows = checkpointed(rows.withColumn("_row", F.monotonically_increasing_id()))
    hot = frequent_digests(rows)
    return Groups(rows, hot, _summed(rows.join(F.broadcast(hot), "_digest", "left_anti")))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: doc_id, keep_id, group_size, kept, text_sha256."""
    found = group_copies(docs, doc_id, text)
    winners = F.broadcast(found.hot)
    decided = found.rows.join(winners, "_digest").unionByName(
        found.rows.join(winners, "_digest", "left_anti").join(found.cold, "_digest")
    )
    return decided.select(
        F.col("_id").alias(doc_id),
        F.col("_keep._id").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_row") == F.col("_keep._row")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns.

    Rows of frequent digests are kept or removed where they are; only the others meet
    the list of rows to drop in a shuffle join.
    """
    found = group_copies(docs, doc_id, text)
    digest, keep, own, same = (unused(docs.columns, n) for n in ("_digest_of", "_keep_of", "_own_id", "_same"))
    keyed = docs.withColumn(digest, text_digest(F.col(text)))
    hot = found.hot.select(F.col("_digest").alias(digest), F.col("_keep._id").alias(keep))
    cold = found.cold.select(F.col("_digest").alias(digest), F.col("_keep._id").alias(keep), "_n")
    drop = (
        keyed.select(F.col(doc_id).alias(own), digest)
        .join(F.broadcast(hot), digest, "left_anti")
        .join(cold.filter("_n > 1"), digest)
        .filter(~F.col(own).eqNullSafe(F.col(keep)))
        .select(F.col(digest).alias(same), own)
    )
    of_hot = keyed.join(F.broadcast(hot), digest).filter(F.col(doc_id).eqNullSafe(F.col(keep))).drop(keep)
    of_cold = keyed.join(F.broadcast(hot), digest, "left_anti").join(
        drop, (F.col(digest) == F.col(same)) & F.col(doc_id).eqNullSafe(F.col(own)), "left_anti"
    )
    repeated = (
        found.hot.unionByName(found.cold)
        .select("_digest", F.col("_keep._id").alias("_kept"), F.col("_keep._row").alias("_first"))
        .join(found.rows, "_digest")
        .filter((F.col("_row") != F.col("_first")) & F.col("_id").eqNullSafe(F.col("_kept")))
        .select(F.col("_digest").alias(digest)).distinct()
    )
    repeated = checkpointed(repeated)
    kept = of_hot.unionByName(of_cold)
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    # rows given twice with the same id and text: any one of them, chosen by a map-side aggregate
    whole = F.first(F.struct(*docs.columns)).alias("_whole")
    twice = kept.join(repeated, digest, "left_semi").groupBy(digest).agg(whole).select("_whole.*")
    return kept.join(repeated, digest, "left_anti").select(*docs.columns).unionByName(twice)


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH keyed AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM keyed WINDOW same AS (PARTITION BY text_sha256)
"""
