"""The incremental path: new files of each source to raw tables, history, snapshots and quarantine.

Layout below ``base``::

    bronze/<source>/batch=<n>       text as delivered, with provenance and rescued values
    quarantine/<source>/batch=<n>   rows that break a rule, with the rules' names
    history/<source>                change history (see streaming.history), mode ``changes``
    append/<source>/batch=<n>       accepted rows, mode ``append``
    snapshot/<source>/batch=<n>     accepted rows of whole deliveries, modes ``snapshot`` and ``snapshot_history``
    deliveries/<source>/run=<n>     deliveries that are complete, written when a run has taken all files there were
    checkpoint/<source>             which files have been taken

A batch overwrites its own folders when it is run again, so a failed run is simply repeated.

A whole delivery is a folder (or a single file) below ``<landing>/<source>``, of any number of files and batches. The
newest one is that whose first batch came last. In mode ``snapshot`` a file that comes late belongs to its
delivery, whichever that is. In mode ``snapshot_history`` each complete delivery is compared with the one before, and what was
inserted, updated or deleted goes to the history (a delivery without any accepted row counts as none); files that come for a delivery that is in the history already are set aside
in quarantine as ``late_delivery``. A file source takes a path once: another delivery needs another folder.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal.contracts import AUDIT_COLUMNS, ENTITIES, HISTORY
from caudal.operators.rules import split_by_rules
from caudal.operators.snapshots import existing, snapshot_changes, with_deletions
from caudal.plans.silver import typed_rows
from caudal.sinks.tables import read_if_exists
from caudal.sources.files import RESCUED
from caudal.streaming.history import BUCKETS, read_history, scd_merge
from caudal.streaming.ingest import stream_strings, to_bronze

MODES = ("changes", "append", "snapshot", "snapshot_history")
AUDIT = ("_bronze_ingested_at", RESCUED, *AUDIT_COLUMNS)
DELIVERY, PLACE = "_delivery", "_delivery_number"


def run_incremental(
    spark: SparkSession,
    landing: str,
    base: str,
    sources: Sequence[str] = tuple(HISTORY),
    rules: Mapping[str, Mapping[str, str]] | None = None,
    modes: Mapping[str, str] | None = None,
    extra: Mapping[str, Sequence[str]] | None = None,
    buckets: int = BUCKETS,
    files_per_batch: int = 1000,
) -> None:
    """Take what is new below ``<landing>/<source>`` into the tables of each source, and stop.

    ``rules`` are those whose violation sends a row to quarantine, as a missing key does; ``modes`` what becomes of the
    others (history unless said otherwise), and ``extra`` declares columns that a source has
    come to deliver; from then on the history has them as text.
    """
    for name in sources:
        mode = (modes or {}).get(name, "changes")
        if mode not in MODES:
            raise ValueError(f"{name}: mode {mode!r} is none of {MODES}")
        more = list((extra or {}).get(name, ()))

        def take(rows: DataFrame, batch: int, name=name, mode=mode, more=more) -> None:
            folder = f"{base}/bronze/{name}/batch={batch}"
            to_bronze(rows).write.mode("overwrite").parquet(folder)
            raw = spark.read.parquet(folder)
            if mode.startswith("snapshot"):
                raw = raw.withColumn(DELIVERY, delivery_of(F.col("_source_file_path"), f"{landing}/{name}"))
            accept(raw, batch, base, name, mode, (rules or {}).get(name, {}), more, buckets)

        stream_strings(
            spark, f"{landing}/{name}", [*ENTITIES[name].names, *more], take, f"{base}/checkpoint/{name}",
            files_per_batch=files_per_batch,
        )
        if mode.startswith("snapshot"):
            close_deliveries(spark, base, name)
        if mode == "snapshot_history":
            merge_deliveries(spark, base, name, buckets)


def delivery_of(path: Column, root: str) -> Column:
    """The folder or file right below ``root`` that a file's path leads through."""
    bare = re.sub(r"^\w+:/+", "", root).strip("/")
    folder = f"/{quote(bare, safe='/:=+@,;!$&~')}/"  # as in paths that Spark reports
    below = F.substring(path, F.instr(path, folder) + len(folder), F.length(path))
    return F.substring_index(below, "/", 1)


def accept(
    raw: DataFrame, batch: int, base: str, name: str, mode: str, rules: Mapping[str, str], more: Sequence[str],
    buckets: int = BUCKETS,
) -> None:
    """Type one raw batch, set aside what breaks a rule, and store the rest as ``mode`` says."""
    spec, settings = ENTITIES[name], HISTORY[name]
    kept = [c for c in (*AUDIT, DELIVERY) if c in raw.columns]
    typed = typed_rows(raw, name, (*more, *kept), keyless=True)
    keyed = {f"{key}_missing": f"{key} IS NOT NULL" for key in spec.key}
    if mode == "snapshot_history" and (merged := merged_deliveries(raw.sparkSession, base, name)) is not None:
        late = merged.select(DELIVERY, F.lit(True).alias("_late"))
        typed = typed.join(late, DELIVERY, "left").withColumn("_late", F.coalesce("_late", F.lit(False)))
        keyed["late_delivery"] = "NOT _late"
    valid, bad = split_by_rules(typed, {**keyed, **rules}, name)
    valid, bad = valid.drop("_late"), bad.drop("_late")
    bad.write.mode("overwrite").parquet(f"{base}/quarantine/{name}/batch={batch}")
    if mode != "changes":
        valid.write.mode("overwrite").parquet(f"{base}/{mode.split('_')[0]}/{name}/batch={batch}")
        return
    sequence = settings["sequence"] or "_bronze_ingested_at"
    scd_merge(valid, batch, f"{base}/history/{name}", list(spec.key), sequence,
              untracked=settings["untracked"], buckets=buckets)


def close_deliveries(spark: SparkSession, base: str, name: str) -> None:
    """Note the deliveries of which rows were taken and that are not noted yet: all their files that were there are in.

    They are numbered by the batch they began in, so numbers never change.
    """
    rows = read_if_exists(spark, f"{base}/snapshot/{name}")
    if rows is None:
        return
    begun = rows.groupBy(DELIVERY).agg(F.min("batch").cast("long").alias("_begun"))
    known = read_if_exists(spark, f"{base}/deliveries/{name}")
    if known is not None:
        begun = begun.join(known, DELIVERY, "left_anti")
    first = 0 if known is None else (known.agg(F.max("run")).first()[0] or 0) + 1
    new = begun.withColumn(PLACE, F.struct("_begun", DELIVERY))
    if not new.isEmpty():
        new.coalesce(1).write.mode("overwrite").parquet(f"{base}/deliveries/{name}/run={first}")


def merged_deliveries(spark: SparkSession, base: str, name: str) -> DataFrame | None:
    """Deliveries that are in the history, with the batch of the history each became."""
    return read_if_exists(spark, f"{base}/merged/{name}")


def merge_deliveries(spark: SparkSession, base: str, name: str, buckets: int = BUCKETS) -> None:
    """Compare every complete delivery that is not in the history with the one before, and add what changed."""
    known = read_if_exists(spark, f"{base}/deliveries/{name}")
    if known is None:
        return
    merged = merged_deliveries(spark, base, name)
    done = [] if merged is None else [r[DELIVERY] for r in merged.orderBy("batch").collect()]  # a name per delivery
    waiting = [r[DELIVERY] for r in known.orderBy(PLACE).collect() if r[DELIVERY] not in done]
    rows = spark.read.option("mergeSchema", True).parquet(f"{base}/snapshot/{name}").drop("batch")
    audit = [c for c in AUDIT if c in rows.columns]
    before = rows.filter(F.col(DELIVERY) == done[-1]) if done else None
    for number, delivery in enumerate(waiting, len(done)):
        after = rows.filter(F.col(DELIVERY) == delivery)
        plain = [df and df.drop(DELIVERY, *audit) for df in (before, after)]
        feed = with_deletions(snapshot_changes(*plain, list(ENTITIES[name].key))).withColumn(PLACE, F.lit(number))
        scd_merge(feed, number, f"{base}/history/{name}", list(ENTITIES[name].key), PLACE, buckets=buckets,
                  tracked=[c for c in feed.columns if c not in (*ENTITIES[name].key, PLACE)])
        spark.createDataFrame([(delivery,)], f"{DELIVERY} string").write.mode("overwrite").parquet(
            f"{base}/merged/{name}/batch={number}")
        before = after


def read_snapshot(spark: SparkSession, base: str, name: str) -> DataFrame | None:
    """All rows of the newest complete delivery of a source in mode ``snapshot``."""
    known = read_if_exists(spark, f"{base}/deliveries/{name}")
    if known is None:
        return None
    newest = known.orderBy(F.desc(PLACE)).first()[DELIVERY]
    rows = spark.read.option("mergeSchema", True).parquet(f"{base}/snapshot/{name}")
    return rows.filter(F.col(DELIVERY) == newest).drop("batch", DELIVERY)


def read_snapshot_history(spark: SparkSession, base: str, name: str) -> DataFrame | None:
    """Versions of a source in mode ``snapshot_history``, by delivery number; a key that vanished has no open one."""
    history = read_history(spark, f"{base}/history/{name}")
    return None if history is None else existing(history).drop(PLACE, "bucket")
