"""Histories kept in keyed state: a stream of changes becomes a stream of versions, and no log is read again.

The state of a key holds its changes by sequence, in RocksDB on the executors and in the checkpoint. A batch loads the
state of the keys it touches only, wherever in the sequence its changes belong, and emits the versions that are new or
different (``version``) and the starts of versions that are no more (``gone``). The sink is append-only,
a folder per batch that a repeated batch overwrites; ``read_versions`` takes what was emitted last for each start.

``settle`` bounds the state: a key for which nothing came for that long keeps its open version alone, by a timer that fires in the next batch that has data.
A change that then comes with a sequence before the last one is emitted as ``late`` instead of being applied, so it is
neither lost nor able to rewrite what is settled. Without ``settle`` every late change is applied.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from caudal.operators.dedup import not_null
from caudal.operators.scd import END, START
from caudal.sinks.tables import read_if_exists

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KIND = "_kind"


def _encoded(name: str, kind: str) -> Column:
    """A sequence as a whole number of the same order."""
    if kind == "timestamp":
        return F.unix_micros(name)
    if kind == "timestamp_ntz":
        return F.unix_micros(F.to_utc_timestamp(F.col(name).cast("timestamp"), F.current_timezone()))
    if kind == "date":
        return F.unix_date(name).cast("long")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.col(name).cast("long")
    raise ValueError(f"{name}: no sequence of type {kind} in keyed state")


def _decoded(name: str, kind: str) -> Column:
    if kind == "timestamp":
        return F.timestamp_micros(name)
    if kind == "timestamp_ntz":
        return F.from_utc_timestamp(F.timestamp_micros(name), F.current_timezone()).cast("timestamp_ntz")
    return F.date_from_unix_date(F.col(name).cast("int")) if kind == "date" else F.col(name).cast(kind)


def _order(values: Sequence) -> tuple:
    """The order of rows: column by column, NULL first."""
    return tuple((v is not None, v if v is not None else 0) for v in values)


class Versions(StatefulProcessor):
    """``columns`` are those besides keys and sequence; ``tracked`` the places among them that make a version."""

    def __init__(self, keys: Sequence[str], columns: StructType, tracked: Sequence[int], settle_ms: int | None):
        self.columns, self.tracked, self.settle_ms = columns, list(tracked), settle_ms
        self.names = [*keys, *columns.names, START, END, KIND]

    def init(self, handle: StatefulProcessorHandle) -> None:
        place = StructType([StructField("place", LongType())])
        self.handle = handle
        self.changes = handle.getMapState("changes", place, self.columns)
        self.settled = handle.getValueState("settled", place)

    def versions(self, changes: dict[int, tuple]) -> dict[int, tuple]:
        """Start of each version: its values and end."""
        found, states = [], []
        for place in sorted(changes):
            state = [changes[place][i] for i in self.tracked]
            state = [None if v is None else repr(v) if v != v else v for v in state]  # NaN equals itself
            if states and states[-1] == state:
                found[-1][1] = changes[place]
            else:
                found.append([place, changes[place]])
                states.append(state)
        ends = [start for start, _ in found[1:]] + [None]
        return {start: (values, end) for (start, values), end in zip(found, ends)}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        emitted = Row(*self.names)
        changes = {k[0]: tuple(v) for k, v in self.changes.iterator()}
        before = self.versions(changes)
        floor = self.settled.get()[0] if self.settled.exists() else None
        for row in rows:
            place, values = row["_place"], tuple(row[c] for c in self.columns.names)
            if floor is not None and place < floor:
                yield emitted(*key, *values, place, None, "late")
            elif place not in changes or _order(values) > _order(changes[place]):
                changes[place] = values
                self.changes.updateValue((place,), values)
        after = self.versions(changes)
        for start in before.keys() - after.keys():
            yield emitted(*key, *before[start][0], start, None, "gone")
        for start, (values, end) in after.items():
            if before.get(start) != (values, end):
                yield emitted(*key, *values, start, end, "version")
        if self.settle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.settle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Only the first and the last change of the open version stay."""
        changes = {k[0]: tuple(v) for k, v in self.changes.iterator()}
        if changes:
            last = max(changes)
            for place in changes.keys() - {last, max(self.versions(changes))}:
                self.changes.removeKey((place,))
            self.settled.update((last,))
        return iter([])

    def close(self) -> None:
        pass


def versions_of(
    stream: DataFrame, keys: Sequence[str], sequence: str, tracked: Sequence[str], settle_ms: int | None = None
) -> DataFrame:
    """The stream of versions: all columns of ``stream`` but ``sequence``, the interval, and ``_kind``."""
    keys, kind = list(keys), dict(stream.dtypes)[sequence]
    columns = StructType([f for f in stream.schema if f.name not in (*keys, sequence)])
    rows = not_null(stream, [*keys, sequence]).withColumn("_place", _encoded(sequence, kind)).drop(sequence)
    ends = [StructField(START, LongType()), StructField(END, LongType()), StructField(KIND, StringType())]
    shape = StructType([*[stream.schema[k] for k in keys], *columns.fields, *ends])
    processor = Versions(keys, columns, [columns.names.index(c) for c in tracked], settle_ms)
    found = rows.groupBy(*keys).transformWithState(
        statefulProcessor=processor, outputStructType=shape, outputMode="Append",
        timeMode="None" if settle_ms is None else "ProcessingTime",
    )
    return found.withColumns({START: _decoded(START, kind), END: _decoded(END, kind)})


def versions_stream(
    stream: DataFrame, target: str, checkpoint: str, keys: Sequence[str], sequence: str, tracked: Sequence[str],
    settle_ms: int | None = None,
) -> None:
    """Apply all changes that are available now and stop; ``target`` and ``checkpoint`` go on from the run before."""
    spark = stream.sparkSession
    settings = {"spark.sql.streaming.stateStore.providerClass": PROVIDER,
                # with timers of processing time, batches without data would follow one another for ever
                "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    earlier = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        found = versions_of(stream, keys, sequence, tracked, settle_ms)
        query = (
            found.writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{target}/batch={i}"))
            .outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for name, value in earlier.items():
            spark.conf.set(name, value)


def read_versions(spark: SparkSession, target: str, keys: Sequence[str]) -> DataFrame | None:
    """The history as of the last batch: for each key and start what was emitted last, unless it is gone."""
    rows = read_if_exists(spark, target)
    if rows is None:
        return None
    newest = Window.partitionBy(*keys, START).orderBy(F.desc("batch"))
    # of one batch there is one row for a key and start
    last = rows.filter(F.col(KIND) != "late").withColumn("_nth", F.row_number().over(newest)).filter("_nth = 1")
    return last.filter(F.col(KIND) == "version").drop("_nth", KIND, "batch")


def read_late(spark: SparkSession, target: str) -> DataFrame | None:
    """Changes that came after their key had settled; their place in the sequence is in ``__START_AT``."""
    rows = read_if_exists(spark, target)
    return None if rows is None else rows.filter(F.col(KIND) == "late").drop(KIND, END)
