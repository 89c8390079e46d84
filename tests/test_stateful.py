"""Histories in keyed state against the plain batch result."""

import random
import time

import pytest
from test_history import SCHEMA, by_hand, changes, versions

from caudal.operators.scd import START
from caudal.streaming.stateful import read_late, read_versions, versions_stream


def feed(spark, tmp_path, number, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def run(spark, tmp_path, per_batch=1, **more):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_batch).parquet(str(tmp_path / "in"))
    versions_stream(stream, str(tmp_path / "t"), str(tmp_path / "c"), ["k"], "seq", ["state"], **more)
    return read_versions(spark, str(tmp_path / "t"), ["k"])


def test_late_and_repeated_changes_over_restarts(spark, tmp_path):
    data = changes(21, 120)
    random.Random(1).shuffle(data)
    for i, part in enumerate((data[:50], data[50:70], data[40:60])):
        feed(spark, tmp_path, i, part)
    assert versions(run(spark, tmp_path)) == by_hand(data[:70])
    feed(spark, tmp_path, 3, data[70:])  # a new query goes on from the checkpoint
    assert versions(run(spark, tmp_path)) == by_hand(data)
    assert versions(run(spark, tmp_path)) == by_hand(data)  # nothing new
    assert read_late(spark, str(tmp_path / "t")).isEmpty()


def test_a_settled_key_keeps_its_open_version_and_sets_late_changes_aside(spark, tmp_path):
    first = [(1, 1, "a", "n1"), (1, 5, "b", "n5"), (1, 7, "b", "n7"), (2, 3, "x", "m3")]
    feed(spark, tmp_path, 0, first)
    run(spark, tmp_path, settle_ms=1)
    time.sleep(0.1)
    feed(spark, tmp_path, 1, [(2, 4, "x", "m4")])  # a batch in which the timer of key 1 fires
    run(spark, tmp_path, settle_ms=1)
    time.sleep(0.1)
    after = [(1, 9, "b", "n9"), (1, 12, "c", "n12")]
    feed(spark, tmp_path, 2, [(1, 3, "z", "late"), *after])
    found = versions(run(spark, tmp_path, settle_ms=1))
    assert found == by_hand([*first, (2, 4, "x", "m4"), *after])
    assert [(r["k"], r["state"], r[START]) for r in read_late(spark, str(tmp_path / "t")).collect()] == [(1, "z", 3)]


def test_a_text_sequence_is_refused(spark, tmp_path):
    feed(spark, tmp_path, 0, [(1, 1, "a", "n")])
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="string"):
        versions_stream(stream, str(tmp_path / "t"), str(tmp_path / "c"), ["k"], "note", ["state"])
