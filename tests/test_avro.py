"""Avro files: round trips, splits, other writers' types, damaged blocks."""

import datetime
import decimal
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from caudal.sources import avro
from caudal.sources.files import read_files

SHAPE = ("i int, l long, f float, d double, s string, b boolean, y binary, dt date, ts timestamp, n timestamp_ntz, "
         "m decimal(12,3), a array<int>, q map<string,string>, r struct<x:int,z:string>")


def full_rows(n):
    rng = random.Random(n)
    some = lambda v: None if rng.random() < 0.2 else v
    return [(
        some(i - 5), some(rng.randint(-2**62, 2**62)), some(0.5 * i), some(i / 7), some("é'\"" * (i % 4)), some(i % 2 == 0), some(bytes([i % 256]) * 3),
        some(datetime.date(1965, 1, 1) + datetime.timedelta(days=400 * i)), some(datetime.datetime(1969, 12, 31, 23, 59, 59, 5) + datetime.timedelta(hours=i)),
        some(datetime.datetime(2024, 2, 29, 1, 2, 3, 456)), some(decimal.Decimal(i * 1001 - 50_000).scaleb(-3)), some([i, None, 3]), some({"k": "v", "e": None}),
        some((i, "t")),
    ) for i in range(n)]


@pytest.mark.parametrize("codec", ["null", "deflate"])
def test_round_trip_of_all_types_over_many_splits(spark, tmp_path, monkeypatch, codec):
    monkeypatch.setattr(avro, "BLOCK_BYTES", 1 << 10)
    df = spark.createDataFrame(full_rows(300), SHAPE)
    path = str(tmp_path / "t")
    df.coalesce(1).write.format(avro.register_avro(spark)).option("codec", codec).mode("append").save(path)
    back = read_files(spark, path, "avro", splitBytes=2000)
    assert back.rdd.getNumPartitions() > 4 and back.columns == [*df.columns, "_rescued_data"]
    key = lambda r: repr(r)
    assert sorted(map(key, back.drop("_rescued_data").collect())) == sorted(map(key, df.collect()))
    assert back.filter("_rescued_data IS NOT NULL").isEmpty()


def file_of(schema, bodies, codec=b"null", marker=b"0123456789abcdef"):
    """A file with one block for each list of encoded records."""
    out = avro.MAGIC + avro._number(2)
    for k, v in (("avro.schema", json.dumps(schema).encode()), ("avro.codec", codec)):
        out += avro._sized(k.encode()) + avro._sized(v)
    out += b"\0" + marker
    for records in bodies:
        out += avro._number(len(records)) + avro._sized(b"".join(records)) + marker
    return out


def test_types_of_other_writers(spark, tmp_path):
    schema = {"type": "record", "name": "r", "fields": [
        {"name": "e", "type": {"type": "enum", "name": "c", "symbols": ["A", "B"]}},
        {"name": "u", "type": ["string", "long", "null"]},
        {"name": "x", "type": {"type": "fixed", "name": "x", "size": 2}},
        {"name": "t", "type": {"type": "long", "logicalType": "timestamp-millis"}},
        {"name": "l", "type": {"type": "array", "items": "int"}},
        {"name": "o", "type": [{"type": "string"}, "null"]},
    ]}
    first = avro._number(1) + avro._number(1) + avro._number(-7) + b"ab" + avro._number(1500) + avro._number(-2) + avro._number(2) \
        + avro._number(4) + avro._number(5) + b"\0" + avro._number(0) + avro._sized(b"here")
    second = avro._number(0) + avro._number(2) + b"cd" + avro._number(0) + b"\0" + avro._number(1)
    (tmp_path / "f.avro").write_bytes(file_of(schema, [[first, second]]))
    rows = read_files(spark, str(tmp_path / "f.avro"), "avro").withColumn("t", F.unix_millis("t")).collect()
    assert [tuple(r) for r in rows] == [("B", "-7", bytearray(b"ab"), 1500, [4, 5], "here", None), ("A", None, bytearray(b"cd"), 0, [], None, None)]


@pytest.mark.parametrize("split", [40, 100, 1 << 20])
def test_a_damaged_block_is_a_rescued_row(spark, tmp_path, split):
    schema = {"type": "record", "name": "r", "fields": [{"name": "s", "type": "string"}]}
    good = [[avro._sized(f"{b}-{i}".encode()) for i in range(5)] for b in range(8)]
    data = bytearray(file_of(schema, good))
    middle = data.find(b"3-0")
    data[middle - 1] = 0x7E  # a length that leads out of the block
    (tmp_path / "bad.avro").write_bytes(data)
    (tmp_path / "none.avro").write_bytes(b"no avro at all")
    (tmp_path / "short.avro").write_bytes(file_of(schema, good[:2])[:-10])
    back = read_files(spark, str(tmp_path), "avro", splitBytes=split)
    found = back.filter("_rescued_data IS NULL")
    assert sorted(r["s"] for r in found.collect()) == sorted([f"{b}-{i}" for b in range(8) if b != 3 for i in range(5)] + [f"0-{i}" for i in range(5)])
    rescued = [json.loads(r["_rescued_data"]) for r in back.filter("s IS NULL").collect()]
    assert sorted(r["_file_path"].rsplit("/", 1)[-1] for r in rescued) == ["bad.avro", "none.avro", "short.avro"]
    assert all(r["_error"] for r in rescued)


def test_overwrite_append_and_missing_columns(spark, tmp_path):
    path, fmt = str(tmp_path / "t"), avro.register_avro(spark)
    spark.createDataFrame([(1, "a")], "k int, s string").write.format(fmt).mode("append").save(path)
    spark.createDataFrame([(2, "b")], "k int, s string").write.format(fmt).mode("overwrite").save(path)
    spark.createDataFrame([(3,)], "k int").write.format(fmt).mode("append").save(path)
    rows = read_files(spark, path, "avro", schema="k int, s string").orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(2, "b"), (3, None)]


def test_a_marker_that_spans_two_reads_is_found():
    marker = b"M" * 8 + b"N" * 8
    stream = io.BytesIO(b"x" * ((1 << 20) - 5) + marker + b"y" * 10)
    assert avro._next_marker(stream, marker, 0, 1 << 21) == (1 << 20) - 5
    assert avro._next_marker(stream, marker, 0, 100) is None
    assert avro._next_marker(stream, marker, (1 << 20) - 4, 1 << 21) is None


def test_a_search_reads_little_beyond_its_marker():
    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            found = super().read(n)
            Counting.taken += len(found)
            return found

    marker = bytes(range(16))
    assert avro._next_marker(Counting(b"x" * 5000 + marker + b"y" * (1 << 21)), marker, 0, 200_000) == 5000
    assert Counting.taken < 200_000


def test_nullable_values_and_ends_of_blocks():
    read = avro.decoder(["null", "double"])
    for schema in (["null", "long"], ["long", "null"]):
        first = 2 * schema.index("long")
        cursor = avro.Cursor(bytes([first, 0xAC, 0x02, 2 - first]))
        assert (avro.decoder(schema)(cursor), avro.decoder(schema)(cursor)) == (150, None)
    for cut in (b"", b"\x02", b"\x02abcdefg"):
        with pytest.raises(ValueError, match="ends inside"):
            read(avro.Cursor(cut))
    with pytest.raises(ValueError, match="too long"):
        avro.Cursor(b"\x80" * 12).number()
