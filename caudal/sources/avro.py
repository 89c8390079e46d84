"""Avro files, read and written through the Python data source API.

A file is cut into splits of ``splitBytes``, and a task begins at the first sync marker of its split, so one large file
feeds many tasks. Blocks become Arrow batches. A block that cannot be read is one row, with the reason, the file and the
place as JSON in ``_rescued_data``, and reading goes on at the next marker. Files are opened through pyarrow's file systems
(local, HDFS, S3), so a path means the same on every executor.

Codecs: ``null``, ``deflate``, ``zstandard``. Unions are read if they are one type or null, or several of which each
value is then JSON text. A column that a file lacks is NULL.
"""

from __future__ import annotations

import datetime
import decimal
import io
import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    ArrayType, BinaryType, BooleanType, ByteType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType,
    LongType, MapType, ShortType, StringType, StructField, StructType, TimestampNTZType, TimestampType,
)

NAME, RESCUED = "avro_blocks", "_rescued_data"
MAGIC, MARKER = b"Obj\x01", 16
SPLIT_BYTES = 64 << 20
BLOCK_BYTES = 1 << 16
SEARCH_BYTES = 1 << 17
DOUBLE = struct.Struct("<d").unpack_from
ONE_BYTE = [bytes([n]) for n in range(0x80)]
EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)
DAY = datetime.date(1970, 1, 1)
# fixed values: Avro's simple types
SIMPLE = {"boolean": BooleanType(), "int": IntegerType(), "long": LongType(), "float": FloatType(), "double": DoubleType(),
          "bytes": BinaryType(), "string": StringType()}


# --- types and values --------------------------------------------------------

def _branches(schema) -> tuple[list, bool]:
    """The types of a union besides null, and whether null is one."""
    if not isinstance(schema, list):
        return [schema], False
    rest = [s for s in schema if s != "null"]
    return rest, len(rest) < len(schema)


def spark_type(schema) -> DataType:
    """The Spark type of an Avro type."""
    rest, _ = _branches(schema)
    if isinstance(schema, list):
        return spark_type(rest[0]) if len(rest) == 1 else StringType()
    if isinstance(schema, str):
        return SIMPLE[schema]
    kind, logical = schema["type"], schema.get("logicalType")
    if isinstance(kind, (dict, list)):
        return spark_type(kind)
    if logical == "date":
        return DateType()
    if logical in ("timestamp-millis", "timestamp-micros"):
        return TimestampType()
    if logical in ("local-timestamp-millis", "local-timestamp-micros"):
        return TimestampNTZType()
    if logical == "decimal":
        return DecimalType(schema["precision"], schema.get("scale", 0))
    if kind == "record":
        return StructType([StructField(f["name"], spark_type(f["type"])) for f in schema["fields"]])
    if kind == "array":
        return ArrayType(spark_type(schema["items"]))
    if kind == "map":
        return MapType(StringType(), spark_type(schema["values"]))
    return {"enum": StringType(), "fixed": BinaryType()}.get(kind) or SIMPLE[kind]


def avro_type(kind: DataType, path: str = "row"):
    """The Avro type of a nullable Spark type."""
    if isinstance(kind, StructType):
        own = {"type": "record", "name": path, "fields": [
            {"name": f.name, "type": avro_type(f.dataType, f"{path}_{f.name}")} for f in kind]}
    elif isinstance(kind, ArrayType):
        own = {"type": "array", "items": avro_type(kind.elementType, f"{path}_item")}
    elif isinstance(kind, MapType):
        own = {"type": "map", "values": avro_type(kind.valueType, f"{path}_value")}
    elif isinstance(kind, DecimalType):
        own = {"type": "bytes", "logicalType": "decimal", "precision": kind.precision, "scale": kind.scale}
    elif isinstance(kind, DateType):
        own = {"type": "int", "logicalType": "date"}
    elif isinstance(kind, (TimestampType, TimestampNTZType)):
        own = {"type": "long", "logicalType": f"{'' if isinstance(kind, TimestampType) else 'local-'}timestamp-micros"}
    elif isinstance(kind, (ByteType, ShortType)):
        own = "int"
    else:
        own = next((name for name, simple in SIMPLE.items() if simple == kind), None)
        if own is None:
            raise ValueError(f"{path}: no Avro type for {kind.simpleString()}")
    return ["null", own]


class Cursor:
    """Bytes of a block and a place in them."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("the block ends inside a value")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        """A variable-length number, signs interleaved."""
        data, at = self.data, self.at
        try:
            byte = data[at]
            found, shift = byte & 0x7F, 7
            while byte >= 0x80:
                if shift > 63:
                    raise ValueError("a number is too long")
                at += 1
                byte = data[at]
                found |= (byte & 0x7F) << shift
                shift += 7
        except IndexError:
            raise ValueError("the block ends inside a value") from None
        self.at = at + 1
        return (found >> 1) ^ -(found & 1)

    def double(self) -> float:
        at = self.at
        if at + 8 > len(self.data):
            raise ValueError("the block ends inside a value")
        self.at = at + 8
        return DOUBLE(self.data, at)[0]

    def text(self) -> str:
        n = self.number()
        start, end = self.at, self.at + n
        if n < 0 or end > len(self.data):
            raise ValueError("the block ends inside a value")
        self.at = end
        return self.data[start:end].decode()


Decoder = Callable[[Cursor], object]


def _items(cursor: Cursor, one: Callable[[], object]) -> list:
    found = []
    while count := cursor.number():
        if count < 0:  # followed by the bytes of the part
            count = -count
            cursor.number()
        if count > len(cursor.data) - cursor.at + 1_000_000:
            raise ValueError("more items than bytes")
        found += [one() for _ in range(count)]
    return found


def _moment(micros: int, aware: bool) -> datetime.datetime:
    found = EPOCH + datetime.timedelta(microseconds=micros)
    return found if aware else found.replace(tzinfo=None)


def decoder(schema) -> Decoder:
    """A function that reads one value."""
    if isinstance(schema, list):
        parts = [None if s == "null" else decoder(s) for s in schema]
        several = sum(p is not None for p in parts) > 1

        def union(cursor: Cursor):
            part = parts[cursor.number()]
            value = None if part is None else part(cursor)
            return json.dumps(value, default=str, ensure_ascii=False) if several and part is not None else value
        if len(parts) != 2 or several:
            return union
        own = parts[0] or parts[1]
        null, some = (2, 0) if parts[0] else (0, 2)  # the branch's number as it is written

        def nullable(cursor: Cursor):
            byte = cursor.data[cursor.at] if cursor.at < len(cursor.data) else -1
            if byte == some and own:
                cursor.at += 1
                return own(cursor)
            if byte == null:
                cursor.at += 1
                return None
            return union(cursor)
        return nullable
    kind, logical = (schema, None) if isinstance(schema, str) else (schema["type"], schema.get("logicalType"))
    if isinstance(kind, (dict, list)):
        return decoder(kind)
    if kind == "record":
        parts = [(f["name"], decoder(f["type"])) for f in schema["fields"]]
        return lambda c: {name: part(c) for name, part in parts}
    if kind == "array":
        item = decoder(schema["items"])
        return lambda c: _items(c, lambda: item(c))
    if kind == "map":
        value = decoder(schema["values"])
        return lambda c: _items(c, lambda: (c.take(c.number()).decode(), value(c)))
    if kind == "enum":
        symbols = schema["symbols"]
        return lambda c: symbols[c.number()]
    if kind in ("bytes", "fixed"):
        raw = (lambda c: c.take(c.number())) if kind == "bytes" else (lambda c: c.take(schema["size"]))
        if logical == "decimal":
            scale = -schema.get("scale", 0)
            return lambda c: decimal.Decimal(int.from_bytes(raw(c), "big", signed=True)).scaleb(scale)
        return raw
    if logical == "date":
        return lambda c: DAY + datetime.timedelta(days=c.number())
    if logical and "timestamp" in logical:
        factor = 1000 if logical.endswith("millis") else 1
        return lambda c: _moment(c.number() * factor, not logical.startswith("local"))
    return {
        "boolean": lambda c: c.take(1) == b"\x01", "int": Cursor.number, "long": Cursor.number,
        "float": lambda c: struct.unpack("<f", c.take(4))[0], "double": Cursor.double,
        "string": Cursor.text,
    }[kind]


def _number(value: int) -> bytes:
    value = (value << 1) ^ (value >> 63)
    if 0 <= value < 0x80:
        return ONE_BYTE[value]
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def _sized(data: bytes) -> bytes:
    return _number(len(data)) + data


def encoder(kind: DataType) -> Callable[[object], bytes]:
    """A function that writes one nullable value."""
    if isinstance(kind, StructType):
        parts = [encoder(f.dataType) for f in kind]
        own = lambda row: b"".join(part(v) for part, v in zip(parts, row))
    elif isinstance(kind, ArrayType):
        item = encoder(kind.elementType)
        own = lambda values: (_number(len(values)) + b"".join(map(item, values)) if values else b"") + b"\0"
    elif isinstance(kind, MapType):
        value = encoder(kind.valueType)
        own = lambda m: (_number(len(m)) + b"".join(_sized(k.encode()) + value(v) for k, v in m.items()) if m else b"") + b"\0"
    elif isinstance(kind, DecimalType):
        def own(v):
            whole = int(v.scaleb(kind.scale))
            return _sized(whole.to_bytes(whole.bit_length() // 8 + 1, "big", signed=True))
    elif isinstance(kind, DateType):
        own = lambda v: _number((v - DAY).days)
    elif isinstance(kind, TimestampType):
        own = lambda v: _number((v.astimezone(datetime.timezone.utc) - EPOCH) // datetime.timedelta(microseconds=1))
    elif isinstance(kind, TimestampNTZType):
        own = lambda v: _number((v - EPOCH.replace(tzinfo=None)) // datetime.timedelta(microseconds=1))
    else:
        own = {
            BooleanType: lambda v: b"\x01" if v else b"\0", FloatType: lambda v: struct.pack("<f", v),
            DoubleType: lambda v: struct.pack("<d", v), BinaryType: lambda v: _sized(bytes(v)),
            StringType: lambda v: _sized(v.encode()),
        }.get(type(kind), _number)
    return lambda v: b"\0" if v is None else b"\x02" + own(v)


def _decompress(codec: str, data: bytes) -> bytes:
    if codec == "null":
        return data
    if codec == "deflate":
        return zlib.decompress(data, -15)
    if codec == "zstandard":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise ValueError(f"codec {codec!r} is not supported")


# --- reading -----------------------------------------------------------------

@dataclass
class Header:
    schema: dict
    codec: str
    marker: bytes
    end: int


def open_path(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + unquote(path[5:]).lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), os.path.abspath(path))


def _varint(stream) -> int:
    data = bytearray()
    while True:
        byte = stream.read(1)
        if not byte or len(data) > 9:
            raise ValueError("the file ends inside a block")
        data += byte
        if byte[0] < 0x80:
            return Cursor(bytes(data)).number()


def read_header(stream) -> Header:
    if stream.read(4) != MAGIC:
        raise ValueError("not an Avro file")
    entries = {}
    while count := _varint(stream):
        if count < 0:
            count = -count
            _varint(stream)
        for _ in range(count):
            key = stream.read(_varint(stream)).decode()
            entries[key] = stream.read(_varint(stream))
    marker = stream.read(MARKER)
    return Header(json.loads(entries["avro.schema"]), entries.get("avro.codec", b"null").decode(), marker, stream.tell())


def _next_marker(stream, marker: bytes, start: int, end: int) -> int | None:
    """The first place from ``start`` on, before ``end``, where the marker begins."""
    stream.seek(start)
    kept, at = b"", start
    while at - len(kept) < end:
        part = stream.read(SEARCH_BYTES)
        if not part:
            return None
        window = kept + part
        found = window.find(marker)
        if found >= 0:
            place = at - len(kept) + found
            return place if place < end else None
        kept = window[-(MARKER - 1):]
        at += len(part)
    return None


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


def blocks(stream, header: Header, start: int, end: int) -> Iterator[tuple[int, list[dict] | str]]:
    """(place, records, or why they cannot be read) of the blocks whose preceding marker begins in [start, end)."""
    read, size = decoder(header.schema), stream.size()
    place = _next_marker(stream, header.marker, start, end)
    while place is not None and place < end and place + MARKER < size:
        stream.seek(place + MARKER)
        try:
            count, length = _varint(stream), _varint(stream)
            if count < 0 or length < 0 or stream.tell() + length + MARKER > size:
                raise ValueError("the block says a size it cannot have")
            data = stream.read(length)
            following = stream.tell()
            if stream.read(MARKER) != header.marker:
                raise ValueError("no marker at the end of the block")
            cursor = Cursor(_decompress(header.codec, data))
            records = [read(cursor) for _ in range(count)]
            if cursor.at != len(cursor.data):
                raise ValueError("bytes are left over in the block")
            yield place + MARKER, records
            place = following
        except Exception as error:  # whatever a damaged block leads to
            yield place + MARKER, f"{type(error).__name__}: {error}"
            place = _next_marker(stream, header.marker, place + MARKER, size)


class AvroReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[Split]:
        return [Split(path, start, min(start + self.split, size))
                for path, size in list_files(self.path) for start in range(0, max(size, 1), self.split)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        shape = to_arrow_schema(self.schema)
        columns = [f.name for f in self.schema]

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], type=shape.field(c).type) for c in columns], schema=shape)

        def rescued(place: int, why: str) -> pa.RecordBatch:
            return batch([{RESCUED: json.dumps({"_error": why, "_offset": place, "_file_path": partition.path})}])

        system, path = open_path(partition.path)
        with system.open_input_file(path) as stream:
            try:
                header = read_header(stream)
            except Exception as error:  # a file without a readable header is one row, from its first split
                if partition.start == 0:
                    yield rescued(0, f"{type(error).__name__}: {error}")
                return
            for place, found in blocks(stream, header, partition.start, partition.end):
                if isinstance(found, str):
                    yield rescued(place, found)
                elif found:
                    yield batch(found)


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file or of all Avro files below a folder, hidden ones left out."""
    system, bare = open_path(path)
    info = system.get_file_info(bare)
    if info.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pyarrow.fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(pyarrow.fs.FileSelector(bare, recursive=True))
    prefix = path.split("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
    hidden = lambda p: any(part[:1] in "._" for part in p[len(bare):].strip("/").split("/"))
    return sorted((prefix + f.path, f.size) for f in found if f.type == pyarrow.fs.FileType.File and not hidden(f.path))


# --- writing -----------------------------------------------------------------

@dataclass
class Written(WriterCommitMessage):
    path: str | None


class AvroWriter(DataSourceWriter):
    """A file per task, under a hidden name until the job commits."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.schema, self.path, self.codec = schema, options["path"], options.get("codec", "deflate")
        if self.codec not in ("null", "deflate"):
            raise ValueError(f"cannot write codec {self.codec!r}")
        self.before = [p for p, _ in list_files(self.path)] if overwrite and _exists(self.path) else []

    def write(self, iterator) -> Written:
        row, kind = encoder(self.schema), avro_type(self.schema)[1]
        marker, system, folder = uuid.uuid4().bytes, *open_path(self.path)
        system.create_dir(folder, recursive=True)
        name = f"{folder}/_{uuid.uuid4().hex}.avro"
        codec, count, data = self.codec, 0, io.BytesIO()
        with system.open_output_stream(name) as out:
            meta = {"avro.schema": json.dumps(kind).encode(), "avro.codec": codec.encode()}
            out.write(MAGIC + _number(len(meta)) + b"".join(_sized(k.encode()) + _sized(v) for k, v in meta.items()) + b"\0" + marker)

            def flush():
                body = data.getvalue()
                if codec == "deflate":
                    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
                    body = packer.compress(body) + packer.flush()
                out.write(_number(count) + _sized(body) + marker)
                data.seek(0), data.truncate()

            for values in iterator:
                data.write(row(values)[1:])  # a row itself is never null
                count += 1
                if data.tell() >= BLOCK_BYTES:
                    flush()
                    count = 0
            if count:
                flush()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = open_path(self.path)
        for path in self.before:
            system.delete_file(open_path(path)[1])
        for message in filter(None, messages):
            system.move(message.path, f"{folder}/part-{os.path.basename(message.path)[1:]}")

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = open_path(self.path)
        for message in filter(None, messages):
            system.delete_file(message.path)


def _exists(path: str) -> bool:
    system, bare = open_path(path)
    return system.get_file_info(bare).type != pyarrow.fs.FileType.NotFound


class AvroSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        """The columns of the first file that has a header, and the rescue column."""
        for path, _ in list_files(self.options["path"]):
            system, bare = open_path(path)
            with system.open_input_file(bare) as stream:
                try:
                    found = spark_type(read_header(stream).schema)
                except ValueError:
                    continue
                return StructType([*found.fields, StructField(RESCUED, StringType())])
        raise ValueError(f"no Avro file in {self.options['path']}")

    def reader(self, schema: StructType) -> AvroReader:
        return AvroReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> AvroWriter:
        return AvroWriter(schema, self.options, overwrite)


def register_avro(spark: SparkSession) -> str:
    """Make the source known to the session; its name."""
    spark.dataSource.register(AvroSource)
    return NAME
