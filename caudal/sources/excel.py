"""Workbooks (xlsx), read through the Python data source API: a task per file, every value as text, columns by name.

The first row of a sheet that is not empty names its columns. Values of columns that are not asked for go to ``_rescued_data`` as
JSON, as does the reason why a file cannot be read. Numbers keep the digits they are stored with, whole ones without a point;
cells with a date format become ISO dates and times. Rows are parsed one after the other; only a workbook's shared texts are held.
"""

from __future__ import annotations

import datetime
import json
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from caudal.sources.avro import RESCUED, list_files, open_path

NAME = "xlsx_sheets"
BATCH_ROWS = 2000
# fixed values: the namespaces and built-in date formats of the file format
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
EPOCHS = {False: datetime.datetime(1899, 12, 30), True: datetime.datetime(1904, 1, 1)}


class Workbook:
    def __init__(self, stream):
        self.files = zipfile.ZipFile(stream)
        book = self._xml("xl/workbook.xml")
        self.sheets = [(s.get("name"), s.get(RELATION)) for s in book.iter(f"{MAIN}sheet")]
        settings = book.find(f"{MAIN}workbookPr")
        self.epoch = EPOCHS[settings is not None and settings.get("date1904") in ("1", "true")]
        self.parts = {r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels")}
        names = set(self.files.namelist())
        self.texts = [self._text(item) for item in self._xml("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        self.dates = self._date_styles() if "xl/styles.xml" in names else []

    def _xml(self, name: str) -> ElementTree.Element:
        with self.files.open(name) as part:
            return ElementTree.parse(part).getroot()

    @staticmethod
    def _text(item: ElementTree.Element) -> str:
        """The text of an item without its phonetic hints."""
        runs = [item, *item.findall(f"{MAIN}r")]
        return "".join(t.text or "" for run in runs for t in run.findall(f"{MAIN}t"))

    def _date_styles(self) -> list[bool]:
        """Whether each cell style shows dates."""
        styles = self._xml("xl/styles.xml")
        bare = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode")) for f in styles.iter(f"{MAIN}numFmt")}
        dates = DATE_FORMATS | {i for i, code in bare.items() if re.search("[ymdhs]", code.lower()) and code.lower() != "general"}
        cells = styles.find(f"{MAIN}cellXfs")
        return [int(x.get("numFmtId", 0)) in dates for x in cells] if cells is not None else []

    def _value(self, cell: ElementTree.Element) -> str | None:
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            return self._text(cell.find(f"{MAIN}is"))
        value = cell.findtext(f"{MAIN}v")
        if value is None or kind in ("str", "e"):
            return value
        if kind == "s":
            return self.texts[int(value)]
        if kind == "b":
            return "true" if value == "1" else "false"
        style = int(cell.get("s", 0))
        if kind == "n" and style < len(self.dates) and self.dates[style]:
            moment = self.epoch + datetime.timedelta(microseconds=round(float(value) * 86_400_000_000))
            return moment.date().isoformat() if float(value).is_integer() else moment.isoformat(" ")
        return value[:-2] if value.endswith(".0") else value

    def rows(self, sheet: str | None) -> Iterator[list[str | None]]:
        """The rows of a sheet, by name or from 1, that hold a value; the first sheet without ``sheet``."""
        at = 0 if sheet is None else int(sheet) - 1 if sheet.isdigit() else [n for n, _ in self.sheets].index(sheet)
        target = self.parts[self.sheets[at][1]]
        with self.files.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as part:
            for _, element in ElementTree.iterparse(part):
                if element.tag != f"{MAIN}row":
                    continue
                found: list[str | None] = []
                for cell in element:
                    letters = re.match("[A-Z]*", cell.get("r", "")).group()
                    place = len(found)
                    if letters:
                        place = 0
                        for letter in letters:
                            place = place * 26 + ord(letter) - 64
                        place -= 1
                    found += [None] * (place - len(found)) + [self._value(cell)]
                element.clear()
                if any(v not in (None, "") for v in found):
                    yield found


def named(header: list[str | None]) -> list[str]:
    """Names of a header's columns; empty and repeated ones have their position."""
    plain = [(h or "").strip() for h in header]
    return [n if n and n not in plain[:i] else f"{n}#{i + 1}" for i, n in enumerate(plain)]


@dataclass
class File(InputPartition):
    path: str


class ExcelReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.options = [f.name for f in schema], dict(options)

    def partitions(self) -> list[File]:
        return [File(path) for path, _ in list_files(self.options["path"])]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([(c, pa.string()) for c in self.columns])

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], pa.string()) for c in self.columns], schema=shape)

        system, path = open_path(partition.path)
        waiting: list[dict] = []
        try:
            with system.open_input_file(path) as stream:
                rows = Workbook(stream).rows(self.options.get("sheet"))
                names = named(next(rows, []))
                for row in rows:
                    wide = [*names, *(f"#{i + 1}" for i in range(len(names), len(row)))]
                    value = dict(zip(wide, row))
                    extra = {n: v for n, v in value.items() if n not in self.columns and v is not None}
                    kept = {n: v for n, v in value.items() if n in self.columns}
                    if extra:
                        kept[RESCUED] = json.dumps({**extra, "_file_path": partition.path}, ensure_ascii=False)
                    waiting.append(kept)
                    if len(waiting) == BATCH_ROWS:
                        yield batch(waiting)
                        waiting = []
        except Exception as error:  # whatever a damaged file leads to
            waiting.append({RESCUED: json.dumps({"_error": f"{type(error).__name__}: {error}", "_file_path": partition.path})})
        if waiting:
            yield batch(waiting)


class ExcelSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        """The columns of the first file that can be read, and the rescue column."""
        for path, _ in list_files(self.options["path"]):
            system, bare = open_path(path)
            with system.open_input_file(bare) as stream:
                try:
                    names = named(next(Workbook(stream).rows(self.options.get("sheet")), []))
                except Exception:  # noqa: S112  the next file may do; reading names the reason
                    continue
                return StructType([StructField(n, StringType()) for n in [*names, RESCUED]])
        raise ValueError(f"no workbook that can be read in {self.options['path']}")

    def reader(self, schema: StructType) -> ExcelReader:
        if any(not isinstance(f.dataType, StringType) for f in schema):
            raise ValueError("cells are read as text; cast them afterwards")
        return ExcelReader(schema, self.options)


def register_excel(spark: SparkSession) -> str:
    """Make the source known to the session; its name."""
    spark.dataSource.register(ExcelSource)
    return NAME
