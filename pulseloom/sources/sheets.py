"""Spreadsheets as tables: the cells of .xlsx files from their own XML, and typed person tables below a header.

Two ways to the same rows: a data source named "sheet" for Spark's reader, with one partition a file of a folder that all
executors see, and sheet_rows() over whatever store Spark reads as binary files. A file that cannot be read, has no
sheet or no header gives one row with a fault, so that it hides no other.
"""

from __future__ import annotations

import glob
import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, row_number int, cells map<string,string>, fault string"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_WITHIN = 20


def column_of(reference: str) -> int:
    """The number, from 0, of the column of a cell such as AB12."""
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    with book.open("xl/sharedStrings.xml") as f:
        return ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.parse(f).getroot().iter(f"{_MAIN}si")]


def _sheet_path(book: zipfile.ZipFile, name: str | None) -> str:
    with book.open("xl/workbook.xml") as f:
        sheets = [(s.get("name"), s.get(f"{_REL}id")) for s in ElementTree.parse(f).getroot().iter(f"{_MAIN}sheet")]
    with book.open("xl/_rels/workbook.xml.rels") as f:
        target = {r.get("Id"): r.get("Target") for r in ElementTree.parse(f).getroot()}
    for own, at in sheets:
        if name in (None, own):
            path = target[at].lstrip("/")
            return path if path.startswith("xl/") else f"xl/{path}"
    raise ValueError(f"no sheet named {name}" if name else "no sheet")


def cells_of(content: bytes, sheet: str | None = None) -> Iterator[tuple[int, dict[int, str]]]:
    """(row number from 1, text of each column) of the rows of a sheet that have any; the first sheet, if none is named."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _shared(book)
        number = 0
        with book.open(_sheet_path(book, sheet)) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                number = int(row.get("r") or number + 1)
                out, at = {}, -1
                for c in row.iter(f"{_MAIN}c"):
                    at = column_of(c.get("r")) if c.get("r") else at + 1
                    value, kind = c.find(f"{_MAIN}v"), c.get("t")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    elif value is None or value.text is None:
                        continue
                    else:
                        text = shared[int(value.text)] if kind == "s" else value.text
                    if text.strip():
                        out[at] = text.strip()
                row.clear()
                if out:
                    yield number, out


def table_of(content: bytes, needed: list[str], within: int = _WITHIN, sheet: str | None = None) -> Iterator[tuple[int | None, dict[str, str] | None, str]]:
    """(row number, texts by column name, fault) below the first of the leading rows that has all needed names (any case)."""
    head: dict[int, str] = {}
    want = {n.lower() for n in needed}
    try:
        for number, row in cells_of(content, sheet):
            if head:
                yield number, {head[k]: v for k, v in row.items() if k in head}, ""
            elif number > within:
                break
            elif want <= {v.lower() for v in row.values()}:
                head = {k: v.lower() for k, v in row.items()}
        if not head:
            yield None, None, f"no header with {', '.join(needed)} in the first {within} rows"
    except (zipfile.BadZipFile, KeyError, ValueError, IndexError, ElementTree.ParseError) as e:
        yield None, None, f"cannot be read: {type(e).__name__}: {str(e)[:120]}"


class SheetSource(DataSource):
    """spark.read.format("sheet").option("needed", "id,age").load(pattern), once registered with spark.dataSource."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SheetReader:
        return SheetReader(self.options)


class SheetFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class SheetReader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path", "").removeprefix("file:")
        self.needed = [n.strip() for n in options.get("needed", "").split(",") if n.strip()]
        self.within, self.sheet = int(options.get("within", _WITHIN)), options.get("sheet")

    def partitions(self) -> list[SheetFile]:
        """One for each file that the path or pattern names, or that lies in its folder."""
        found = glob.glob(os.path.join(self.path, "*.xlsx") if os.path.isdir(self.path) else self.path)
        if not found:
            raise FileNotFoundError(f"no spreadsheet at {self.path}")
        return [SheetFile(p) for p in sorted(found)]

    def read(self, partition: SheetFile) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            content = f.read()
        for number, cells, fault in table_of(content, self.needed, self.within, self.sheet):
            yield partition.path, number, cells, fault


def sheet_rows(spark: SparkSession, path: str, needed: list[str], within: int = _WITHIN, sheet: str | None = None, pattern: str = "*.xlsx") -> DataFrame:
    """The same rows from any store: each file is read by Spark and taken apart where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("path", pa.string()), ("row_number", pa.int32()), ("cells", pa.map_(pa.string(), pa.string())), ("fault", pa.string())])
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(name, n, None if c is None else list(c.items()), f) for n, c, f in table_of(content, needed, within, sheet)]
                for i in range(0, len(rows), 10_000):
                    part = list(zip(*rows[i : i + 10_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(part, kind, strict=True)], schema=kind)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def typed(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """path, row_number, the columns (name: type) of rows, and their faults: texts that are no such value, or not finite."""
    text = {c: F.element_at("cells", c.lower()) for c in columns}
    cast = {c: text[c].try_cast(t) for c, t in columns.items()}
    odd = {c: text[c].isNotNull() & (cast[c].isNull() | (F.isnan(cast[c]) | (F.abs(cast[c]) == float("inf")) if t in ("double", "float") else F.lit(False))) for c, t in columns.items()}
    bad = F.array_compact(F.array(F.nullif(F.col("fault"), F.lit("")), *(F.when(odd[c], F.concat(F.lit(f"{c} is not {t}: "), text[c])) for c, t in columns.items())))
    return rows.select("path", "row_number", *(F.when(~odd[c], cast[c]).alias(c) for c in columns), F.array_join(bad, "; ").alias("fault"))
