"""Workbooks (xlsx) without a library: one sheet of rows, written from small results, or as several by tasks, and read by tasks.

A workbook is a zip of XML parts; only what a plain sheet needs is written, and shared and inline texts, numbers and
booleans are read. Dates are kept as ISO texts.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .writers import csv_ready, write_parts

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: A sheet holds no more rows than this (a limit of the format).
MOST_ROWS = 1_048_575
#: A workbook of several is full at so many characters of its sheet, so that a task can hold it.
SHEET_CHARS = 64_000_000


def _letters(n: int) -> str:
    return (_letters(n // 26 - 1) if n >= 26 else "") + chr(65 + n % 26)


def _cell(place: str, value) -> str:
    if value is None or value != value:
        return ""
    if isinstance(value, bool):
        return f'<c r="{place}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{place}"><v>{value!r}</v></c>'
    text = "".join(ch for ch in str(value) if ch >= " " or ch in "\t\n\r")
    return f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


class Sheet:
    """A workbook of one sheet with a head line that takes row after row, so only its packed bytes are held."""

    def __init__(self, columns: list[str]) -> None:
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = {
            "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
            "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        }
        self.out, self.rows, self.chars = io.BytesIO(), -1, 0
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_DEFLATED)
        for name, text in parts.items():
            self.zip.writestr(name, text)
        self.sheet = self.zip.open("xl/worksheets/sheet1.xml", "w")
        self.sheet.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>'.encode())
        self.add(tuple(columns))

    def add(self, row: tuple) -> None:
        self.rows += 1
        n = self.rows + 1
        text = f'<row r="{n}">' + "".join(_cell(f"{_letters(k)}{n}", v) for k, v in enumerate(row)) + "</row>"
        self.chars += len(text)
        self.sheet.write(text.encode())

    def close(self, comment: bytes = b"") -> bytes:
        """The workbook's bytes; ``comment`` is its archive's comment, which ends them."""
        self.sheet.write(b"</sheetData></worksheet>")
        self.sheet.close()
        self.zip.comment = comment
        self.zip.close()
        return self.out.getvalue()


def to_bytes(columns: list[str], rows: Iterable[tuple]) -> bytes:
    """A workbook of one sheet with a head line."""
    sheet = Sheet(columns)
    for row in rows:
        sheet.add(row)
    return sheet.close()


def rows_of(content: bytes) -> Iterator[list[str | None]]:
    """The rows of a workbook's first sheet as texts; cells that are left out are None."""
    ns = {"m": _MAIN}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_MAIN}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        first = sorted(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))[0]
        for _, row in ElementTree.iterparse(z.open(first)):
            if row.tag != f"{{{_MAIN}}}row":
                continue
            cells: list[str | None] = []
            for c in row.findall("m:c", ns):
                place = "".join(ch for ch in c.get("r", "") if ch.isalpha())
                at = 0
                for ch in place:
                    at = at * 26 + ord(ch) - 64
                cells += [None] * (max(at, len(cells) + 1) - len(cells) - 1)
                kind, value = c.get("t"), c.findtext("m:v", None, ns)
                if kind == "inlineStr":
                    cells.append("".join(t.text or "" for t in c.iter(f"{{{_MAIN}}}t")))
                elif kind == "s" and value is not None:
                    cells.append(shared[int(value)])
                elif kind == "b":
                    cells.append("true" if value == "1" else "false")
                else:
                    cells.append(value)
            row.clear()
            yield cells


def _plain(df: DataFrame) -> DataFrame:
    """Arrays, times and whatever else no cell holds as text."""
    plain = csv_ready(df)
    return plain.withColumns({f.name: F.col(f.name).cast("string") for f in plain.schema if not isinstance(f.dataType, (T.StringType, T.BooleanType, T.NumericType)) or isinstance(f.dataType, T.DecimalType)})


def write(df: DataFrame, path: str, most: int = 100_000) -> int:
    """A small result as a workbook; more than ``most`` rows raise. Arrays and times are written as text."""
    plain = _plain(df)
    rows = [tuple(r) for r in plain.limit(min(most, MOST_ROWS) + 1).collect()]
    if len(rows) > min(most, MOST_ROWS):
        raise ValueError(f"more than {min(most, MOST_ROWS)} rows: write CSV")
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(to_bytes(plain.columns, rows)))
    out.close()
    return len(rows)


def write_all(df: DataFrame, folder: str, name: str, most: int = 100_000, chars: int = SHEET_CHARS) -> int:
    """A result of any size as workbooks of at most ``most`` rows and about ``chars`` characters each; their number.

    Each partition writes its own, in its order, and no row goes to the driver. One workbook is named ``name.xlsx``,
    several ``name-00001.xlsx`` and so on; those of an earlier run are replaced. Without rows there is a head line.
    """
    plain = _plain(df)
    columns, most = plain.columns, min(most, MOST_ROWS)

    def books(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def full(sheet: Sheet) -> pa.RecordBatch:  # the line's end that the text writer adds is the archive's comment
            return pa.RecordBatch.from_arrays([pa.array([sheet.close(b"\n")[:-1]], pa.binary())], names=["content"])

        sheet = None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if sheet and (sheet.rows >= most or sheet.chars >= chars):
                    yield full(sheet)
                    sheet = None
                sheet = sheet or Sheet(columns)
                sheet.add(row)
        if sheet:
            yield full(sheet)

    made = plain.mapInArrow(books, "content binary").select(F.col("content").cast("string").alias("value"))
    count = write_parts(made, folder, name, "xlsx", "text", lineSep="\n", maxRecordsPerFile=1)
    if not count:  # in place of the empty file
        write(df.limit(0), f"{folder.rstrip('/')}/{name}.xlsx", most)
    return max(count, 1)


def read(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The rows of the first sheets of workbooks, columns found by their head line; one task per file.

    Values that don't fit their type, and columns that a sheet lacks, are null; files that are no workbook give no rows.
    """
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    names = [f.name for f in kind]
    texts = T.StructType([T.StructField(n, T.StringType()) for n in names])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                try:
                    rows = list(rows_of(content))
                except (zipfile.BadZipFile, KeyError, IndexError, ElementTree.ParseError):
                    continue
                if rows:
                    at = {n: k for k, n in enumerate(rows[0]) if n is not None}
                    for k in range(1, len(rows), 10_000):
                        yield pd.DataFrame([[r[at[n]] if n in at and at[n] < len(r) else None for n in names] for r in rows[k : k + 10_000]], columns=names, dtype=object)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(parse, texts).select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in kind])
