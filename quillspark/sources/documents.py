"""Binary documents as text: listing, ZIP-based word-processor files, workbooks and plain text in unknown encodings.

Files are read by Spark's binary reader; the standard library opens each one inside
the tasks, so no document passes the driver.
"""

from __future__ import annotations

import io
import re
import unicodedata
import xml.etree.ElementTree as ElementTree
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from quillspark.functions.scalars import clean_text, normal_name
from quillspark.functions.text import consecutive_distinct, html_to_text, text_lines
from quillspark.sources.hwp import hwp_text

EXTENSIONS = ("hwp", "hwpx", "docx", "txt", "html", "xhtml")


def listing(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path, modificationTime, length, content of every file below the folder with one of the extensions."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{','.join(extensions)}}}").load(folder)


def _plain(xml: str) -> str:
    """Character data of a fragment."""
    text = re.sub(r"<[^>]+>", "", xml)
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = text.replace(name, char)
    return text


def hwpx_text(data: bytes) -> str:
    """Sections in order of name; a run of text is a line."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted(n for n in z.namelist() if re.fullmatch(r"Contents/section[0-9]+\.xml", n))
        parts = [z.read(n).decode("utf-8", "replace") for n in names]
    return "\n".join(_plain(t) for part in parts for t in re.findall(r"<hp:t(?:\s[^>]*)?>(.*?)</hp:t>", part, re.S))


def docx_text(data: bytes) -> str:
    """The body; a paragraph is a line."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return _plain(z.read("word/document.xml").decode("utf-8", "replace").replace("</w:p>", "\n"))


def decoded(data: bytes) -> str:
    """UTF-8, else cp949, else UTF-16, else nothing."""
    for encoding in ("utf-8", "cp949", "utf-16"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return ""


_READERS = {"hwp": hwp_text, "hwpx": hwpx_text, "docx": docx_text}


@pandas_udf(StringType())
def _extracted(kind: pd.Series, content: pd.Series) -> pd.Series:
    def one(k: str, data: bytes) -> str:
        try:
            return _READERS.get(k, decoded)(data)
        except (zipfile.BadZipFile, KeyError, ValueError):
            return ""

    return pd.Series([one(k, d) if d is not None else "" for k, d in zip(kind, content)])


def extract(files: DataFrame) -> DataFrame:
    """path and text of listed files, by extension; unreadable files give empty text.

    Web pages run through the column functions of `html_to_text` after decoding; every
    text ends in `clean_text`.
    """
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    raw = files.select("path", kind.alias("kind"), _extracted(kind, F.col("content")).alias("raw"))
    page = F.array_join(consecutive_distinct(text_lines(html_to_text(F.col("raw")))), "\n")
    return raw.select("path", clean_text(F.when(F.col("kind").isin("html", "xhtml"), page).otherwise(F.col("raw"))).alias("text"))


@pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFC", x) if x is not None else None)


def nfc(c: Column) -> Column:
    """Canonical composition, which Spark has no function for."""
    return _nfc(c)


def composed_name(c: Column) -> Column:
    """A person's name composed, without invisible characters and blanks, cut by `normal_name`."""
    return normal_name(nfc(c), zero_width=True, inner_spaces=True)


#: Characters of cells that a task gathers before it hands them on.
MOST_CHARS = 1 << 22
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _place(reference: str) -> int:
    """Zero-based column of a cell reference."""
    at = 0
    for c in reference:
        if not c.isalpha():
            break
        at = at * 26 + ord(c.upper()) - 64
    return at - 1


def _sheet_rows(data: bytes, sheet: int) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, values as text) of one worksheet, streamed."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{_SHEET}t")))
        with z.open(f"xl/worksheets/sheet{sheet}.xml") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_SHEET}row":
                    continue
                values: list[str | None] = []
                for cell in row.iter(f"{_SHEET}c"):
                    at = _place(cell.get("r", "")) if cell.get("r") else len(values)
                    values += [None] * (at + 1 - len(values))
                    value = cell.find(f"{_SHEET}v")
                    if cell.get("t") == "s" and value is not None:
                        values[at] = shared[int(value.text)]
                    elif cell.get("t") == "inlineStr":
                        values[at] = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
                    elif value is not None:
                        values[at] = value.text
                yield int(row.get("r") or 0), values
                row.clear()


def workbook_rows(files: DataFrame, sheet: int = 1, batch: int = 5000) -> DataFrame:
    """path, row, cells of one worksheet of listed workbooks (values only); broken workbooks give no rows."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for path, data in zip(b.column(0), b.column(1)):
                try:
                    for number, cells in _sheet_rows(data.as_py(), sheet):
                        yield path.as_py(), number, cells
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    pass

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Small workbooks share a batch; large rows end one.
        rows: list[tuple] = []
        size = 0
        for row in found(batches):
            rows.append(row)
            size += sum(len(x) for x in row[2] if x)
            if len(rows) >= batch or size >= MOST_CHARS:
                yield _rows(rows)
                rows, size = [], 0
        yield _rows(rows)

    return files.select("path", "content").mapInArrow(run, "path string, row int, cells array<string>")


def _rows(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.string()))], ["path", "row", "cells"]
    )


def fixed_columns(rows: DataFrame, columns: dict[str, int], first: int = 1, last: int | None = None) -> DataFrame:
    """Named cells (1-based columns) of the rows in [first, last]; cells that a short row lacks are null."""
    inside = rows.filter((F.col("row") >= first) & (F.lit(True) if last is None else F.col("row") <= last))
    return inside.select("row", *[F.get("cells", F.lit(at - 1)).alias(name) for name, at in columns.items()])
