"""Excel product lists: many ``.xlsx`` files read in parallel, one per row.

Spark has no workbook source. ``binaryFile`` lists and distributes the files;
inside a task each workbook (a zip of XML parts) becomes text rows.

A sheet is parsed as a stream: a row's nodes are freed once it is read, rows leave in batches, and shared
texts beyond a few megabytes lie in a scratch file of the task, which goes with it. Besides the file
itself a task so holds one batch, whatever the length of the sheet.
"""

from __future__ import annotations

import io
import re
import tempfile
import zipfile
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from typing import IO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tallyhouse.sources.schemas import INTAKE_COLUMNS, INTAKE_REQUIRED

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

WORKBOOK_SCHEMA = (
    "path string, line int, " + ", ".join(f"{c} string" for c in INTAKE_COLUMNS) + ", error string"
)

BATCH_ROWS = 10_000
#: Shared texts of a book that stay in memory; more go to a file.
SPOOLED_BYTES = 8 << 20
CACHED_TEXTS = 4096


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _column_index(ref: str) -> int:
    index = 0
    for letter in re.match(r"[A-Z]+", ref).group():
        index = index * 26 + ord(letter) - ord("A") + 1
    return index - 1


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f".//{_MAIN}sheet")
    for rel in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if rel.get("Id") == sheet.get(f"{_REL}id"):
            target = rel.get("Target")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError("workbook without sheet")


def _elements(part: IO[bytes], tag: str) -> Iterator[ElementTree.Element]:
    """The part's elements of one name; whatever has been read is freed."""
    above: list[ElementTree.Element] = []
    wanted = 0
    for event, node in ElementTree.iterparse(part, ("start", "end")):
        if event == "start":
            above.append(node)
            wanted += node.tag == tag
            continue
        above.pop()
        if node.tag == tag:
            yield node
            wanted -= 1
        if above and not wanted:
            above[-1].remove(node)


class SharedTexts:
    """The book's shared texts by number, in memory while they are few."""

    def __init__(self, book: zipfile.ZipFile) -> None:
        self.file = tempfile.SpooledTemporaryFile(max_size=SPOOLED_BYTES)
        self.ends = array("Q", [0])
        self.text = lru_cache(CACHED_TEXTS)(self._read)
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as part:
                for node in _elements(part, f"{_MAIN}si"):
                    self.ends.append(self.ends[-1] + self.file.write(_text(node).encode()))

    def _read(self, number: int) -> str:
        if not 0 <= number < len(self.ends) - 1:
            raise ValueError(f"no shared text {number}")
        start, end = self.ends[number : number + 2]
        self.file.seek(start)
        return self.file.read(end - start).decode()


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Cells of the first sheet as text, row by row."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = SharedTexts(book)
        with shared.file, book.open(_first_sheet(book)) as sheet:
            for node in _elements(sheet, f"{_MAIN}row"):
                row: list[str | None] = []
                for cell in node.iter(f"{_MAIN}c"):
                    at = _column_index(cell.get("r")) if cell.get("r") else len(row)
                    row.extend([None] * (at + 1 - len(row)))
                    value = cell.findtext(f"{_MAIN}v")
                    if cell.get("t") == "s":
                        row[at] = shared.text(int(value))
                    elif cell.get("t") == "inlineStr":
                        row[at] = _text(cell)
                    else:
                        row[at] = value
                yield row


def _intake_rows(path: str, content: bytes) -> Iterator[tuple]:
    rows = sheet_rows(content)
    header = [(h or "").lower().strip() for h in next(rows, [])]
    missing = [c for c in INTAKE_REQUIRED if c not in header]
    if missing:
        raise ValueError(f"Missing columns: {', '.join(missing)}. Found: {header}")
    for line, row in enumerate(rows):
        if any(v is not None for v in row):
            cells = dict(zip(header, row, strict=False))
            yield (path, line, *[cells.get(c) for c in INTAKE_COLUMNS], None)


def _intake_frames(path: str, content: bytes) -> Iterator[pd.DataFrame]:
    """A book's rows in batches, or its error alone: it is read through once before its first row goes out."""
    columns = ["path", "line", *INTAKE_COLUMNS, "error"]
    try:
        for _ in _intake_rows(path, content):
            pass
        out: Iterator[tuple] = _intake_rows(path, content)
    except Exception as problem:  # whatever a broken or encrypted book makes the parsers raise
        out = iter([(path, None, *[None] * len(INTAKE_COLUMNS), str(problem) or type(problem).__name__)])
    while some := list(islice(out, BATCH_ROWS)):
        yield pd.DataFrame(some, columns=columns).astype({"line": "Int32"})


def parse_workbooks(files: DataFrame) -> DataFrame:
    """``path, content`` -> intake rows as text. A workbook that cannot be read
    gives one row with ``error`` set, so nothing is lost silently."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield from _intake_frames(path, content)

    return files.select("path", "content").mapInPandas(parse, WORKBOOK_SCHEMA)


def read_stock_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Every ``*.xlsx`` (any case) under a file, folder or glob."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sS][xX]").load(path)
    )
    return parse_workbooks(files)
