"""Excel workbooks without a library: the zipped XML of a sheet, read as a stream in tasks, a workbook at a time.

Cells come as text: shared and inline strings, formulas' values, numbers as written, booleans as 1 and 0. The first row
names the columns; ``rename`` maps names, ``answers`` lists columns of yes and no (also true, false, 1, 0) that become booleans.

Cases: empty cells are null, a row without any value is left out, columns without a heading are left out, headings that
repeat have _2, _3 and so on; a workbook without the sheet, or a sheet without rows, gives no rows; workbooks lack columns
that others have: nulls; files that are no workbook raise.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Fixed values of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
PLACE = re.compile(r"([A-Z]+)\d*$")


def column_number(place: str) -> int:
    """'A1' is 0, 'AB7' is 27."""
    n = 0
    for c in PLACE.match(place)[1]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _text(node: ElementTree.Element) -> str:
    """A string's text: its runs together, without phonetic marks."""
    return "".join(t.text or "" for t in [*node.findall(f"{MAIN}t"), *node.findall(f"{MAIN}r/{MAIN}t")])


def _file_of(book: zipfile.ZipFile, sheet: str | int) -> str | None:
    """Path of a sheet in the archive, by name or place."""
    links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).findall(f"{MAIN}sheets/{MAIN}sheet")
    chosen = [x for k, x in enumerate(sheets) if sheet in (k, x.get("name"))]
    if not chosen:
        return None
    target = links[chosen[0].get(RELATION)]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def cells(data: bytes, sheet: str | int = 0) -> Iterator[dict[int, str]]:
    """Rows of a sheet as they stand in the file: text by column number."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        path = _file_of(book, sheet)
        if path is None:
            return
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as f:
                for _, node in ElementTree.iterparse(f):
                    if node.tag == f"{MAIN}si":
                        shared.append(_text(node))
                        node.clear()
        with book.open(path) as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag != f"{MAIN}row":
                    continue
                row: dict[int, str] = {}
                for k, cell in enumerate(node.findall(f"{MAIN}c")):
                    kind, value = cell.get("t", "n"), cell.findtext(f"{MAIN}v")
                    if kind == "inlineStr":
                        value = _text(cell.find(f"{MAIN}is"))
                    elif kind == "s" and value is not None:
                        value = shared[int(value)]
                    if value is not None and value != "" and kind != "e":
                        row[column_number(cell.get("r")) if cell.get("r") else k] = value
                node.clear()
                yield row


def headings(row: dict[int, str]) -> dict[int, str]:
    """Column names by number, trimmed and each once."""
    seen: dict[str, int] = {}
    out = {}
    for k, name in sorted(row.items()):
        name = name.strip()
        if name:
            seen[name] = seen.get(name, 0) + 1
            out[k] = name if seen[name] == 1 else f"{name}_{seen[name]}"
    return out


def answer(c: Column) -> Column:
    """Yes, true and 1 against no, false and 0, whatever their case; null for anything else."""
    t = F.lower(F.trim(c))
    return F.when(t.isin("yes", "true", "1", "1.0"), True).when(t.isin("no", "false", "0", "0.0"), False)


def read_sheets(spark: SparkSession, path: str, sheet: str | int = 0, rename: dict[str, str] | None = None, answers: Sequence[str] = ()) -> DataFrame:
    """Rows of a sheet of each workbook that a path names (glob or folder), columns as text but for ``answers`` (names after renaming)."""
    files = spark.read.format("binaryFile").load(path)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                found = headings(next(cells(data.as_py(), sheet), {}))
                yield pa.RecordBatch.from_pydict({"place": pa.array(found.keys(), pa.int32()), "name": pa.array(found.values(), pa.string())})

    found = files.select("content").mapInArrow(names, "place int, name string").groupBy("name").agg(F.min("place").alias("place")).orderBy("place", "name")
    columns = [r["name"] for r in found.collect()]  # headings of all workbooks
    if not columns:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.BooleanType()) for c in answers]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def some(held: list[list[str | None]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*held, strict=True)], columns)

        for b in batches:
            for data in b.column(0):
                every = cells(data.as_py(), sheet)
                at = {name: k for k, name in headings(next(every, {})).items()}
                held: list[list[str | None]] = []
                for row in every:
                    line = [row.get(at[c]) if c in at else None for c in columns]
                    if any(x is not None for x in line):
                        held.append(line)
                    if len(held) == 2000:
                        yield some(held)
                        held = []
                if held:
                    yield some(held)

    escaped = [c.replace("`", "``") for c in columns]
    out = files.select("content").mapInArrow(rows, ", ".join(f"`{c}` string" for c in escaped))
    new = {c: (rename or {}).get(c, c) for c in columns}
    return out.select(*[(answer(F.col(f"`{e}`")) if new[c] in answers else F.col(f"`{e}`")).alias(new[c]) for c, e in zip(columns, escaped, strict=True)])
