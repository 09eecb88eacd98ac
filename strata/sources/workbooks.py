"""Excel workbooks (.xlsx): first sheet, header row.

Reading is a folder job: ``spark.read.format("binaryFile")`` lists the
workbooks, one Arrow task per workbook unpacks the first sheet with the
standard library (zip + XML) row by row, as it is decompressed, and places
each cell under the name that the workbook's header row gives its column;
``files.infer_types`` gives BIGINT / DOUBLE / text columns in one pass.
A workbook is a zip archive, so one file is one task; many workbooks spread
over the cluster.  A task holds the archive, its shared strings and a slice of
rows, never the unpacked sheet.

``workbook_bytes`` writes the minimal SpreadsheetML parts (inline strings);
``write_workbooks`` streams each partition into a workbook (more, if a sheet is
full) in a folder on a file system that executors mount (the shared checkpoint
folder in tests).
"""

from __future__ import annotations

import io
import os
import re
import uuid
import zipfile
from collections.abc import Iterable
from itertools import chain, groupby, islice, takewhile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import NA_TOKENS, infer_types
from ..session import ship_package

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
      "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
      "pr": "http://schemas.openxmlformats.org/package/2006/relationships"}
#: Rows of a sheet (at most 1,048,576 fit one, header included), rows that are written and cells that are read at a time.
SHEET_ROWS, SLICE_ROWS, SLICE_CELLS = 1_000_000, 5_000, 100_000


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _col_letters(i: int) -> str:
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def _elements(part, name: str):
    """Elements of a name as the XML is read; each is dropped, with all before it, when the next one is asked for."""
    tag, path = f"{{{NS['m']}}}{name}", []
    for event, element in ET.iterparse(part, events=("start", "end")):
        if event == "start":
            path.append(element)
            continue
        path.pop()
        if element.tag == tag:
            yield element
            path[-1].clear()


def first_sheet_cells(data: bytes):
    """Yield (row, col, text) for the first sheet of an .xlsx payload."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as part:
                shared = ["".join(t.text or "" for t in si.iter(f"{{{NS['m']}}}t")) for si in _elements(part, "si")]
        wb = ET.fromstring(z.read("xl/workbook.xml"))
        first = wb.find("m:sheets/m:sheet", NS)
        rid = first.get(f"{{{NS['r']}}}id")
        rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in rels.findall("pr:Relationship", NS) if r.get("Id") == rid)
        target = target.lstrip("/")
        sheet_path = target if target.startswith("xl/") else f"xl/{target}"
        with z.open(sheet_path) as sheet:
            for row in _elements(sheet, "row"):
                r = int(row.get("r")) - 1
                for c in row.findall("m:c", NS):
                    t = c.get("t", "n")
                    if t == "inlineStr":
                        text = "".join(x.text or "" for x in c.iter(f"{{{NS['m']}}}t"))
                    else:
                        v = c.find("m:v", NS)
                        if v is None:
                            continue
                        text = shared[int(v.text)] if t == "s" else ("1" if (t == "b" and v.text == "1") else
                                                                      ("0" if t == "b" else v.text))
                    yield r, _col_index(c.get("r")), text


def read_workbooks(spark: SparkSession, folder: str) -> DataFrame:
    """Union of the first sheets of every .xlsx under ``folder``; header row = column names."""
    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(folder)

    def headers(batches):
        for batch in batches:
            for content in batch.column(0):
                head = [(c, text) for _, c, text in takewhile(lambda cell: cell[0] == 0, first_sheet_cells(content.as_py()))]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in head], pa.int32()), pa.array([x for _, x in head], pa.string())],
                                                 ["col", "name"])

    header = files.select("content").mapInArrow(headers, "col int, name string")
    names = [r["name"] for r in header.groupBy("name").agg(F.min("col").alias("col")).orderBy("col").collect()]  # one row per column name

    def rows(batches):
        for batch in batches:
            for content in batch.column(0):
                yield from _named_rows(content.as_py(), names)

    body = files.select("content").mapInArrow(rows, "cells array<string>")
    cell = [F.col("cells")[i] for i in range(len(names))]
    return infer_types(body.select(*[F.when(~F.trim(v).isin(list(NA_TOKENS)), v).alias(name) for v, name in zip(cell, names)]))


def _named_rows(data: bytes, names: list[str]):
    """Rows under the header as lists of texts in the order of ``names``; rows without a named cell are left out."""
    place, out = {}, []
    for r, cells in groupby(first_sheet_cells(data), key=lambda cell: cell[0]):
        if r == 0:
            place = {c: names.index(text) for _, c, text in cells}
            continue
        found = [(place[c], text) for _, c, text in cells if c in place]
        if not found:
            continue
        row = [None] * len(names)
        for at, text in reversed(found):  # of columns with one name the first counts
            row[at] = text
        out.append(row)
        if len(out) * len(names) >= SLICE_CELLS:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], ["cells"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], ["cells"])


def _cell(ref: str, v, whole: bool = False) -> str:
    if v is None or (isinstance(v, float) and v != v):
        return ""
    if whole and isinstance(v, float) and v.is_integer():
        v = int(v)
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f'<c r="{ref}"><v>{repr(v) if isinstance(v, float) else v}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'


def write_workbook(frames: Iterable[pd.DataFrame], to, integral: frozenset = frozenset()) -> int:
    """A minimal one-sheet .xlsx (header row + values, numbers as numbers) of the frames' rows, written as they come; the rows."""
    parts = {
        "[Content_Types].xml": (
            '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
            '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
            '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            '<Default Extension="xml" ContentType="application/xml"/>'
            '<Override PartName="/xl/workbook.xml" '
            'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
            '<Override PartName="/xl/worksheets/sheet1.xml" '
            'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'),
        "_rels/.rels": (
            '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
            f'<Relationships xmlns="{NS["pr"]}"><Relationship Id="rId1" '
            'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" '
            'Target="xl/workbook.xml"/></Relationships>'),
        "xl/workbook.xml": (
            '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
            f'<workbook xmlns="{NS["m"]}" xmlns:r="{NS["r"]}"><sheets>'
            '<sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>'),
        "xl/_rels/workbook.xml.rels": (
            '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
            f'<Relationships xmlns="{NS["pr"]}"><Relationship Id="rId1" '
            'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" '
            'Target="worksheets/sheet1.xml"/></Relationships>'),
    }
    n = 0
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
            sheet.write(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{NS["m"]}"><sheetData>'.encode())
            for pdf in frames:
                if not n:
                    letters = [_col_letters(j) for j in range(len(pdf.columns))]
                    whole = [c in integral for c in pdf.columns]
                    head = "".join(_cell(f"{a}1", str(c)) for a, c in zip(letters, pdf.columns))
                    sheet.write(f'<row r="1">{head}</row>'.encode())
                for i, rec in enumerate(pdf.itertuples(index=False, name=None), start=n + 2):
                    vals = [x.item() if hasattr(x, "item") else x for x in rec]
                    cells = "".join(_cell(f"{a}{i}", v, w) for a, v, w in zip(letters, vals, whole))
                    sheet.write(f'<row r="{i}">{cells}</row>'.encode())
                n += len(pdf)
            sheet.write(b"</sheetData></worksheet>")
    return n


def workbook_bytes(pdf: pd.DataFrame, integral: frozenset = frozenset()) -> bytes:
    """One frame's workbook in memory."""
    buf = io.BytesIO()
    write_workbook([pdf], buf, integral)
    return buf.getvalue()


def write_workbooks(df: DataFrame, folder: str) -> str:
    """One workbook per partition and ``SHEET_ROWS`` rows, written by the executors into ``folder`` (a mounted shared path)."""
    from pyspark.sql import types as T

    local = folder[len("file:"):] if folder.startswith("file:") else folder
    columns = df.columns
    integral = frozenset(f.name for f in df.schema.fields
                         if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)))

    def write(batches):
        held = (pdf[columns].iloc[at:at + SLICE_ROWS] for pdf in batches for at in range(0, len(pdf), SLICE_ROWS))
        for first in held:
            os.makedirs(local, exist_ok=True)
            name = os.path.join(local, f"part-{uuid.uuid4().hex}.xlsx")
            # a workbook that is not whole has another name: it is never read
            n = write_workbook(chain([first], islice(held, SHEET_ROWS // SLICE_ROWS - 1)), f"{name}.part", integral)
            os.replace(f"{name}.part", name)
            yield pd.DataFrame({"path": [name], "rows": [n]})

    ship_package(df.sparkSession)
    df.mapInPandas(write, "path string, rows long").collect()  # one row per written file
    return folder
