"""Workbooks are read and written row by row."""

import io
import tracemalloc

import pandas as pd

from strata.session import scratch_path
from strata.sources import workbooks as W


def test_a_sheet_is_never_held_whole():
    """Before, the XML tree of the whole sheet was in memory (over 100 MB here)."""
    data = W.workbook_bytes(pd.DataFrame({"a": range(60_000), "b": ["x"] * 60_000, "c": 0.5}))
    tracemalloc.start()
    n = sum(1 for _ in W.first_sheet_cells(data))
    read = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    rows = W.write_workbook((pd.DataFrame({"a": range(1000), "b": ["x"] * 1000}) for _ in range(60)), io.BytesIO())
    written = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 180_003 and rows == 60_000 and read < 10 << 20 and written < 10 << 20


def test_full_sheets_and_headers_in_another_order(spark, monkeypatch):
    monkeypatch.setattr(W, "SLICE_ROWS", 10)
    monkeypatch.setattr(W, "SHEET_ROWS", 20)
    folder = W.write_workbooks(spark.range(45).selectExpr("id", "id / 2 AS half", "IF(id % 5 = 0, NULL, concat('t', id)) AS name").coalesce(1),
                               scratch_path(spark, "books"))
    with open(f"{folder.removeprefix('file:')}/other.xlsx", "wb") as f:
        f.write(W.workbook_bytes(pd.DataFrame({"name": ["z", None, None], "id": [100, 101, None]})))
    assert spark.read.format("binaryFile").load(folder).count() == 4
    got = {r["id"]: (r["half"], r["name"]) for r in W.read_workbooks(spark, folder).collect()}
    want = {i: (i / 2, None if i % 5 == 0 else f"t{i}") for i in range(45)} | {100: (None, "z"), 101: (None, None)}
    assert got == want
