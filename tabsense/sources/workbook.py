"""Workbook (.xlsx) source as a Spark job (SRC-3, with CLN-1..4).

A directory of workbooks is read with the ``binaryFile`` source; each file
is unpacked inside a task by ``mapInPandas`` with the standard library
(``zipfile`` + ``xml.etree``) into ``(file, sheet_no, sheet, row_no, cells,
is_text)`` rows.  A workbook is a zip archive and cannot be split, so the
unit of parallelism is the file.  Header choice (CLN-1) is a window over at
most six rows per sheet; only one header row per sheet reaches the driver.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import TabsenseError
from ..operators.clean import clean_frame, pick_header

ROWS_SCHEMA = ("file string, sheet_no int, sheet string, row_no int, "
               "cells array<string>, is_text array<boolean>")
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "p": "http://schemas.openxmlformats.org/package/2006/relationships"}
_REF = re.compile(r"([A-Z]+)(\d+)")


def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{{{_NS['m']}}}t"))


def workbook_rows(path: str, content: bytes):
    """Yield ``(path, sheet_no, sheet, row_no, cells, is_text)`` for one .xlsx."""
    zf = zipfile.ZipFile(io.BytesIO(content))
    names = set(zf.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        root = ET.fromstring(zf.read("xl/sharedStrings.xml"))
        shared = [_text(si) for si in root.findall("m:si", _NS)]
    rels = {}
    if "xl/_rels/workbook.xml.rels" in names:
        for rel in ET.fromstring(zf.read("xl/_rels/workbook.xml.rels")).findall("p:Relationship", _NS):
            target = rel.get("Target").lstrip("/")
            rels[rel.get("Id")] = target if target.startswith("xl/") else "xl/" + target
    book = ET.fromstring(zf.read("xl/workbook.xml"))
    for sheet_no, sh in enumerate(book.findall("m:sheets/m:sheet", _NS)):
        target = rels.get(sh.get(f"{{{_NS['r']}}}id"), f"xl/worksheets/sheet{sheet_no + 1}.xml")
        if target not in names:
            continue
        root = ET.fromstring(zf.read(target))
        for row in root.iter(f"{{{_NS['m']}}}row"):
            cells: dict[int, tuple[str | None, bool]] = {}
            for i, c in enumerate(row.findall("m:c", _NS)):
                ref = _REF.match(c.get("r") or "")
                col = _col_index(ref.group(1)) if ref else i
                kind = c.get("t")
                v = c.find("m:v", _NS)
                if kind == "s" and v is not None:
                    val, is_text = shared[int(v.text)], True
                elif kind == "inlineStr":
                    val, is_text = _text(c), True
                elif kind in ("str", "e"):
                    val, is_text = (v.text if v is not None else None), True
                elif kind == "b":
                    val, is_text = (v.text if v is not None else None), False
                else:
                    val, is_text = (v.text if v is not None else None), False
                if val is not None and val != "":
                    cells[col] = (val, is_text)
            if not cells:
                continue
            width = max(cells) + 1
            yield (path, sheet_no, sh.get("name") or "", int(row.get("r")) - 1,
                   [cells.get(j, (None, False))[0] for j in range(width)],
                   [cells.get(j, (None, False))[1] for j in range(width)])


def _parse_batches(batches):
    cols = ["file", "sheet_no", "sheet", "row_no", "cells", "is_text"]
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            rows.extend(workbook_rows(path, bytes(content)))
        yield pd.DataFrame(rows, columns=cols)


def read_workbook_rows(spark: SparkSession, path: str, glob: str = "*.xlsx") -> DataFrame:
    """All non-empty rows of every sheet of every workbook under ``path``."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", True).load(path).select("path", "content"))
    return files.mapInPandas(_parse_batches, ROWS_SCHEMA)


def sheet_frames(rows: DataFrame) -> dict[tuple[str, str], DataFrame]:
    """SRC-3: one cleaned DataFrame per non-empty sheet, keyed ``(file, sheet)``.

    Header per sheet by CLN-1; rows below it become records; a column whose
    filled cells are all numbers becomes double; then CLN-2..4.  A blank
    sheet title becomes ``sheetN``.  No sheet at all raises ``emptyFile``.
    """
    heads = pick_header(rows).join(rows, ["file", "sheet"]).where(
        F.col("row_no") == F.col("header_row")).select(
        "file", "sheet", "sheet_no", "header_row", "cells").collect()
    if not heads:
        raise TabsenseError("emptyFile")
    out: dict[tuple[str, str], DataFrame] = {}
    for h in sorted(heads, key=lambda r: (r["file"], r["sheet_no"])):
        names, seen = [], set()
        for j, c in enumerate(h["cells"]):
            name = str(c) if c is not None and str(c).strip() else f"Unnamed: {j}"
            while name in seen:
                name += "_"
            seen.add(name)
            names.append(name)
        body = rows.where((F.col("file") == h["file"]) & (F.col("sheet") == h["sheet"]) &
                          (F.col("row_no") > h["header_row"]))
        flags = body.agg(*[F.bool_and(F.when(F.try_element_at("cells", F.lit(j + 1)).isNotNull(),
                                             ~F.try_element_at("is_text", F.lit(j + 1))))
                           .alias(f"n{j}") for j in range(len(names))]).first()
        cols = []
        for j, name in enumerate(names):
            cell = F.try_element_at("cells", F.lit(j + 1))
            cols.append((cell.try_cast("double") if flags[f"n{j}"] else cell).alias(name))
        frame = clean_frame(body.select(*cols))
        if not frame.columns or frame.limit(1).count() == 0:
            continue
        title = (h["sheet"] or "").strip() or f"sheet{len(out) + 1}"
        out[(h["file"], title)] = frame
    if not out:
        raise TabsenseError("emptyFile")
    return out

