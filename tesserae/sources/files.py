"""Readers: files of many formats as documents and as tables, in Arrow batches over a binary scan.

A file that can't be read gives a row with its error code and no text; it never ends the job.
Formats whose libraries are not installed (PDF, drawings, building models) report ``no_parser``.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.tables import expand_spans

#: Files beyond this size are not parsed in line.
LARGE = 30 * 1024 * 1024
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def decoded(data: bytes) -> str:
    """UTF-8 with or without a mark, else the old Cyrillic code page."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("cp1251", "replace")


def text_file(data: bytes) -> tuple[str, dict[str, str]]:
    t = decoded(data)
    return t, {"headings": str(len(re.findall(r"(?m)^#{1,6} ", t))), "functions": str(len(re.findall(r"(?m)^\s*(?:async )?def ", t))), "classes": str(len(re.findall(r"(?m)^\s*class ", t)))}


def json_file(data: bytes) -> tuple[str, dict[str, str]]:
    """A list as a line an item with its number, anything else indented."""
    x = json.loads(decoded(data))
    if isinstance(x, list):
        return "\n".join(f"[{i}] {json.dumps(v, ensure_ascii=False)}" for i, v in enumerate(x)), {"items": str(len(x))}
    return json.dumps(x, ensure_ascii=False, indent=2), {}


def delimiter(sample: str) -> str:
    """The delimiter of a table by its first characters: the one that cuts most lines into equally many parts."""
    lines = [x for x in sample[:4096].splitlines() if x.strip()][:20]

    def weight(d: str) -> tuple[int, int]:
        n = [x.count(d) for x in lines]
        common = max(set(n), key=n.count) if n else 0
        return (n.count(common) if common else 0, common)

    return max(";,\t|", key=weight) if lines else ";"


def csv_grid(data: bytes) -> list[list[str]]:
    t = decoded(data)
    return [list(r) for r in csv.reader(io.StringIO(t), delimiter=delimiter(t))]


def csv_file(data: bytes) -> tuple[str, dict[str, str]]:
    rows = csv_grid(data)
    if not rows:
        return "", {}
    return "\n".join([" | ".join(rows[0]), *(f"[{i}] " + " | ".join(r) for i, r in enumerate(rows[1:], 1))]), {"rows": str(len(rows) - 1)}


def docx_parts(data: bytes) -> Iterator[tuple[str, object]]:
    """("heading" | "text", text) and ("table", matrix of cells with spans), in order."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    for e in body if body is not None else ():
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            yield ("heading" if name.lower().startswith(("heading", "заголовок")) else "text"), said(e)
        elif e.tag == f"{_W}tbl":
            matrix, open_ = [], {}
            for r in e.findall(f"{_W}tr"):
                row, at = [], 0
                for c in r.findall(f"{_W}tc"):
                    span = c.find(f"{_W}tcPr/{_W}gridSpan")
                    wide = int(span.get(f"{_W}val", "1")) if span is not None else 1
                    merge = c.find(f"{_W}tcPr/{_W}vMerge")
                    if merge is not None and merge.get(f"{_W}val") != "restart":
                        if at in open_:
                            open_[at]["rowspan"] += 1  # continued: the master covers it, no cell of its own
                    else:
                        cell = {"text": "\n".join(said(p) for p in c.findall(f"{_W}p")), "colspan": wide, "rowspan": 1}
                        row.append(cell)
                        open_.pop(at, None)
                        if merge is not None:
                            open_[at] = cell
                    at += wide
                matrix.append(row)
            yield "table", matrix


def docx_file(data: bytes) -> tuple[str, dict[str, str]]:
    out, tables = [], 0
    for kind, x in docx_parts(data):
        if kind == "table":
            tables += 1
            out += [" | ".join(r) for r in expand_spans(x)]
        elif str(x).strip():
            out.append(f"# {x}" if kind == "heading" else str(x))
    return "\n".join(out), {"tables": str(tables)}


def place(reference: str) -> tuple[int, int]:
    """Row and column, from 0, of a cell's reference such as AB12."""
    column = 0
    for c in re.sub(r"\d", "", reference):
        column = column * 26 + ord(c) - 64
    return int(re.sub(r"\D", "", reference)) - 1, column - 1


def xlsx_sheets(data: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """(name, grid) of each sheet: values only, merged cells in every place they cover."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = z.namelist()
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
    titles = [s.get("name", "") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")] if "xl/workbook.xml" in names else []
    sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n.rsplit("/", 1)[1])))
    for i, n in enumerate(sheets):
        root = ElementTree.fromstring(z.read(n))
        cells: dict[tuple[int, int], str] = {}
        for c in root.iter(f"{_S}c"):
            v, kind = c.find(f"{_S}v"), c.get("t")
            text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if kind == "inlineStr" else (v.text or "") if v is not None else ""
            if kind == "s" and text:
                text = shared[int(text)]
            if c.get("r"):
                cells[place(c.get("r"))] = text
        for m in root.iter(f"{_S}mergeCell"):
            a, _, b = m.get("ref", "").partition(":")
            if b:
                (r0, c0), (r1, c1) = place(a), place(b)
                for r in range(r0, r1 + 1):
                    for c in range(c0, c1 + 1):
                        cells[r, c] = cells.get((r0, c0), "")
        height, width = max((r for r, _ in cells), default=-1) + 1, max((c for _, c in cells), default=-1) + 1
        yield titles[i] if i < len(titles) else n, [[cells.get((r, c), "") for c in range(width)] for r in range(height)]


def xlsx_file(data: bytes) -> tuple[str, dict[str, str]]:
    out, n = [], 0
    for name, grid in xlsx_sheets(data):
        n += 1
        out += [f"# {name}", *(" | ".join(r) for r in grid if any(r))]
    return "\n".join(out), {"sheets": str(n)}


#: Suffix -> reader of bytes; callers may add their own (OCR, PDF, models), which stay off by default.
PARSERS: dict[str, Callable[[bytes], tuple[str, dict[str, str]]]] = {"txt": text_file, "md": text_file, "py": text_file, "json": json_file, "csv": csv_file, "docx": docx_file, "xlsx": xlsx_file}
GRIDS: dict[str, Callable[[bytes], list[list[list[str]]]]] = {"csv": lambda d: [csv_grid(d)], "xlsx": lambda d: [g for _, g in xlsx_sheets(d)], "docx": lambda d: [expand_spans(x) for k, x in docx_parts(d) if k == "table"]}

DOCUMENT = "source_path string, file_name string, format string, text string, created_at timestamp, modified_at timestamp, sha256 string, error string, extra map<string,string>"


def scan(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The files below a path: path, modificationTime, length, content; only what is asked for is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def documents(files: DataFrame, parsers: dict[str, Callable] | None = None) -> DataFrame:
    """Parsed documents of a binary scan."""
    known = dict(PARSERS if parsers is None else parsers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            rows = []
            for path, at, size, data in zip(*(b.column(n).to_pylist() for n in ("path", "modificationTime", "length", "content"))):
                name = re.split(r"[\\/]", path)[-1]
                form = name.rsplit(".", 1)[-1].lower() if "." in name else ""
                text, extra, error = None, {}, None
                if form not in known:
                    error = "no_parser"
                elif size > LARGE:
                    error = "too_large"
                else:
                    try:
                        text, extra = known[form](data)
                        error = None if text.strip() else "empty"
                    except Exception as e:
                        error = f"unreadable:{type(e).__name__}"
                rows.append((path, name, form, text, at, at, hashlib.sha256(data or b"").hexdigest()[:16], error, list(extra.items())))
            ts = pa.timestamp("us", "UTC")
            types = (pa.string(), pa.string(), pa.string(), pa.string(), ts, ts, pa.string(), pa.string(), pa.map_(pa.string(), pa.string()))
            cols = list(zip(*rows)) if rows else [()] * len(types)
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, types)], [x.split(" ")[0] for x in DOCUMENT.replace("map<string,string>", "map").split(", ")])

    return files.select("path", "modificationTime", "length", "content").mapInArrow(run, DOCUMENT)


def grids(files: DataFrame, readers: dict[str, Callable] | None = None) -> DataFrame:
    """(source_path, table_no, line_no, cells) of all tables in files; unreadable files have no line."""
    known = dict(GRIDS if readers is None else readers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, size, data in zip(*(b.column(n).to_pylist() for n in ("path", "length", "content"))):
                read = known.get(path.rsplit(".", 1)[-1].lower())
                if read is None or size > LARGE:
                    continue
                try:
                    found = read(data)
                except Exception:
                    continue
                rows += [(path, t, i, list(map(str, r))) for t, g in enumerate(found) if len(g) > 1 for i, r in enumerate(g)]
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string())))], ["source_path", "table_no", "line_no", "cells"])

    return files.select("path", "length", "content").mapInArrow(run, "source_path string, table_no int, line_no int, cells array<string>")


def merge_pages(pages: DataFrame, key: str) -> DataFrame:
    """(key, text, scanned) of pages (key, page, text, ocr): a page of fewer than 50 characters is a scan and takes its recognised text."""
    thin = F.length(F.trim(F.coalesce("text", F.lit("")))) < 50
    best = F.when(thin, F.coalesce("ocr", "text")).otherwise(F.col("text"))
    p = pages.select(key, F.struct("page", F.coalesce(best, F.lit("")).alias("t")).alias("p"), thin.cast("int").alias("s"))
    return p.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["t"]), "\n").alias("text"), F.sum("s").alias("scanned"))
