"""Formats that come as pages: the interface of their readers, and page by page recognition.

Readers of PDF, drawings and building models are callables of a caller; none is built in. What they
give is put together here: a page of hardly any text is a scan, its text comes from a recogniser,
whose failure is an error code of that page and never of the file.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters from which a page counts as text; pages and tables a file is read to.
THIN, MOST_PAGES, MOST_TABLES = 50, 400, 4000


class PageReader(ABC):
    """Reads the pages of a file: the text of each, and its tables as grids of cells."""

    @abstractmethod
    def texts(self, data: bytes) -> list[str]: ...

    def tables(self, data: bytes) -> Iterator[tuple[int, list[list[str]]]]:
        return iter(())


class Recogniser(ABC):
    """Text of a scanned page. external ones send content elsewhere and must be allowed by their caller."""

    external = False

    @abstractmethod
    def page(self, data: bytes, number: int) -> str: ...


def pages(files: DataFrame, readers: dict[str, PageReader], recogniser: Recogniser | None = None, allow_external: bool = False) -> DataFrame:
    """(source_path, page, text, scanned, error) of a binary scan's files; a file is at least one row.

    Codes: no_reader, unreadable, too_many_pages (the pages up to the bound are there), and of a page
    no_recogniser, recogniser_failed, recogniser_empty.
    """
    if recogniser is not None and recogniser.external and not allow_external:
        raise PermissionError("this recogniser sends content elsewhere")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                read = readers.get(path.rsplit(".", 1)[-1].lower())
                if read is None:
                    rows.append((path, None, None, False, "no_reader"))
                    continue
                try:
                    texts = list(read.texts(data))
                except Exception:
                    rows.append((path, None, None, False, "unreadable"))
                    continue
                for n, t in enumerate(texts[:MOST_PAGES]):
                    rows.append((path, n, *_page(t or "", data, n, recogniser)))
                if len(texts) > MOST_PAGES:
                    rows.append((path, None, None, False, "too_many_pages"))
            cols = list(zip(*rows)) if rows else [()] * 5
            types = (pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.string())
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, types)], ["source_path", "page", "text", "scanned", "error"])

    return files.select("path", "content").mapInArrow(run, "source_path string, page int, text string, scanned boolean, error string")


def _page(text: str, data: bytes, n: int, recogniser: Recogniser | None) -> tuple[str, bool, str | None]:
    if len(text.strip()) >= THIN:
        return text, False, None
    if recogniser is None:
        return text, True, "no_recogniser"
    try:
        read = recogniser.page(data, n)
    except Exception:
        return text, True, "recogniser_failed"
    return (read, True, None) if read and read.strip() else (text, True, "recogniser_empty")


def assembled(rows: DataFrame) -> DataFrame:
    """(source_path, text, pages, scanned, error): documents of their pages in order; error is the first code of the file.

    A file's pages are bounded by ``MOST_PAGES``.
    """
    p = F.array_sort(F.collect_list(F.when(F.col("page").isNotNull(), F.struct("page", F.coalesce("text", F.lit("")).alias("t")))))
    g = rows.groupBy("source_path").agg(p.alias("_p"), F.count("page").alias("pages"), F.count(F.when(F.col("scanned"), 1)).alias("scanned"), F.min_by("error", F.struct(F.coalesce("page", F.lit(-1)), "error")).alias("_first"), F.min("error").alias("_any"))
    text = F.array_join(F.transform("_p", lambda x: x["t"]), "\n")
    return g.select("source_path", F.when(F.col("pages") > 0, text).alias("text"), "pages", "scanned", F.coalesce("_first", "_any").alias("error"))


def page_grids(files: DataFrame, readers: dict[str, PageReader]) -> DataFrame:
    """(source_path, table_no, line_no, cells) of the tables in paged files; unreadable files have no line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                read = readers.get(path.rsplit(".", 1)[-1].lower())
                try:
                    found = list(zip(range(MOST_TABLES), (g for p, g in read.tables(data) if p < MOST_PAGES))) if read else []
                except Exception:
                    found = []
                rows += [(path, t, i, [c or "" for c in r]) for t, g in found if len(g) > 1 for i, r in enumerate(g)]
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string())))], ["source_path", "table_no", "line_no", "cells"])

    return files.select("path", "content").mapInArrow(run, "source_path string, table_no int, line_no int, cells array<string>")


def as_parser(reader: PageReader) -> Callable[[bytes], tuple[str, dict[str, str]]]:
    """A page reader as a parser of whole documents, for the table of parsers."""
    return lambda data: ("\n".join(reader.texts(data)[:MOST_PAGES]), {"pages": str(len(reader.texts(data)))})
