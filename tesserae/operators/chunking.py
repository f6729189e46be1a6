"""Splitting texts into passages."""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import document_id

PARENT, PARENT_OVERLAP, CHILD, CHILD_OVERLAP = 1000, 100, 150, 20


def windows(words: Column, size: int, overlap: int) -> Column:
    """Overlapping slices of an array of words; the last one ends with the array. An empty array has none."""
    step = size - overlap
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - overlap), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(words, s, size))


def words(text: Column) -> Column:
    """The words of a text by white space: the default tokenizer."""
    return F.filter(F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), " "), lambda w: F.length(w) > 0)


def sections(text: Column) -> Column:
    """Parts of a text that begin at headings of one to three signs; a text without any is one part."""
    return F.filter(F.split(text, r"(?m)(?=^#{1,3} )"), lambda s: F.length(F.trim(s)) > 0)


def parents_and_children(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_no, parent_no, child_no, parent_id, chunk_id, child_text): both numbers run through a document.

    The numbers follow from positions inside the document's own arrays, so no shuffle is needed.
    """
    parts = F.flatten(F.transform(sections(F.col(text)), lambda s, i: F.transform(windows(words(s), PARENT, PARENT_OVERLAP), lambda p: F.struct(i.alias("section_no"), p.alias("p")))))
    d = docs.select(key, F.transform(parts, lambda x, i: F.struct(x["section_no"].alias("section_no"), i.alias("parent_no"), windows(x["p"], CHILD, CHILD_OVERLAP).alias("c"))).alias("_p"))
    flat = F.flatten(F.transform("_p", lambda x: F.transform(x["c"], lambda c: F.struct(x["section_no"].alias("section_no"), x["parent_no"].alias("parent_no"), c.alias("c")))))
    rows = d.select(key, F.posexplode(flat).alias("child_no", "x"))
    doc = F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8)
    return rows.select(key, "x.section_no", "x.parent_no", "child_no", F.format_string("%s_p_%04d", doc, F.col("x.parent_no")).alias("parent_id"), F.format_string("%s_c_%04d", doc, F.col("child_no")).alias("chunk_id"), F.array_join("x.c", " ").alias("child_text"))


def textualised(rows: DataFrame) -> Column:
    """A typed row as one line of text: header: value, in header order, without empty cells."""
    pairs = F.filter(F.arrays_zip("headers", "cells"), lambda x: F.length(F.trim(x["cells"])) > 0)
    return F.array_join(F.transform(pairs, lambda x: F.concat(x["headers"], F.lit(": "), x["cells"])), ". ")


def code_chunks(source: str, small: int = 400) -> list[str]:
    """A Python file as its top-level functions and classes; a short or broken one as a whole."""
    if len(source.split()) < small:
        return [source]
    try:
        tree = ast.parse(source)
    except SyntaxError:
        return [source]
    lines = source.splitlines()
    out = ["\n".join(lines[n.lineno - 1 : n.end_lineno]) for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    return out or [source]


def blocks(text: Column) -> Column:
    """Parts of a text between blank lines."""
    return F.filter(F.transform(F.split(text, r"\r?\n[ \t]*\r?\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def numbered(rows: DataFrame, path: str, order: str, kind: str) -> DataFrame:
    """Row chunks with ids that run through each file: <document>_<kind>_<number>."""
    n = F.row_number().over(Window.partitionBy(path).orderBy(order)) - 1
    return rows.withColumn("chunk_id", F.format_string(f"%s_{kind}_%04d", document_id(F.col(path)), n))
