"""Indexing: files to parsed, chunked and embedded documents, in one commit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StructType

from tesserae.functions.text import document_id
from tesserae.operators import chunking, corpus, tables
from tesserae.operators.embed import Provider, embed
from tesserae.session import fresh_path
from tesserae.sources import files as readers
from tesserae.sources.versions import VersionedTable

CHUNKS = "doc_id string, chunk_id string, parent_id string, text string, source_path string, sha256 string, vector array<float>"
#: The tables that are committed with the chunks.
BESIDE = {
    "files": "source_path string, sha256 string, format string, error string, modified_at timestamp, chunk_count bigint",
    "parents": "doc_id string, parent_id string, parent_text string, source_path string, sha256 string",
    "rows": "source_path string, sha256 string, table_no int, line_no int, raw_row map<string,string>, " + ", ".join(f"{f} string" for f in tables.TEXTS) + ", " + ", ".join(f"{f} double" for f in tables.NUMBERS),
}
#: Formats that are chunked row by row; a text document with tables has both.
BY_ROW, BY_BOTH = ("xlsx", "csv"), ("docx",)


def _code(text: Column) -> Column:
    @arrow_udf("array<string>")
    def kernel(sources: pa.Array) -> pa.Array:
        return pa.array([chunking.code_chunks(x or "") for x in sources.to_pylist()], pa.list_(pa.string()))

    return kernel(text)


def chunks_of(documents: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Passages of parsed documents by their format: rows of sheets and tables, functions and classes of
    code, windows under headings of everything else. Documents with an error, and empty ones, have none."""
    names = ("doc_id", "chunk_id", "parent_id", "text", "source_path", "sha256")
    d = documents.filter("error is null").select("source_path", "sha256", "text", "format", document_id(F.col("source_path")).alias("doc_id"))
    prose = d.filter(~F.col("format").isin("py", *BY_ROW))
    c = chunking.parents_and_children(prose, "source_path", "text").select("source_path", "parent_id", "chunk_id", F.col("child_text").alias("text"))
    out = c.join(prose.drop("text"), "source_path").select(*names)
    code = d.filter("format = 'py'").select("doc_id", "source_path", "sha256", F.posexplode(_code(F.col("text"))).alias("_n", "text"))
    out = out.unionByName(code.select("doc_id", F.format_string("%s_k_%04d", "doc_id", "_n").alias("chunk_id"), F.lit(None).cast("string").alias("parent_id"), "text", "source_path", "sha256"))
    if rows is not None:
        said = F.filter(F.map_entries("raw_row"), lambda x: F.length(F.trim(F.coalesce(x["value"], F.lit("")))) > 0)
        line = F.array_join(F.transform(said, lambda x: F.concat(x["key"], F.lit(": "), x["value"])), ". ")
        doc = document_id(F.col("source_path"))
        r = rows.select(doc.alias("doc_id"), F.format_string("%s_r_%02d_%05d", doc, "table_no", "line_no").alias("chunk_id"), F.lit(None).cast("string").alias("parent_id"), line.alias("text"), "source_path", "sha256")
        out = out.unionByName(r)
    return out.filter(F.length(F.trim("text")) > 0)


def parents_of(documents: DataFrame) -> DataFrame:
    d = documents.filter("error is null").filter(~F.col("format").isin("py", *BY_ROW))
    parts = F.flatten(F.transform(chunking.sections(F.col("text")), lambda s: chunking.windows(chunking.words(s), chunking.PARENT, chunking.PARENT_OVERLAP)))
    doc = document_id(F.col("source_path"))
    p = d.select(doc.alias("doc_id"), "source_path", "sha256", F.posexplode(parts).alias("_n", "_w"))
    return p.select("doc_id", F.format_string("%s_p_%04d", "doc_id", "_n").alias("parent_id"), F.array_join("_w", " ").alias("parent_text"), "source_path", "sha256")


class Index:
    """The chunk table with the catalog, parents and table rows that belong to its version.

    The chunk table's commit names the versions of the others, so one rename switches all of them; what
    a run that died has written beside is on no named version and is left aside by the next.
    """

    def __init__(self, spark: SparkSession, chunks: VersionedTable) -> None:
        self.spark, self.chunks = spark, chunks
        self.beside = {n: VersionedTable(spark, f"{chunks.path}-{n}", StructType.fromDDL(s)) for n, s in BESIDE.items()}

    def named(self) -> dict[str, int]:
        return self.chunks.properties().get("beside", dict.fromkeys(BESIDE, 0))

    def read(self, name: str) -> DataFrame:
        return self.beside[name].read(self.named()[name])


def index(spark: SparkSession, path: str, table: VersionedTable, provider: Provider) -> tuple[int, DataFrame]:
    """Index what is new or changed below a path; the new version and what happened to each file.

    Files are hashed first, and only those whose hash the catalog doesn't hold are parsed. Files that
    are gone, empty or unreadable lose their chunks; an unreadable one is tried again when its content
    changes. A chunk whose text the file had before keeps its vector. Everything up to the commit is
    without effect; without a change there is none.
    """
    at = Index(spark, table)
    after, named = table.version(), at.named()
    scan = readers.scan(spark, path)
    seen = scan.select(F.col("path").alias("source_path"), F.substring(F.sha2("content", 256), 1, 16).alias("sha256"))
    seen = _written(spark, seen, "seen")
    known = at.read("files")
    todo = corpus.changed_files(seen, known.withColumn("status", F.lit("indexed")))
    gone = known.select("source_path").join(seen.select("source_path"), "source_path", "left_anti").withColumn("reason", F.lit("deleted"))
    affected = _written(spark, todo.unionByName(gone), "affected")
    if not affected.isEmpty():
        fresh = scan.join(affected.filter("reason <> 'deleted'").select(F.col("source_path").alias("path")), "path", "left_semi")
        docs = _written(spark, readers.documents(fresh), "parsed")
        grids = tables.parse_grids(readers.grids(fresh.filter(F.lower("path").rlike(r"\.(?:" + "|".join((*BY_ROW, *BY_BOTH)) + ")$"))), ["source_path", "table_no"])
        rows = _written(spark, grids.join(docs.select("source_path", "sha256"), "source_path"), "rows")
        new = chunks_of(docs, rows)
        old = table._present(after).join(affected.select("source_path"), "source_path", "left_semi").groupBy("source_path", F.md5("text").alias("_d")).agg(F.first("vector").alias("vector"))
        same = new.withColumn("_d", F.md5("text")).join(old, ["source_path", "_d"], "left").drop("_d")
        staged = _written(spark, same, "chunks")
        vectors = staged.filter("vector is not null").unionByName(embed(staged.filter("vector is null").drop("vector"), provider))
        counts = staged.groupBy("source_path").agg(F.count("*").alias("chunk_count"))
        catalog = docs.join(counts, "source_path", "left").select("source_path", "sha256", "format", "error", "modified_at", F.coalesce("chunk_count", F.lit(0)).cast("bigint").alias("chunk_count"))
        beside = {"files": catalog, "parents": parents_of(docs), "rows": rows}
        versions = {n: at.beside[n].replace(named[n], affected, "source_path", r, named=False) for n, r in beside.items()}
        after = table.replace(after, affected, "source_path", vectors, {"model": provider.name, "dimension": provider.dimension, "beside": versions})
    every = seen.select("source_path").unionByName(affected.filter("reason = 'deleted'").select("source_path"))
    report = every.join(affected, "source_path", "left").join(at.read("files").select("source_path", "error"), "source_path", "left")
    return after, report.select("source_path", F.coalesce("error", "reason", F.lit("unchanged")).alias("outcome"))


def _written(spark: SparkSession, rows: DataFrame, what: str) -> DataFrame:
    at = fresh_path(spark, what)
    rows.write.parquet(at)
    return spark.read.schema(rows.schema).parquet(at)
