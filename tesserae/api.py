"""The tools a user calls, each returning a DataFrame (or an Answer with its status)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import document_id
from tesserae.operators import corpus, extract, graph, retrieval, tables
from tesserae.operators.embed import Provider
from tesserae.operators.incremental import current_files
from tesserae.plans import search


def _clamp(n: int, most: int) -> int:
    return max(1, min(most, n))


@dataclass
class Engine:
    """A corpus: chunks with vectors, parents, the catalog of files, and optional tables."""

    chunks: DataFrame
    parents: DataFrame
    files: DataFrame
    edges: DataFrame | None = None
    rules: DataFrame | None = None
    pages: DataFrame | None = None
    table_rows: DataFrame | None = None
    jobs: DataFrame | None = None
    manifest: dict | None = None
    provider: Provider | None = None

    def search_documents(self, question: str, top_k: int = 8, dataset: str | None = None, folder: str | None = None, rerank: bool | None = None) -> search.Answer:
        return search.search_documents(search.Corpus(self.chunks, self.parents, self.manifest or {}), question, top_k, dataset, folder, self.provider, rerank)

    def search_rules(self, query: str = "", subject: str = "", parameter: str = "", limit: int = 20) -> DataFrame:
        return corpus.search_rules(self.rules, query, subject, parameter, limit)

    def extract_structured_values(self, labels: list[str], folder: str | None = None) -> DataFrame:
        rows = self.parents.filter(F.col("source_path").contains(folder)) if folder else self.parents
        return extract.labelled_values(rows, "parent_id", "parent_text", labels)

    def search_drawings(self, pages: DataFrame, query: list[float], top_k: int = 5, folder: str | None = None, dataset: str | None = None) -> DataFrame:
        """Page vectors (chunk_id, source_path, vector) closest to a query by cosine, inside a folder and a dataset."""
        rows = pages.filter(F.lower("source_path").contains(folder.lower())) if folder else pages
        if dataset:
            rows = rows.join(self.files.filter(F.col("dataset") == dataset).select("source_path").distinct(), "source_path", "left_semi")
        return retrieval.dense_topk(rows, query, _clamp(top_k, 20))

    def sum_table_values(self, subject: list[str], field: str = "qty", op: str = "sum", explicit: bool = True, unreadable: int = 0) -> DataFrame:
        """A verified total over all rows that hold the subject; only one file of each document counts."""
        best = tables.one_file_per_document(current_files(self.files)).select("source_path")
        rows = self.table_rows.join(best, "source_path", "left_semi") if "source_path" in self.table_rows.columns else self.table_rows
        return tables.total(rows.filter(tables.row_matches(F.concat_ws(" ", "name", "mark", "code", "pos"), subject)), field, op, explicit, unreadable)

    def get_table(self, section: str | None = None, subject: list[str] = (), group_by: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
        """Rows of the tables, or their count by a column; a column nobody has is an error that lists those there are."""
        rows = self.table_rows
        if section:
            rows = rows.filter(F.lower("section").contains(section.lower()))
        if subject:
            rows = rows.filter(tables.row_matches(F.concat_ws(" ", "name", "mark"), list(subject)))
        if group_by:
            have = next((c for c in rows.columns if group_by.lower() in c.lower()), None)
            if have is None:
                raise ValueError(f"no column {group_by}; there are {', '.join(rows.columns)}")
            return tables.count_by(rows, F.col(have).cast("string")).orderBy(F.desc("count"), "value")
        order = [c for c in ("source_path", "doc_id", "table_no", "line_no") if c in rows.columns]
        return retrieval.page(rows, order, max(0, offset), _clamp(limit, 500))

    def find_occurrences(self, needle: str, offset: int = 0, limit: int = 50) -> tuple[DataFrame, DataFrame]:
        """One page of the occurrences, and the whole breakdown by document with its total."""
        hits = retrieval.occurrences(self.chunks, needle)
        by = hits.groupBy("file_name").agg(F.count("*").alias("matches")).orderBy(F.desc("matches"), "file_name")
        return retrieval.page(hits.select("chunk_id", "source_path", "file_name", "snippet"), ["source_path", "chunk_id"], max(0, offset), _clamp(limit, 200)), by

    def locate_quote(self, quote: str) -> DataFrame:
        return extract.locate(self.pages, [(1, quote)], "page", "text")

    def graph_neighbors(self, source_path: str, k: int = 10) -> DataFrame:
        doc = F.substring(F.sha2(F.lit(source_path), 256), 1, 8)
        return graph.neighbours(self.edges.filter((F.col("doc_id_a") == doc) | (F.col("doc_id_b") == doc)), self.files, _clamp(k, 100)).filter(F.col("doc_id_a") == doc)

    def list_indexed(self, folder: str | None = None, dataset: str | None = None, offset: int = 0, limit: int = 100) -> tuple[DataFrame, DataFrame]:
        """One page of the catalog, and the summary of all of it that matches."""
        rows = current_files(self.files)
        rows = rows.filter(F.col("source_path").contains(folder)) if folder else rows
        rows = rows.filter(F.col("dataset") == dataset) if dataset else rows
        return retrieval.page(rows.withColumn("doc_id", document_id(F.col("source_path"))), ["source_path"], max(0, offset), _clamp(limit, 500)), corpus.summary(rows)

    def changed(self, seen: DataFrame) -> DataFrame:
        return corpus.changed_files(seen, current_files(self.files))

    def jobs_status(self, limit: int = 20) -> DataFrame:
        """The latest jobs; one without an end whose log ended is said to have failed."""
        state = F.when(F.col("finished_at").isNotNull(), F.col("run_status")).when(F.col("run_status") == "killed", "failed").otherwise("running")
        return self.jobs.withColumn("state", state).orderBy(F.desc("started_at"), F.desc("run_id")).limit(_clamp(limit, 100))
