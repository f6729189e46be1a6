"""A second store of passages, as a table of points with a payload, brought to the shape of our own hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators import retrieval

#: What a point must be to count as evidence, and the type of norms.
EVIDENCE, NORMATIVE = "evidence", "NORMATIVE"


def _said(name: str) -> Column:
    return F.coalesce(F.try_element_at("payload", F.lit(name)), F.lit(""))


def scope(dataset: str | None) -> Column:
    """Evidence only; norms are of their type, a project is of any other."""
    kind = _said("doc_type")
    s = _said("node_role") == EVIDENCE
    return s & (kind == NORMATIVE) if dataset == "normative" else s & (kind != NORMATIVE) if dataset == "project" else s


def rows(points: DataFrame) -> DataFrame:
    """Points (id, payload map, score) as hits: the window around a passage plays the part of its parent's text."""
    around = (_said("context_before"), _said("text"), _said("context_after"))
    text = F.array_join(F.filter(F.array(*around), lambda x: x != ""), "\n")
    path = _said("file_name")
    return points.select(
        F.col("id").cast("string").alias("chunk_id"), F.when(_said("parent_id") != "", _said("parent_id")).otherwise(F.col("id").cast("string")).alias("parent_id"), _said("doc_id").alias("doc_id"),
        text.alias("text"), around[1].alias("child_text"), F.when((around[0] != "") | (around[2] != ""), "window").otherwise("child").alias("context_source"), F.length(text).alias("context_chars"),
        path.alias("source_path"), F.regexp_extract(path, r"([^\\/]*)$", 1).alias("file_name"), F.coalesce(F.nullif(_said("section_heading"), F.lit("")), _said("parent_heading")).alias("section"),
        F.round(F.coalesce("score", F.lit(0.0)), 4).alias("score"), _said("dataset_name").alias("dataset"),
    )


def search(points: DataFrame, query: list[float], lexical: DataFrame | None, k: int, dataset: str | None = None, prefetch: int = 4) -> DataFrame:
    """The k best points (id, vector, payload) of a question: the dense list and, if given, a lexical one (id, bm25),
    each of prefetch * k points in scope, fused by reciprocal rank. Points without evidence are never read into a list."""
    inside = points.filter(scope(dataset))
    dense = retrieval.dense_topk(inside.select(F.col("id").cast("string").alias("chunk_id"), "vector"), query, prefetch * k).withColumn("q", F.lit(1))
    lists = retrieval.first_rows(dense, "q", [F.desc("score"), F.asc("chunk_id")], prefetch * k).select("q", F.lit(0).alias("list_no"), "rank", "chunk_id", "score")
    if lexical is not None:
        said = lexical.join(inside.select("id"), "id", "left_semi").orderBy(F.desc("bm25"), "id").limit(prefetch * k).select(F.col("id").cast("string").alias("chunk_id"), "bm25", F.lit(1).alias("q"))
        lists = lists.unionByName(retrieval.first_rows(said, "q", [F.desc("bm25"), F.asc("chunk_id")], prefetch * k).select("q", F.lit(1).alias("list_no"), "rank", "chunk_id", F.lit(None).cast("double").alias("score")))
    best = retrieval.fuse(lists, "q", "chunk_id").filter(F.col("position") <= k).select(F.col("chunk_id").alias("_id"), "score", "position")
    hits = inside.withColumn("_id", F.col("id").cast("string")).drop("score").join(best, "_id")
    shown = rows(hits.select("id", "payload", "score"))
    return shown.join(best.select(F.col("_id").alias("chunk_id"), "position"), "chunk_id").orderBy("position")
