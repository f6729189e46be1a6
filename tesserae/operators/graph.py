"""The graph of documents: centroids, edges and neighbours."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import document_id
from tesserae.functions.vectors import centroid, cosine, matrix
from tesserae.session import checkpoint

#: Centroids and chunks that meet in one task; it never changes a result.
CENTRES, CHUNKS = 32_768, 16_384


def centroids(chunks: DataFrame, dim: int, key: str = "doc_id") -> DataFrame:
    """(key, chunks, centroid) of documents that have a vector."""
    return chunks.filter(F.size("vector") == dim).groupBy(key).agg(F.count("*").alias("chunks"), centroid(F.col("vector"), dim).alias("centroid"))


def build_edges(chunks: DataFrame, dim: int, k: int) -> DataFrame:
    """(doc_id_a, doc_id_b, similarity): the k closest other documents of each document, every pair both ways.

    A document is as close as its chunk closest to the other's centroid: max(0, cosine), of nine
    digits; ties end in the document. All centroids meet all chunks of other documents, so no crowd
    of near chunks of one document hides the others. Chunks without a comparable vector, and
    centroids that are zero, have no neighbours.
    """
    c = chunks.filter("doc_id is not null")
    centres = checkpoint(centroids(c, dim)).select(F.col("doc_id").alias("who"), "chunks", "centroid")
    c = c.filter(F.size("vector") == dim)
    m, n = (max(1, math.ceil(x.count() / most)) for x, most in ((centres, CENTRES), (c, CHUNKS)))
    block = lambda x, of: F.pmod(F.xxhash64(x), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = centres.select("who", "centroid", block("who", m).alias("_a")).select("*", every(n).alias("_b"))
    # a document's chunks stand together, so that each task ranks few documents; only large ones are spread
    home = F.when(F.col("chunks") * 8 > CHUNKS, block("vector", n)).otherwise(block("doc_id", n))
    right = c.join(centres.select("who", "chunks"), F.col("doc_id") == F.col("who")).select("doc_id", "vector", home.alias("_b")).select("*", every(m).alias("_a"))

    def units(t: pa.Table, key: str, column: str) -> tuple[np.ndarray, np.ndarray]:
        x, rows = matrix(t[column].combine_chunks(), dim)
        size = np.linalg.norm(x, axis=1)
        return x[size > 0] / size[size > 0, None], np.array(t[key].to_pylist(), object)[rows[size > 0]]

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        q, who = units(left, "who", "centroid") if left.num_rows else (np.zeros((0, dim)), np.zeros(0, object))
        x, of = units(right, "doc_id", "vector") if right.num_rows else (np.zeros((0, dim)), np.zeros(0, object))
        out: list[list] = [[], [], []]
        if len(q) and len(x):
            docs, code = np.unique(of.astype(str), return_inverse=True)
            order = np.argsort(code, kind="stable")
            x, start = x[order], np.searchsorted(code[order], np.arange(len(docs)))
            place = {d: i for i, d in enumerate(docs.tolist())}
            own = np.array([place.get(d, -1) for d in who.tolist()])
            rows = max(1, 8_000_000 // len(x))
            for at in range(0, len(q), rows):
                best = np.round(np.maximum.reduceat(q[at : at + rows] @ x.T, start, axis=1), 9)
                mine = np.flatnonzero(own[at : at + rows] >= 0)
                best[mine, own[at : at + rows][mine]] = -np.inf
                worst = np.partition(best, -k, axis=1)[:, -k] if len(docs) > k else np.full(len(best), -2.0)
                i, j = np.nonzero((best >= worst[:, None]) & (best > -2))
                order = np.lexsort((j, -best[i, j], i))
                i, j = i[order], j[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                out[0] += who[at + i[keep]].tolist()
                out[1] += docs[j[keep]].tolist()
                out[2] += best[i[keep], j[keep]].tolist()
        return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], ["doc_id_a", "doc_id_b", "similarity"])

    met = left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInArrow(nearest, "doc_id_a string, doc_id_b string, similarity double")
    best = checkpoint(top_edges(met.groupBy("doc_id_a", "doc_id_b").agg(F.max("similarity").alias("similarity")), k))
    return both_ways(best.withColumn("similarity", F.greatest(F.lit(0.0), "similarity")))


def both_ways(edges: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b, similarity) in both directions, the best known similarity of a pair; no loops, no nulls."""
    e = edges.filter("doc_id_a is not null and doc_id_b is not null and similarity is not null and doc_id_a <> doc_id_b").select("doc_id_a", "doc_id_b", "similarity")
    back = e.select(F.col("doc_id_b").alias("doc_id_a"), F.col("doc_id_a").alias("doc_id_b"), "similarity")
    return e.union(back).groupBy("doc_id_a", "doc_id_b").agg(F.max("similarity").alias("similarity"))


def top_edges(edges: DataFrame, k: int) -> DataFrame:
    """The k most similar neighbours of each document."""
    w = Window.partitionBy("doc_id_a").orderBy(F.desc("similarity"), "doc_id_b")
    return edges.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def neighbours(edges: DataFrame, files: DataFrame, k: int) -> DataFrame:
    """The neighbours of every document with their file names where the catalog knows them."""
    names = files.filter("source_path is not null").select(document_id(F.col("source_path")).alias("doc_id_b"), "source_path").groupBy("doc_id_b").agg(F.min("source_path").alias("source_path"))
    return top_edges(both_ways(edges), k).join(names, "doc_id_b", "left").select("doc_id_a", "doc_id_b", "rank", "similarity", "source_path")


def measured(edges: DataFrame, centres: DataFrame) -> DataFrame:
    """Pairs of an edge list with the cosine of their centroids now."""
    p = edges.select(F.least("doc_id_a", "doc_id_b").alias("doc_id_a"), F.greatest("doc_id_a", "doc_id_b").alias("doc_id_b")).filter("doc_id_a < doc_id_b").distinct()
    a = centres.select(F.col("doc_id").alias("doc_id_a"), F.col("centroid").alias("_a"))
    b = centres.select(F.col("doc_id").alias("doc_id_b"), F.col("centroid").alias("_b"))
    return p.join(a, "doc_id_a").join(b, "doc_id_b").select("doc_id_a", "doc_id_b", cosine(F.col("_a"), F.col("_b")).alias("similarity"))


def stats(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("edges"), F.count_distinct("doc_id_a").alias("documents"))
