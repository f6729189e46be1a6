"""Retrieval operators over ranked candidates. All work on many queries at once: q names the query's column.

Ties end in an identifier, so every order is total. Candidate lists are small per query; per-query
windows keep only their first rows per task before the shuffle wherever a rank is bounded.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import collapsed, contains_whole, retrieval_identity
from tesserae.functions.vectors import score

#: Longest context handed on, in characters.
CONTEXT = 6000


def dense_topk(chunks: DataFrame, query: list[float], k: int, metric: str = "cosine", scope: Column | None = None) -> DataFrame:
    """The k chunks closest to a query with score = max(0, 1 - distance); scope is applied before the scoring.

    Chunks without a comparable vector are no candidates. Needs chunk_id and vector. Repeated rows of a
    chunk are one: they are dropped behind the scoring, when only slim rows are left to shuffle.
    """
    rows = chunks if scope is None else chunks.filter(scope)
    s = score(F.col("vector"), query, metric)
    got = rows.withColumn("_s", s).filter("_s is not null")
    distance = F.col("_s") if metric == "l2" else 1 - F.col("_s")
    return got.withColumn("distance", distance).withColumn("score", F.greatest(F.lit(0.0), 1 - F.col("distance"))).drop("_s", "vector").dropDuplicates(["chunk_id"]).orderBy(F.asc("distance"), "chunk_id").limit(k)


def first_rows(rows: DataFrame, q: str, order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each query with their rank."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(q).orderBy(*order))).filter(F.col(name) <= k)


def fuse(lists: DataFrame, q: str, key: str) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (q, list_no, rank, key, score).

    rrf = sum of 1 / (60 + rank); the score is the best one plus at most 0.08 of twice the rrf. A
    missing score counts as 0; ties of the rounding go up. position follows rrf, then the best score, then first appearance.
    """
    g = lists.groupBy(q, key).agg(
        F.sum(1.0 / (60 + F.col("rank"))).alias("rrf"), F.max(F.coalesce("score", F.lit(0.0))).alias("base"),
        F.count_distinct("list_no").alias("matched_queries"), F.min(F.struct("list_no", "rank")).alias("_first"),
    )
    order = Window.partitionBy(q).orderBy(F.desc(F.round("rrf", 12)), F.desc("base"), "_first", key)
    return g.select(q, key, F.round("rrf", 6).alias("rrf"), F.round(F.col("base") + F.least(F.lit(0.08), 2 * F.col("rrf")) + 1e-9, 4).alias("score"), "matched_queries", F.row_number().over(order).alias("position"))


def combine(hits: DataFrame, q: str, dense: Column, lexical: Column, alpha: float = 0.7) -> DataFrame:
    """Weighted sum of two channels; the lexical one is scaled to 0..1 within its query, a missing channel is 0."""
    w = Window.partitionBy(q)
    lo, hi = F.min(lexical).over(w), F.max(lexical).over(w)
    scaled = F.when(hi > lo, (lexical - lo) / (hi - lo)).otherwise(F.when(lexical.isNotNull(), F.lit(1.0)))
    return hits.withColumn("score", alpha * F.coalesce(dense, F.lit(0.0)) + (1 - alpha) * F.coalesce(scaled, F.lit(0.0))).withColumn("score_kind", F.lit("linear_combination"))


def exact_channel(chunks: DataFrame, codes: list[str], query: list[float] | None = None, k: int | None = None) -> DataFrame:
    """Chunks that hold one of the codes as a whole, those with more codes first, then by cosine.

    A plain substring test, which reaches the scan, goes before the whole-token test.
    """
    any_of = F.lit(False)
    for c in codes:
        any_of = any_of | F.col("text").contains(c)
    hits = sum((contains_whole(F.col("text"), c).cast("int") for c in codes), F.lit(0))
    rows = chunks.filter(any_of).withColumn("exact_hits", hits).filter("exact_hits > 0")
    sim = score(F.col("vector"), query) if query else F.lit(None).cast("double")
    rows = rows.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(sim, F.lit(0.0))))).drop("vector")
    rows = rows.dropDuplicates(["chunk_id"]).orderBy(F.desc("exact_hits"), F.desc("score"), "chunk_id")
    return rows if k is None else rows.limit(k)


def occurrences(chunks: DataFrame, needle: str, text: str = "text") -> DataFrame:
    """All rows that hold a token as a whole, whatever its case, with a snippet of 160 characters around it.

    A needle of fewer than three characters is an error.
    """
    if len(needle.strip()) < 3:
        raise ValueError("a needle has at least three characters")
    n = needle.strip()
    rows = chunks.filter(F.lower(text).contains(n.lower()) & contains_whole(F.col(text), n))
    at = F.instr(F.lower(text), n.lower())
    begin = F.greatest(F.lit(1), at - 60)
    piece = F.substring(F.col(text), begin, F.lit(160))
    snippet = F.concat(F.when(begin > 1, F.lit("…")).otherwise(F.lit("")), piece, F.when(begin + 160 <= F.length(text), F.lit("…")).otherwise(F.lit("")))
    return rows.withColumn("snippet", snippet)


def page(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """One page of a total order."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def hydrate(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Child hits with their parent's text as context, else their own; cut at ``CONTEXT`` characters and marked so.

    hits need parent_id and text; parents are one row a parent_id.
    """
    p = parents.filter("parent_id is not null").select("parent_id", "parent_text").dropDuplicates(["parent_id"])
    rows = hits.join(p, "parent_id", "left")
    have = F.length(F.coalesce("parent_text", F.lit(""))) > 0
    full = F.when(have, F.col("parent_text")).otherwise(F.coalesce("text", F.lit("")))
    source = F.concat(F.when(have, F.lit("parent")).otherwise(F.lit("child")), F.when(F.length(full) > CONTEXT, F.lit("_truncated")).otherwise(F.lit("")))
    return rows.withColumns({"context_source": source, "context_chars": F.least(F.length(full), F.lit(CONTEXT)), "child_text": F.col("text"), "text": F.substring(full, 1, CONTEXT)}).drop("parent_text")


def newest_issue(files: DataFrame, path: str = "source_path") -> DataFrame:
    """Rows of the newest issue of each document: greatest (modified_at as text, missing least; issue number)."""
    issue = F.coalesce(F.regexp_extract(path, r"-(\d{2})[\s_]*(?:\(\d+\))?\.[A-Za-z]+$", 1).try_cast("int"), F.lit(0))
    rank = F.struct(F.coalesce("modified_at", F.lit("")).alias("m"), issue.alias("i"))
    doc = retrieval_identity(F.col(path))
    rows = files.withColumn("_doc", doc).withColumn("_issue", rank)
    return rows.withColumn("_top", F.max("_issue").over(Window.partitionBy("_doc"))).filter("_issue = _top").withColumnRenamed("_doc", "document").drop("_issue", "_top")


def diversify(rows: DataFrame, q: str, doc: str, k: int, per_doc: int = 2, prefix: int = 260) -> DataFrame:
    """At most per_doc rows of a document and one of a text prefix, k of each query, by windows.

    A prefix shared by two documents counts for the first row that holds it even if that row falls to the document's bound; see diversify_exact.
    """
    r = rows.withColumn("_t", F.substring(collapsed(F.col("text")), 1, prefix))
    r = r.withColumn("_n", F.row_number().over(Window.partitionBy(q, "_t").orderBy("rank"))).filter("_n = 1")
    r = r.withColumn("_d", F.row_number().over(Window.partitionBy(q, doc).orderBy("rank"))).filter(F.col("_d") <= per_doc)
    return first_rows(r.drop("_t", "_n", "_d"), q, [F.asc("rank")], k, "position")


def diversify_exact(rows: DataFrame, q: str, doc: str, k: int, per_doc: int = 2, prefix: int = 260) -> DataFrame:
    """As diversify, but a prefix is taken only by a row that is chosen: one pass over a query's pool in order.

    Pools are candidate lists of bounded length (at most a few hundred rows a query).
    """

    def choose(pool: pd.DataFrame) -> pd.DataFrame:
        seen, per, out = set(), {}, []
        for i, r in enumerate(pool.sort_values("rank").itertuples(index=False)):
            text = " ".join((getattr(r, "text") or "").lower().split())[:prefix]
            d = getattr(r, doc)
            if text in seen or per.get(d, 0) >= per_doc:
                continue
            seen.add(text)
            per[d] = per.get(d, 0) + 1
            out.append(r)
            if len(out) == k:
                break
        return pd.DataFrame(out, columns=pool.columns)

    return rows.groupBy(q).applyInPandas(choose, rows.schema)


def focus(rows: DataFrame, q: str, doc: str, least: float = 0.30, most_docs: int = 3) -> DataFrame:
    """The rows of the best few documents of each query; rows below least fall away unless all are."""
    w = Window.partitionBy(q)
    kept = rows.withColumn("_any", F.max((F.col("score") >= least).cast("int")).over(w)).filter(F.col("score").isNotNull() & ((F.col("_any") == 0) | (F.col("score") >= least))).drop("_any")
    docs = kept.groupBy(q, doc).agg(F.max("score").alias("_best"), F.min("rank").alias("_pos"))
    docs = first_rows(docs, q, [F.desc("_best"), F.asc("_pos")], most_docs, "_n")
    return kept.join(docs.select(q, doc), [q, doc], "left_semi")


def fill(head: DataFrame, pool: DataFrame, q: str, key: str, k: int) -> DataFrame:
    """The head, filled up from the pool to k rows of each query, each key once."""
    both = head.withColumn("_seg", F.lit(0)).unionByName(pool.withColumn("_seg", F.lit(1)))
    one = both.withColumn("_n", F.row_number().over(Window.partitionBy(q, key).orderBy("_seg", "rank"))).filter("_n = 1")
    return first_rows(one, q, [F.asc("_seg"), F.asc("rank")], k, "position").drop("_seg", "_n")


def apply_rerank(rows: DataFrame, q: str, logits: DataFrame) -> DataFrame:
    """Rows in the order of their logits, those without one last in their old order; the logistic of a logit is shown."""
    r = rows.join(logits, [q, "rank"], "left")
    order = Window.partitionBy(q).orderBy(F.col("logit").desc_nulls_last(), F.asc("rank"))
    return r.withColumn("rerank_score", F.round(1 / (1 + F.exp(-F.col("logit"))), 4)).withColumn("position", F.row_number().over(order))


def rerank(rows: DataFrame, scorer, text: str = "text", first: int = 64) -> DataFrame:
    """Score the first rows of each query by a scorer(query texts, texts) -> logits in Arrow batches; needs query_text."""

    @F.pandas_udf("double")
    def logit(qs: pd.Series, ts: pd.Series) -> pd.Series:
        return pd.Series(scorer(qs.tolist(), ts.tolist()), dtype=float)

    return rows.withColumn("logit", F.when(F.col("rank") <= first, logit(F.col("query_text"), F.col(text))))


def overlap_scorer(queries: list[str], texts: list[str]) -> list[float]:
    """The deterministic default scorer: log odds of the share of query words in the text."""
    import math
    import re

    out = []
    for q, t in zip(queries, texts):
        words = set(re.findall(r"\w+", (q or "").lower()))
        have = set(re.findall(r"\w+", (t or "").lower()))
        p = (len(words & have) + 0.5) / (len(words) + 1)
        out.append(math.log(p / (1 - p)) if p < 1 else 5.0)
    return out


def grade(top: Column, rows: Column, marker_missing: Column | None = None) -> Column:
    """The verdict on a result by its best score: struct(grade, reason, retry)."""
    def verdict(g: str, why: str, retry: bool) -> Column:
        return F.struct(F.lit(g).alias("grade"), F.lit(why).alias("reason"), F.lit(retry).alias("retry"))

    missing = F.coalesce(marker_missing, F.lit(False)) if marker_missing is not None else F.lit(False)
    t = F.coalesce(top, F.lit(0.0))
    return (
        F.when(F.coalesce(rows, F.lit(0)) == 0, verdict("incorrect", "empty", True))
        .when(missing, verdict("incorrect", "project_folder_marker_absent", True))
        .when(t >= 0.55, verdict("correct", "strong_top_score", False))
        .when(t >= 0.35, verdict("ambiguous", "moderate_top_score", True))
        .otherwise(verdict("incorrect", "weak_top_score", True))
    )


def rerank_decision(pool: DataFrame, q: str, k: int) -> DataFrame:
    """(q, apply, reason) of scored pools (rank, score), for single plain queries with automatic reranking."""
    g = pool.groupBy(q).agg(F.count("*").alias("n"), F.max(F.when(F.col("rank") <= k, F.col("score"))).alias("best"), F.min_by("score", "rank").alias("first"), F.max_by("score", F.when(F.col("rank") <= k, F.col("rank"))).alias("last"))
    reason = (
        F.when(F.col("n") <= k, "too_few_candidates").when(F.col("best") < 0.45, "weak_scores")
        .when((F.col("first") - F.col("last") < 0.04) & (F.col("first") < 0.70), "ambiguous_scores").otherwise("not_needed")
    )
    return g.select(q, reason.alias("reason")).withColumn("apply", F.col("reason").isin("weak_scores", "ambiguous_scores"))


def cache_lookup(cache: DataFrame, text: str, query: list[float], scope: str, now: Column, newest: int = 500, least: float = 0.94) -> DataFrame:
    """The best cached entry of a scope: an equal question counts 1, else the cosine; the newest of equals wins."""
    live = cache.filter(F.col("scope") == scope).filter(F.col("created_at") <= now).orderBy(F.desc("created_at"), F.desc("id")).limit(newest)
    sim = F.when(collapsed(F.col("question")) == " ".join(text.lower().split()), F.lit(1.0)).otherwise(score(F.col("vector"), query))
    return live.withColumn("similarity", sim).filter(F.col("similarity") >= least).orderBy(F.desc(F.round("similarity", 9)), F.desc("created_at"), F.desc("id")).limit(1)


def cache_keep(cache: DataFrame, now: Column, days: int = 14, most: int = 500) -> DataFrame:
    """The entries that stay: younger than the time to live, the newest ones."""
    fresh = cache.filter(F.col("created_at") >= now - F.expr(f"interval {days} days"))
    return fresh.orderBy(F.desc("created_at"), F.desc("id")).limit(most)


def maxsim(pages: DataFrame, tokens: DataFrame, page_key: str) -> DataFrame:
    """Late interaction: the mean over query vectors of the best cosine to a page's vectors.

    tokens (i, qv) are the few vectors of one query; pages are any number of (page_key, vector).
    """
    vectors = [(r["i"], list(r["qv"])) for r in tokens.select("i", "qv").collect()]
    best = [F.max(score(F.col("vector"), v)).alias(f"_b{n}") for n, (_, v) in enumerate(vectors)]
    g = pages.groupBy(page_key).agg(*best)
    mean = sum((F.col(f"_b{n}") for n in range(len(vectors))), F.lit(0.0)) / len(vectors)
    return g.select(page_key, mean.alias("maxsim")).filter("maxsim is not null")


def merge_traces(traces: DataFrame, q: str) -> DataFrame:
    """One trace of several: channels in order of first use, degraded if any is, counts summed."""
    g = traces.groupBy(q).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("no", "channel"))), lambda x: x["channel"]).alias("c"),
        F.bool_or("degraded").alias("degraded"), F.sum("candidates").alias("candidates"),
    )
    return g.select(q, F.array_join(F.array_distinct("c"), ",").alias("channels"), "degraded", "candidates")

