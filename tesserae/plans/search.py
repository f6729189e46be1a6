"""The whole search: route, plan, channels, fusion, quality, diversity, rerank, focus, grade and one retry."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import tokens
from tesserae.operators import lexical, quality, retrieval
from tesserae.operators.embed import Hashing, Provider, contract
from tesserae.plans import routing

#: Words a weak answer is asked again with.
RETRY = {"normative": "требования нормы пункт", "project": "спецификация ведомость чертёж"}
EMPTY = "chunk_id string, doc_id string, text string, child_text string, source_path string, file_name string, context_source string, score double, position int"


@dataclass
class Answer:
    """rows, and how they came about; blocked is not empty."""

    rows: DataFrame | None
    grade: str
    reason: str
    trace: dict = field(default_factory=dict)
    blocked: str | None = None


@dataclass
class Corpus:
    """What is searched: chunks (with vectors) and parents. manifest says what the vectors were made with;
    with written postings a question reads its own terms only."""

    chunks: DataFrame
    parents: DataFrame
    manifest: dict = field(default_factory=dict)
    lexical: lexical.LexicalIndex | None = None


def scope_of(folder: str | None, dataset: str | None) -> Column:
    """Applied before any scoring. A folder is matched literally."""
    s = F.lit(True)
    if folder:
        s = s & F.col("source_path").contains(folder)
    if dataset:
        s = s & ((F.col("namespace") == dataset) | F.col("namespace").isNull())
    return s


def _one(corpus: Corpus, q: str, plan: routing.Plan, provider: Provider, scope: Column, no: int) -> list[DataFrame]:
    """The ranked lists of one subquery, each of at most the pool's size: (q, list_no, rank, chunk_id, score)."""
    base = corpus.chunks.filter(scope)
    pool = plan.pool
    dense = retrieval.dense_topk(base.select("chunk_id", "vector"), provider.query(q), pool)
    said = " ".join(quality.query_words(q)) or q
    if corpus.lexical is None:
        bm = lexical.bm25_stemmed(base, "chunk_id", "text", said)
    else:
        # the postings of the question's terms only, of chunks in scope
        bm = corpus.lexical.search(said).join(base.select("chunk_id"), "chunk_id", "left_semi")
    bm = bm.orderBy(F.desc("bm25"), "chunk_id").limit(pool)
    both = dense.select("chunk_id", "score").join(bm, "chunk_id", "full_outer").withColumn("q", F.lit(1))
    fused = retrieval.combine(both.withColumnRenamed("score", "_d"), "q", F.col("_d"), F.col("bm25"), plan.alpha)
    return [retrieval.first_rows(fused, "q", [F.desc("score"), F.asc("chunk_id")], pool).select("q", F.lit(no).alias("list_no"), "rank", "chunk_id", "score")]


def _attempt(corpus: Corpus, question: str, plan: routing.Plan, provider: Provider, top_k: int, rerank: bool | None, scorer) -> tuple[DataFrame, dict]:
    scope = scope_of(plan.route.folder, plan.route.dataset)
    lists = [x for n, q in enumerate(plan.queries) for x in _one(corpus, q, plan, provider, scope, n)]
    if plan.codes:
        e = retrieval.exact_channel(corpus.chunks.filter(scope), list(plan.codes), provider.query(question), plan.pool).withColumn("q", F.lit(1))
        lists.append(retrieval.first_rows(e, "q", [F.desc("exact_hits"), F.desc("score"), F.asc("chunk_id")], plan.pool).select("q", F.lit(90).alias("list_no"), "rank", "chunk_id", "score"))
    if "named_norm" in plan.channels:
        named = corpus.chunks
        match = F.lit(False)
        for n in plan.norms:
            match = match | F.lower("source_path").contains(n.split(" ")[-1].lower())
        d = retrieval.dense_topk(named.select("chunk_id", "vector", "source_path"), provider.query(question), 12, scope=match).withColumn("q", F.lit(1))
        lists.append(retrieval.first_rows(d, "q", [F.desc("score"), F.asc("chunk_id")], 12).select("q", F.lit(91).alias("list_no"), "rank", "chunk_id", "score"))
    every = lists[0]
    for x in lists[1:]:
        every = every.unionByName(x)
    fused = retrieval.fuse(every, "q", "chunk_id").filter(F.col("position") <= plan.pool)
    # the pool is a few dozen rows: it is the small side of every join from here on
    cols = ["chunk_id", "doc_id", "text", "source_path", "file_name", "parent_id", "modified_at"]
    pool = corpus.chunks.select(*cols).join(fused, "chunk_id")
    pool = retrieval.hydrate(pool, corpus.parents)
    q = quality.quality(pool, question, list(plan.codes), F.col("text"), F.concat_ws(" ", "file_name", "source_path"), F.col("score"), F.lit(plan.route.dataset), F.col("file_name"))
    q = q.drop("rank")
    ranked = retrieval.first_rows(q, "q", [F.desc("exact_hits"), F.desc("score"), F.desc("lexical_bonus"), F.desc("path_bonus"), F.asc("position"), F.asc("chunk_id")], plan.pool)
    # a pool is a few dozen rows: chosen in order, as a prefix counts only where its row is taken
    chosen = retrieval.diversify_exact(ranked.drop("position"), "q", "doc_id", 4 * top_k)
    diverse = retrieval.first_rows(chosen.withColumnRenamed("rank", "_rank"), "q", [F.asc("_rank")], 4 * top_k).drop("_rank")
    if rerank is not None:
        apply, why = rerank, "asked"
    elif len(plan.queries) > 1:
        apply, why = True, "several_queries"
    else:
        # one row, of the pool's best scores
        verdict = retrieval.rerank_decision(diverse.select("q", "rank", "score"), "q", top_k).first()
        apply, why = (bool(verdict["apply"]), verdict["reason"]) if verdict else (False, "empty")
    final = diverse
    if apply:
        logits = retrieval.rerank(diverse.withColumn("query_text", F.lit(question)), scorer).select("q", "rank", "logit")
        final = retrieval.apply_rerank(diverse, "q", logits).drop("rank").withColumnRenamed("position", "rank").drop("rerank_score", "logit")
        final = final.filter(F.col("rank") <= top_k)
    head = retrieval.focus(final, "q", "doc_id").filter(F.col("rank") <= 4 * top_k)
    rows = retrieval.fill(head, final, "q", "chunk_id", top_k)
    trace = {"route": plan.route.name, "queries": list(plan.queries), "channels": list(plan.channels), "fusion": "rrf", "score_kind": "quality", "rerank": bool(apply), "rerank_reason": why, "degraded": False}
    return rows.select("chunk_id", "doc_id", "text", "child_text", "source_path", "file_name", "context_source", "score", "position"), trace


def search_documents(corpus: Corpus, question: str, top_k: int = 8, dataset: str | None = None, folder: str | None = None, provider: Provider | None = None, rerank: bool | None = None, scorer=retrieval.overlap_scorer, retry: bool = True) -> Answer:
    """The answer to one question. The result is cut to top_k (1..20) rows and read once to be graded.

    A provider that doesn't fit the index blocks the search instead of answering wrongly. A weak answer
    is asked once more with the route's words; the better one stays.
    """
    provider = provider or Hashing(64)
    if corpus.manifest and (why := contract(provider, corpus.manifest)):
        return Answer(None, "blocked", "embedding_contract", {}, why)
    top_k = max(1, min(20, top_k))
    spark = corpus.chunks.sparkSession

    def attempt(text: str) -> tuple[list, str, str, bool, dict]:
        plan = routing.plan(text, top_k, dataset, folder)
        rows, trace = _attempt(corpus, text, plan, provider, top_k, rerank, scorer)
        got = rows.collect()  # at most twenty rows
        top = max((r["score"] for r in got), default=None)
        v = spark.range(1).select(retrieval.grade(F.lit(top).cast("double"), F.lit(len(got))).alias("v")).first()["v"]
        return got, v["grade"], v["reason"], v["retry"], trace

    got, g, why, again, trace = attempt(question)
    if again and retry:
        more = RETRY.get(routing.plan(question, top_k, dataset, folder).route.dataset or "", "")
        if more:
            second = attempt(f"{question} {more}")
            best = lambda rows: max((r["score"] for r in rows), default=-1.0)
            if best(second[0]) > best(got):
                got, g, why, _, trace = second
            trace["retried"] = True
    return Answer(spark.createDataFrame([tuple(r) for r in got], EMPTY), g, why, trace)
