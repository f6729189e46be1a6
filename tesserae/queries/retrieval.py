"""Retrieval queries over documents_64, parent_chunks, search_hits, documents and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.functions.vectors import score
from tesserae.operators import lexical, quality, retrieval
from tesserae.session import load

CODE = "R.D7.31.757"
QUERY = "предел огнестойкости воздуховод допускается"
WORDS = ["клапан", "резервом", "расход", "чиллер"]


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunk table, each chunk once."""
    return raw_chunks(spark, d).dropDuplicates(["chunk_id"])


def raw_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunk table as it is; a filter or score goes before the repeated rows are dropped."""
    return load(spark, d, "documents_64").filter("chunk_id is not null")


_written: dict[tuple, lexical.LexicalIndex] = {}


def lexical_index(spark: SparkSession, d: str, table: str, key: str, text: str, stemmed: bool = True) -> lexical.LexicalIndex:
    """The written postings of a table, built once for an application, as indexing would."""
    at = (spark.sparkContext.applicationId, d, table, stemmed)
    if at not in _written:
        docs = load(spark, d, table).filter(F.col(key).isNotNull())
        docs = docs.dropDuplicates([key]) if table == "parent_chunks" else docs
        _written[at] = lexical.LexicalIndex.build(docs.select(key, text), key, text, stemmed=stemmed)
    return _written[at]


def first_vector(spark: SparkSession, d: str) -> list[float]:
    """The query vector of these queries: that of the least chunk id."""
    row = load(spark, d, "documents_64").filter("vector is not null and chunk_id is not null").orderBy("chunk_id").select("vector").first()
    return list(row[0]) if row else [1.0]


def dense_topk(spark, d):
    return retrieval.dense_topk(raw_chunks(spark, d).select("chunk_id", "vector", "source_path"), first_vector(spark, d), 20).select("chunk_id", "source_path", F.round("score", 6).alias("score"))


def dense_l2_topk(spark, d):
    return retrieval.dense_topk(raw_chunks(spark, d).select("chunk_id", "vector"), first_vector(spark, d), 20, "l2").select("chunk_id", F.round("distance", 6).alias("distance"))


def dense_scoped_prefilter(spark, d):
    scope = (F.col("namespace") == "project") & F.col("source_path").contains("ОВ1")
    return retrieval.dense_topk(raw_chunks(spark, d).select("chunk_id", "vector", "source_path", "namespace"), first_vector(spark, d), 20, scope=scope).select("chunk_id", F.round("score", 6).alias("score"))


def cosine_l2_scores(spark, d):
    q = first_vector(spark, d)
    c = raw_chunks(spark, d).select("chunk_id", F.round(score(F.col("vector"), q), 5).alias("cosine"), F.round(score(F.col("vector"), q, "l2"), 5).alias("l2"))
    return c.filter("l2 is not null and cosine is not null").dropDuplicates(["chunk_id"])


def _ranked_texts(r: DataFrame) -> DataFrame:
    return r.select("doc_id", F.round("bm25", 4).alias("bm25")).orderBy(F.desc("bm25"), "doc_id").limit(50)


def bm25_search(spark, d):
    return _ranked_texts(lexical_index(spark, d, "documents", "doc_id", "text").search(" ".join(WORDS)))


def bm25_plain(spark, d):
    return _ranked_texts(lexical_index(spark, d, "documents", "doc_id", "text", stemmed=False).search(" ".join(WORDS)))


def bm25_unindexed(spark, d):
    return _ranked_texts(lexical.bm25_stemmed(load(spark, d, "documents"), "doc_id", "text", " ".join(WORDS)))


def bm25_sparse_terms(spark, d):
    return lexical_index(spark, d, "parent_chunks", "parent_id", "parent_text").vectors()


def _best_hits(spark, d):
    h = load(spark, d, "search_hits").filter("chunk_id is not null")
    return h.groupBy("query_id", "chunk_id").agg(F.min("_distance").alias("_distance"), F.max("_relevance_score").alias("_relevance_score"), F.max("score").alias("score"))


def linear_fusion(spark, d):
    h = _best_hits(spark, d).withColumn("_dense", F.greatest(F.lit(0.0), 1 - F.col("_distance"))).drop("score")
    r = retrieval.combine(h, "query_id", F.when(F.col("_distance").isNotNull(), F.col("_dense")), F.col("_relevance_score"))
    return r.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def rrf_fusion(spark, d):
    h = _best_hits(spark, d)
    lists = None
    for n, (c, up) in enumerate((("_distance", False), ("_relevance_score", True), ("score", True))):
        one = h.filter(F.col(c).isNotNull())
        one = retrieval.first_rows(one, "query_id", [F.desc(c) if up else F.asc(c), F.asc("chunk_id")], 20)
        one = one.select("query_id", F.lit(n).alias("list_no"), "rank", "chunk_id", "score")
        lists = one if lists is None else lists.unionByName(one)
    return retrieval.fuse(lists, "query_id", "chunk_id").select("query_id", "chunk_id", "rrf", "score", "matched_queries")


def exact_channel(spark, d):
    return retrieval.exact_channel(raw_chunks(spark, d).select("chunk_id", "text", "vector"), [CODE[:4], "НТД"], first_vector(spark, d)).select("chunk_id", F.col("exact_hits").cast("long").alias("exact_hits"), F.round("score", 6).alias("score"))


def find_occurrences(spark, d):
    r = retrieval.occurrences(load(spark, d, "documents").filter("doc_id is not null"), "чиллер")
    return r.select("doc_id", "file_name", "snippet")


def occurrences_by_document(spark, d):
    r = retrieval.occurrences(load(spark, d, "documents"), "чиллер")
    return r.groupBy("source").agg(F.count("*").alias("matches"), F.count_distinct("file_name").alias("files"))


def occurrences_page(spark, d):
    r = retrieval.occurrences(load(spark, d, "documents"), "чиллер").select("source", "doc_id")
    return retrieval.page(r.filter("source is not null"), ["source", "doc_id"], 20, 10)


def identifier_tokens(spark, d):
    return load(spark, d, "documents").select("doc_id", F.explode(T.identifiers(F.col("text"))).alias("identifier"))


def norm_designations(spark, d):
    return load(spark, d, "documents").select("doc_id", F.explode(T.norm_designations(F.col("text"))).alias("designation"))


def _ranked(spark, d):
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "chunk_id")
    return _best_hits(spark, d).withColumn("rank", F.row_number().over(w))


def parent_hydration(spark, d):
    h = _ranked(spark, d).select("query_id", "chunk_id", "rank").join(chunks(spark, d).select("chunk_id", "parent_id", "text"), "chunk_id")
    p = load(spark, d, "parent_chunks")
    return retrieval.hydrate(h, p).select("query_id", "chunk_id", "context_source", F.col("context_chars").cast("long").alias("context_chars"), F.md5("text").alias("context"))


def dedup_by_parent(spark, d):
    h = _ranked(spark, d).join(chunks(spark, d).select("chunk_id", "parent_id"), "chunk_id").withColumn("key", F.coalesce("parent_id", "chunk_id"))
    w = Window.partitionBy("query_id", "key").orderBy("rank")
    return h.withColumn("n", F.row_number().over(w)).filter("n = 1").select("query_id", "key", "chunk_id")


def _texts(spark, d):
    return load(spark, d, "documents").select("doc_id", "source", "file_name", F.coalesce("text", F.lit("")).alias("text"))


def title_penalty(spark, d):
    return _texts(spark, d).select("doc_id", quality.title_penalty(F.col("text")).alias("penalty"))


def table_noise(spark, d):
    r = _texts(spark, d).select("doc_id", quality.word_shares(F.col("text")).alias("w"))
    return r.select("doc_id", F.round("w.top_share", 6).alias("top_share"), "w.tokens")


def quality_score(spark, d):
    dataset = F.when(F.col("source") == "normative_base", "normative").otherwise("project")
    r = quality.quality(_texts(spark, d), QUERY, ["НТД"], F.col("text"), F.col("file_name"), F.lit(0.5), dataset)
    return r.select("doc_id", "base_score", "lexical_bonus", "substantive_bonus", "path_bonus", F.col("exact_hits").cast("long").alias("exact_hits"), "exact_bonus", "score", "table_penalty")


def lexical_boost(spark, d):
    low, name = F.lower("text"), F.lower(F.coalesce("file_name", F.lit("")))
    words = [w for w in quality.query_words(QUERY) if len(w) >= 4]
    n = sum((low.contains(w).cast("int") for w in words), F.lit(0))
    m = sum((name.contains(w).cast("int") for w in words), F.lit(0))
    return _texts(spark, d).select("doc_id", F.round(F.least(F.lit(1.0), 0.3 + n * 0.12 + m * 0.03), 4).alias("score"))


def _pool(spark, d):
    return _ranked(spark, d).join(chunks(spark, d).select("chunk_id", "doc_id", "text"), "chunk_id")


def diversify_per_doc(spark, d):
    return retrieval.diversify(_pool(spark, d), "query_id", "doc_id", 8).select("query_id", "chunk_id", F.col("position").cast("long").alias("position"))


def diversify_exact(spark, d):
    return retrieval.diversify_exact(_pool(spark, d).select("query_id", "chunk_id", "doc_id", "rank", "text"), "query_id", "doc_id", 8).select("query_id", "chunk_id")


def newest_revision(spark, d):
    from tesserae.operators.incremental import current_files

    return retrieval.newest_issue(current_files(load(spark, d, "files"))).select("document", "source_path")


def source_focus(spark, d):
    return retrieval.focus(_pool(spark, d), "query_id", "doc_id", 0.3, 3).select("query_id", "chunk_id")


def fill_to_top_k(spark, d):
    p = _pool(spark, d).select("query_id", "chunk_id", "doc_id", "rank", "score")
    head = retrieval.focus(p, "query_id", "doc_id", 0.3, 3).filter("rank <= 5")
    return retrieval.fill(head, p, "query_id", "chunk_id", 8).select("query_id", "chunk_id", F.col("position").cast("long").alias("position"))


def rerank_apply(spark, d):
    p = _ranked(spark, d).select("query_id", "chunk_id", "rank", "_distance")
    logits = p.filter("rank <= 10 and _distance is not null").select("query_id", "rank", (2 - F.col("_distance") * 3).alias("logit"))
    return retrieval.apply_rerank(p, "query_id", logits).select("query_id", "chunk_id", F.col("position").cast("long").alias("position"), "rerank_score")


def crag_grade(spark, d):
    g = _best_hits(spark, d).groupBy("query_id").agg(F.max("score").alias("top"), F.count("*").alias("n"))
    v = retrieval.grade(F.col("top") - 0.4, F.col("n"))
    return g.select("query_id", v["grade"].alias("grade"), v["reason"].alias("reason"), v["retry"].alias("retry"))


def rerank_decision(spark, d):
    p = _ranked(spark, d).filter("score is not null").select("query_id", "rank", (F.col("score") - 0.3).alias("score"))
    w = Window.partitionBy("query_id").orderBy("rank")
    return retrieval.rerank_decision(p.withColumn("rank", F.row_number().over(w)), "query_id", 5)


def _cache(spark, d):
    c = chunks(spark, d).filter("vector is not null and created_at is not null")
    return c.select(F.col("chunk_id").alias("id"), F.concat(F.lit("Вопрос "), F.col("chunk_id")).alias("question"), F.coalesce("namespace", F.lit("all")).alias("scope"), "vector", T.instant(F.col("created_at")).alias("created_at")).filter("created_at is not null")


NOW = "2025-02-01 00:00:00"


def semantic_cache_lookup(spark, d):
    """The entry nearest to a question with the newest entry's vector, among the newest of a scope, as the operator has it by default."""
    c = _cache(spark, d)
    newest = c.filter("scope = 'project'").orderBy(F.desc("created_at"), F.desc("id")).select("vector").first()
    r = retrieval.cache_lookup(c, "вопрос  нет", list(newest[0]) if newest else [1.0], "project", F.lit("2100-01-01").cast("timestamp"))
    return r.select("id", F.round("similarity", 6).alias("similarity"))


def cache_evict(spark, d):
    return retrieval.cache_keep(_cache(spark, d), F.lit(NOW).cast("timestamp")).select("id")


def maxsim_late_interaction(spark, d):
    # the best of a document's vectors is the same with a chunk twice
    c = raw_chunks(spark, d).filter("vector is not null").select("doc_id", "chunk_id", "vector")
    few = c.dropDuplicates(["chunk_id"]).orderBy("chunk_id").limit(4).select(F.col("chunk_id").alias("i"), F.col("vector").alias("qv"))
    return retrieval.maxsim(c, few, "doc_id").select("doc_id", F.round("maxsim", 5).alias("maxsim"))


def merge_traces(spark, d):
    h = _best_hits(spark, d)
    no = F.when(F.col("_distance").isNotNull(), 0).when(F.col("_relevance_score").isNotNull(), 1).otherwise(2)
    t = h.select("query_id", no.alias("no"), F.element_at(F.array(F.lit("dense"), F.lit("lexical"), F.lit("exact")), no + 1).alias("channel"), F.col("score").isNull().alias("degraded"), F.lit(1).alias("candidates"))
    return retrieval.merge_traces(t, "query_id")


QUERIES = {
    f.__name__: f
    for f in (
        dense_topk, dense_l2_topk, dense_scoped_prefilter, cosine_l2_scores, bm25_search, bm25_plain, bm25_unindexed, bm25_sparse_terms, linear_fusion, rrf_fusion, exact_channel, find_occurrences, occurrences_by_document,
        occurrences_page, identifier_tokens, norm_designations, parent_hydration, dedup_by_parent, title_penalty, table_noise, quality_score, lexical_boost, diversify_per_doc, diversify_exact,
        newest_revision, source_focus, fill_to_top_k, rerank_apply, crag_grade, rerank_decision, semantic_cache_lookup, cache_evict, maxsim_late_interaction, merge_traces,
    )
}

CH = "(SELECT * FROM documents_64 WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id) = 1)"
Q = "(SELECT vector::DOUBLE[] FROM documents_64 WHERE vector IS NOT NULL AND chunk_id IS NOT NULL ORDER BY chunk_id LIMIT 1)"
LIVE = "vector IS NOT NULL AND list_dot_product(vector::DOUBLE[], vector::DOUBLE[]) > 0"
BEST = "best AS (SELECT query_id, chunk_id, min(_distance) AS _distance, max(_relevance_score) AS _relevance_score, max(score) AS score FROM search_hits WHERE chunk_id IS NOT NULL GROUP BY ALL)"
RANKED = BEST + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, chunk_id) AS rank FROM best)"
POOL = RANKED + f", pool AS (SELECT r.*, c.doc_id, c.parent_id, c.text FROM ranked r JOIN {CH} c USING (chunk_id))"
STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
TOK = f"list_filter(regexp_extract_all(lower(text), '[0-9a-zа-яё]+'), lambda t: len(t) >= 2 AND t NOT IN ({STOP}))"
_stemmed = lambda x: f"CASE WHEN regexp_matches({x}, '^[а-яё]{{4,}}$') THEN CASE " + " ".join(f"WHEN ends_with({x}, '{e}') AND len({x}) >= {len(e) + 4} THEN left({x}, len({x}) - {len(e)})" for e in T.LEXICAL_ENDINGS) + f" ELSE {x} END ELSE {x} END"
LTOK = f"list_transform(list_filter(regexp_extract_all(translate(lower(text), 'ё', 'е'), '[0-9a-zа-я]+(?:[.-][0-9a-zа-я]+)*'), lambda t: len(t) >= 3 AND t NOT IN ({STOP})), lambda t: {_stemmed('t')})"
W = r"\p{L}\p{N}_"


def whole(text: str, token: str) -> str:
    """The whole-token test in a pattern language without look-around."""
    t = "".join(f"\\{c}" if not c.isalnum() and c != "_" else c for c in token)
    return rf"regexp_matches({text}, '(?i)(?:^|[^{W}./-]|(?:^|[^{W}])[./-]){t}(?:$|[^{W}./-]|[./-](?:$|[^{W}]))')"


def _sum_contains(text: str, words) -> str:
    return "(" + " + ".join(f"(contains({text}, '{w}'))::INT" for w in words) + ")"


_words = quality.query_words(QUERY)
_snip = "greatest(1, instr(lower(text), 'чиллер') - 60)"
_occ = f"SELECT * FROM documents WHERE contains(lower(text), 'чиллер') AND {whole('text', 'чиллер')}"
_focus = """, kept AS (SELECT * FROM (SELECT *, max((score >= 0.3)::INT) OVER (PARTITION BY query_id) AS a FROM pool) WHERE score IS NOT NULL AND (a = 0 OR score >= 0.3)),
docs AS (SELECT query_id, doc_id FROM (SELECT query_id, doc_id, max(score) AS best, min(rank) AS pos FROM kept GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY best DESC, pos) <= 3),
focus AS (SELECT k.* FROM kept k SEMI JOIN docs USING (query_id, doc_id))"""
_CACHE = f"cache AS (SELECT chunk_id AS id, coalesce(namespace, 'all') AS scope, vector, try_cast(created_at AS TIMESTAMPTZ) AS created_at FROM {CH} WHERE vector IS NOT NULL AND try_cast(created_at AS TIMESTAMPTZ) IS NOT NULL)"
_stem = r"lower(regexp_replace(regexp_extract(source_path, '[^\\/]*$'), '\.[A-Za-z][A-Za-z0-9]{0,4}$', ''))"
_nocopy = rf"regexp_replace({_stem}, '[\s_]*\(\d+\)$', '')"
_retr = rf"CASE WHEN regexp_matches({_nocopy}, '\d\.\d') THEN regexp_replace({_nocopy}, '([\d)])-\d{{2}}$', '\1') ELSE {_nocopy} END"
_CUR = "cur AS (SELECT * FROM files WHERE source_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY try_cast(indexed_at AS TIMESTAMPTZ) DESC NULLS LAST) = 1)"

SQL = {
    "dense_topk": f"SELECT chunk_id, source_path, round(greatest(0, c), 6) AS score FROM (SELECT *, list_cosine_similarity(vector::DOUBLE[], {Q}) AS c FROM {CH} WHERE {LIVE}) ORDER BY 1 - c, chunk_id LIMIT 20",
    "dense_l2_topk": f"SELECT chunk_id, round(x, 6) AS distance FROM (SELECT *, list_distance(vector::DOUBLE[], {Q}) AS x FROM {CH} WHERE vector IS NOT NULL) ORDER BY x, chunk_id LIMIT 20",
    "dense_scoped_prefilter": f"SELECT chunk_id, round(greatest(0, c), 6) AS score FROM (SELECT *, list_cosine_similarity(vector::DOUBLE[], {Q}) AS c FROM {CH} WHERE {LIVE} AND namespace = 'project' AND contains(source_path, 'ОВ1')) ORDER BY 1 - c, chunk_id LIMIT 20",
    "cosine_l2_scores": f"SELECT chunk_id, round(list_cosine_similarity(vector::DOUBLE[], {Q}), 5) AS cosine, round(list_distance(vector::DOUBLE[], {Q}), 5) AS l2 FROM {CH} WHERE {LIVE}",
    "bm25_plain": f"""
WITH d AS (SELECT doc_id, t, len(t) AS n FROM (SELECT doc_id, {TOK} AS t FROM documents) WHERE len(t) > 0),
s AS (SELECT count(*)::DOUBLE AS n, avg(n) AS a FROM d),
tf AS (SELECT doc_id, n, w, len(list_filter(t, lambda x: x = w)) AS f FROM d, (SELECT unnest({WORDS}) AS w)),
df AS (SELECT w, count(*)::DOUBLE AS df FROM tf WHERE f > 0 GROUP BY w)
SELECT doc_id, round(sum(ln(1 + (s.n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * tf.n / s.a))), 4) AS bm25
FROM tf JOIN df USING (w), s WHERE f > 0 GROUP BY doc_id ORDER BY bm25 DESC, doc_id LIMIT 50""",
    "bm25_search": f"""
WITH d AS (SELECT doc_id, t, len(t) AS n FROM (SELECT doc_id, {LTOK} AS t FROM documents) WHERE len(t) > 0),
s AS (SELECT count(*)::DOUBLE AS n, avg(n) AS a FROM d), q AS (SELECT DISTINCT {_stemmed('w')} AS w FROM (SELECT unnest({WORDS}) AS w)),
tf AS (SELECT doc_id, n, w, len(list_filter(t, lambda x: x = w)) AS f FROM d, q),
df AS (SELECT w, count(*)::DOUBLE AS df FROM tf WHERE f > 0 GROUP BY w)
SELECT doc_id, round(sum(ln(1 + (s.n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * tf.n / s.a))), 4) AS bm25
FROM tf JOIN df USING (w), s WHERE f > 0 GROUP BY doc_id ORDER BY bm25 DESC, doc_id LIMIT 50""",
    "bm25_sparse_terms": f"WITH d AS (SELECT parent_id, {LTOK.replace('text', 'parent_text')} AS t FROM parent_chunks WHERE parent_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY parent_id) = 1) SELECT parent_id, term, count(*) AS tf FROM (SELECT parent_id, unnest(t) AS term FROM d) GROUP BY ALL",
    "linear_fusion": f"""WITH {BEST}, w AS (SELECT *, min(_relevance_score) OVER (PARTITION BY query_id) AS lo, max(_relevance_score) OVER (PARTITION BY query_id) AS hi FROM best)
SELECT query_id, chunk_id, round(0.7 * coalesce(CASE WHEN _distance IS NOT NULL THEN greatest(0.0, 1 - _distance) END, 0) + (1 - 0.7) * coalesce(CASE WHEN hi > lo THEN (_relevance_score - lo) / (hi - lo) WHEN _relevance_score IS NOT NULL THEN 1.0 END, 0), 6) AS score FROM w""",
    "rrf_fusion": f"""WITH {BEST}, l AS (
SELECT 0 AS l, query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY _distance, chunk_id) AS rank FROM best WHERE _distance IS NOT NULL UNION ALL
SELECT 1, query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY _relevance_score DESC, chunk_id) FROM best WHERE _relevance_score IS NOT NULL UNION ALL
SELECT 2, query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) FROM best WHERE score IS NOT NULL),
g AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, max(coalesce(score, 0)) AS base, count(DISTINCT l) AS m FROM l WHERE rank <= 20 GROUP BY ALL)
SELECT query_id, chunk_id, round(rrf, 6) AS rrf, round(base + least(0.08, 2 * rrf) + 1e-9, 4) AS score, m AS matched_queries FROM g""",
    "exact_channel": f"""SELECT chunk_id, ({whole('text', CODE[:4])}::BIGINT + {whole('text', 'НТД')}::BIGINT) AS exact_hits,
round(greatest(0, least(1, coalesce(CASE WHEN {LIVE} THEN list_cosine_similarity(vector::DOUBLE[], {Q}) END, 0))), 6) AS score FROM {CH} WHERE (contains(text, '{CODE[:4]}') OR contains(text, 'НТД')) AND ({whole('text', CODE[:4])} OR {whole('text', 'НТД')})""",
    "find_occurrences": f"SELECT doc_id, file_name, CASE WHEN {_snip} > 1 THEN '…' ELSE '' END || substr(text, {_snip}, 160) || CASE WHEN {_snip} + 160 <= length(text) THEN '…' ELSE '' END AS snippet FROM ({_occ})",
    "occurrences_by_document": f"SELECT source, count(*) AS matches, count(DISTINCT file_name) AS files FROM ({_occ}) GROUP BY source",
    "occurrences_page": f"SELECT source, doc_id FROM ({_occ}) WHERE source IS NOT NULL ORDER BY source, doc_id LIMIT 10 OFFSET 20",
    "identifier_tokens": rf"""
WITH t AS (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[^\s,;()\[\]«»"'']+'), lambda x: regexp_replace(x, '^[.,;:]+|[.,;:]+$', '', 'g')))) AS i FROM documents)
SELECT doc_id, i AS identifier FROM t WHERE len(i) >= 3 AND regexp_matches(i, '[0-9]') AND NOT regexp_matches(i, '^[0-9]+([.,][0-9]+)?$')
AND (regexp_matches(i, '^[{W}]+([.\-/][{W}]+){{2,}}$') OR (regexp_matches(i, '^[A-Za-zА-Яа-яЁё0-9_.\-/]{{5,}}$') AND regexp_matches(i, '[A-Za-zА-Яа-яЁё]')) OR regexp_matches(i, '^[A-Za-zА-Яа-яЁё]{{1,4}}[0-9]{{1,3}}-[{W}]{{1,6}}$'))""",
    "norm_designations": r"""
WITH t AS (SELECT doc_id, regexp_extract_all(regexp_replace(upper(translate(text, 'ёЁ', 'еЕ')), '\s+', ' ', 'g'), '(?:^|[^А-ЯA-Z0-9])((?:ГОСТ Р|ГОСТ|СНИП|САНПИН|ВСН|СП|СТО|РД|РТН|НТД|ВИТ) ?№? ?[0-9]+(?:[.\-][0-9]+)*)', 1) AS f FROM documents)
SELECT doc_id, unnest(list_distinct(list_transform(f, lambda x: regexp_replace(x, ' ?№? ?([0-9].*)$', ' \1')))) AS designation FROM t""",
    "parent_hydration": f"""WITH {RANKED}, p AS (SELECT parent_id, parent_text FROM parent_chunks WHERE parent_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY parent_id) = 1),
j AS (SELECT query_id, chunk_id, CASE WHEN len(parent_text) > 0 THEN parent_text ELSE coalesce(text, '') END AS f, coalesce(len(parent_text) > 0, false) AS h FROM ranked JOIN {CH} c USING (chunk_id) LEFT JOIN p USING (parent_id))
SELECT query_id, chunk_id, CASE WHEN h THEN 'parent' ELSE 'child' END || CASE WHEN len(f) > 6000 THEN '_truncated' ELSE '' END AS context_source, least(len(f), 6000)::BIGINT AS context_chars, md5(substr(f, 1, 6000)) AS context FROM j""",
    "dedup_by_parent": f"WITH {POOL} SELECT query_id, coalesce(parent_id, chunk_id) AS key, chunk_id FROM pool QUALIFY row_number() OVER (PARTITION BY query_id, coalesce(parent_id, chunk_id) ORDER BY rank) = 1",
    "title_penalty": "WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS x FROM documents), n AS (SELECT doc_id, x, " + _sum_contains("substr(x, 1, 1800)", quality.TITLE_MARKERS) + " AS n FROM t) SELECT doc_id, round(CASE WHEN n = 0 THEN 0.0::DOUBLE WHEN contains(x, 'область применения') THEN least(0.48::DOUBLE, 0.12::DOUBLE * n) * 0.65::DOUBLE ELSE least(0.48::DOUBLE, 0.12::DOUBLE * n) END, 4) AS penalty FROM n",
    "table_noise": f"WITH t AS (SELECT doc_id, {TOK.replace('(text)', '(coalesce(text, chr(32)))')} AS t FROM documents), u AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(t) AS w FROM t) GROUP BY ALL), m AS (SELECT doc_id, max(n) AS n FROM u GROUP BY 1) SELECT doc_id, round(coalesce(m.n, 0)::DOUBLE / greatest(len(t), 1), 6) AS top_share, len(t)::BIGINT AS tokens FROM t LEFT JOIN m USING (doc_id)",
    "lexical_boost": "SELECT doc_id, round(least(1.0::DOUBLE, 0.3::DOUBLE + " + _sum_contains("lower(coalesce(text, ''))", [w for w in _words if len(w) >= 4]) + " * 0.12::DOUBLE + " + _sum_contains("lower(coalesce(file_name, ''))", [w for w in _words if len(w) >= 4]) + " * 0.03::DOUBLE), 4) AS score FROM documents",
    "diversify_per_doc": f"""WITH {POOL}, a AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY query_id, substr(trim(regexp_replace(lower(text), '[\\s\\x{{A0}}]+', ' ', 'g')), 1, 260) ORDER BY rank) = 1),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) <= 2)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM b QUALIFY position <= 8""",
    "newest_revision": rf"WITH {_CUR}, k AS (SELECT source_path, {_retr} AS document, (coalesce(modified_at, ''), coalesce(try_cast(regexp_extract(source_path, '-(\d{{2}})[\s_]*(?:\(\d+\))?\.[A-Za-z]+$', 1) AS INT), 0)) AS i FROM cur) SELECT document, source_path FROM k QUALIFY i = max(i) OVER (PARTITION BY document)",
    "source_focus": f"WITH {POOL}{_focus} SELECT query_id, chunk_id FROM focus",
    "fill_to_top_k": f"""WITH {POOL}{_focus}, b AS (SELECT 0 AS seg, query_id, chunk_id, rank FROM focus WHERE rank <= 5 UNION ALL SELECT 1, query_id, chunk_id, rank FROM pool),
o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY seg, rank) = 1)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY seg, rank) AS position FROM o QUALIFY position <= 8""",
    "rerank_apply": f"WITH {RANKED}, l AS (SELECT *, CASE WHEN rank <= 10 THEN 2 - _distance * 3 END AS logit FROM ranked) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY logit DESC NULLS LAST, rank) AS position, round(1 / (1 + exp(-logit)), 4) AS rerank_score FROM l",
    "crag_grade": f"WITH {BEST}, g AS (SELECT query_id, coalesce(max(score) - 0.4, 0) AS t FROM best GROUP BY 1) SELECT query_id, CASE WHEN t >= 0.55 THEN 'correct' WHEN t >= 0.35 THEN 'ambiguous' ELSE 'incorrect' END AS grade, CASE WHEN t >= 0.55 THEN 'strong_top_score' WHEN t >= 0.35 THEN 'moderate_top_score' ELSE 'weak_top_score' END AS reason, t < 0.55 AS retry FROM g",
    "rerank_decision": f"""WITH {RANKED}, p AS (SELECT query_id, score - 0.3 AS s, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM ranked WHERE score IS NOT NULL),
g AS (SELECT query_id, count(*) AS n, max(s) FILTER (rank <= 5) AS best, arg_min(s, rank) AS f, arg_max(s, rank) FILTER (rank <= 5) AS l FROM p GROUP BY 1),
r AS (SELECT query_id, CASE WHEN n <= 5 THEN 'too_few_candidates' WHEN best < 0.45 THEN 'weak_scores' WHEN f - l < 0.04 AND f < 0.7 THEN 'ambiguous_scores' ELSE 'not_needed' END AS reason FROM g)
SELECT query_id, reason, reason IN ('weak_scores', 'ambiguous_scores') AS apply FROM r""",
    "semantic_cache_lookup": f"WITH {_CACHE}, live AS (SELECT * FROM cache WHERE scope = 'project' ORDER BY created_at DESC, id DESC LIMIT 500), q AS (SELECT vector::DOUBLE[] AS q FROM live ORDER BY created_at DESC, id DESC LIMIT 1) SELECT id, round(c, 6) AS similarity FROM (SELECT *, list_cosine_similarity(vector::DOUBLE[], q) AS c FROM live, q WHERE {LIVE}) WHERE c >= 0.94 ORDER BY round(c, 9) DESC, created_at DESC, id DESC LIMIT 1",
    "cache_evict": f"WITH {_CACHE} SELECT id FROM cache WHERE created_at >= TIMESTAMPTZ '{NOW}+00' - INTERVAL 14 DAY ORDER BY created_at DESC, id DESC LIMIT 500",
    "maxsim_late_interaction": f"""WITH c AS (SELECT doc_id, chunk_id, vector::DOUBLE[] AS v FROM {CH} WHERE vector IS NOT NULL), q AS (SELECT chunk_id AS i, v AS q FROM c ORDER BY chunk_id LIMIT 4),
b AS (SELECT doc_id, i, max(list_cosine_similarity(v, q)) AS b FROM c, q WHERE list_dot_product(v, v) > 0 GROUP BY ALL) SELECT doc_id, round(avg(b), 5) AS maxsim FROM b GROUP BY 1""",
    "merge_traces": f"""WITH {BEST}, t AS (SELECT query_id, CASE WHEN _distance IS NOT NULL THEN 0 WHEN _relevance_score IS NOT NULL THEN 1 ELSE 2 END AS no, score IS NULL AS g FROM best),
a AS (SELECT query_id, bool_or(g) AS degraded, count(*) AS candidates FROM t GROUP BY 1), n AS (SELECT query_id, string_agg(['dense', 'lexical', 'exact'][no + 1], ',' ORDER BY no) AS channels FROM (SELECT DISTINCT query_id, no FROM t) GROUP BY 1)
SELECT query_id, channels, degraded, candidates FROM a JOIN n USING (query_id)""",
}

SQL["bm25_unindexed"] = SQL["bm25_search"]
_x = "lower(coalesce(text, ''))"
_ntok = "greatest(len(t), 1)"
# the values as such, so that a marker missing from the operator shows
_stamps = "copyright by|формат:|подп. дата|подп. и дата|инв.|инв.№|лист листов|стадия|кол.уч|№док|заказчик:|разраб.|проверил|н.контр".split("|")
SQL["quality_score"] = rf"""
WITH t AS (SELECT doc_id, source, file_name, {_x} AS x, coalesce(text, '') AS text, {TOK.replace('(text)', '(coalesce(text, chr(32)))')} AS t FROM documents),
l AS (SELECT *, list_filter(string_split_regex(x, '\r\n|\n|\r'), lambda y: len(trim(y, ' ')) > 0) AS ls, len(x) - len(replace(x, '|', '')) AS pipes,
  coalesce(list_max(list_transform(list_distinct(t), lambda w: len(list_filter(t, lambda v: v = w)))), 0) AS top FROM t),
p AS (SELECT *, CASE WHEN len(trim(x, ' ')) = 0 THEN 0.35::DOUBLE ELSE round(least(0.58::DOUBLE,
  CASE WHEN pipes >= 10 THEN least(0.28::DOUBLE, pipes / greatest(200.0::DOUBLE, len(x)) * 4.0::DOUBLE) ELSE 0 END
  + CASE WHEN len(list_filter(ls, lambda y: len(y) - len(replace(y, '|', '')) >= 3))::DOUBLE / greatest(len(ls), 1) >= 0.35 THEN 0.18::DOUBLE ELSE 0 END
  + CASE WHEN top::DOUBLE / {_ntok} >= 0.18 THEN 0.16::DOUBLE ELSE 0 END
  + CASE WHEN (len(x) - len(replace(x, 'шт.', ''))) / 3 >= 8 THEN 0.12::DOUBLE ELSE 0 END
  + CASE WHEN len(list_filter(t, lambda w: len(w) <= 2))::DOUBLE / {_ntok} >= 0.55 AND {_ntok} >= 25 THEN 0.10::DOUBLE ELSE 0 END
  + CASE WHEN len(list_filter(t, lambda w: regexp_matches(w, '[0-9]')))::DOUBLE / {_ntok} >= 0.35 AND {_ntok} >= 20 THEN 0.14::DOUBLE ELSE 0 END
  + CASE WHEN len(list_filter(t, lambda w: regexp_matches(w, '[0-9]') AND len(w) >= 5)) >= 8 THEN 0.16::DOUBLE ELSE 0 END
  + CASE WHEN len(regexp_extract_all(x, '(?:^|[^0-9a-zа-яё_])[0-9]{{2,5}} *[xх] *[0-9]{{2,5}}(?:$|[^0-9a-zа-яё_])')) >= 2 THEN 0.12::DOUBLE ELSE 0 END
  + CASE WHEN len(regexp_extract_all(x, '[-+][0-9]{{1,3}}[,.][0-9]{{2,3}}(?:$|[^0-9a-zа-яё_])')) >= 3 THEN 0.12::DOUBLE ELSE 0 END
  + CASE WHEN {_sum_contains('x', _stamps)} >= 3 THEN least(0.34::DOUBLE, 0.08::DOUBLE * {_sum_contains('x', _stamps)}) ELSE 0 END
  + CASE WHEN regexp_matches(x, '(?:^|[^0-9a-zа-яё_])а(?:\s+а){{8,}}(?:$|[^0-9a-zа-яё_])') THEN 0.22::DOUBLE ELSE 0 END), 4) END AS table_penalty,
  round(least(0.38::DOUBLE, least(0.22::DOUBLE, {_sum_contains('x', _words)} * 0.045::DOUBLE) + least(0.20::DOUBLE, {_sum_contains("lower(coalesce(file_name, ''))", _words)} * 0.055::DOUBLE) + CASE WHEN contains(x, '{QUERY}') THEN 0.10::DOUBLE ELSE 0 END), 4) AS lexical_bonus,
  round(least(0.25::DOUBLE, least(0.20::DOUBLE, {_sum_contains('x', quality.SUBSTANTIVE_MARKERS)} * 0.035::DOUBLE) + CASE WHEN coalesce(source = 'normative_base', false) AND regexp_matches(x, '(?:^|\s)(?:п\.|пункт|таблица)\s*[0-9]+') THEN 0.05::DOUBLE ELSE 0 END), 4) AS substantive_bonus,
  round(greatest(-0.35::DOUBLE, least(0.35::DOUBLE, least(0.12::DOUBLE, {_sum_contains("lower(coalesce(file_name, ''))", _words)} * 0.03::DOUBLE) + CASE WHEN coalesce(source, '') = 'normative_base' THEN 0.0::DOUBLE ELSE
    CASE WHEN regexp_matches(lower(coalesce(file_name, '')), 'ов|пв|вентиляц|дымоудален|противодым|подпор') THEN 0.24::DOUBLE ELSE -0.18::DOUBLE END - CASE WHEN contains(lower(coalesce(file_name, '')), 'эом') THEN 0.16::DOUBLE ELSE 0 END END)), 4) AS path_bonus,
  {whole("(text || ' ' || coalesce(file_name, ''))", 'НТД')}::BIGINT AS exact_hits,
  round(CASE WHEN {_sum_contains('substr(x, 1, 1800)', quality.TITLE_MARKERS)} = 0 THEN 0.0::DOUBLE WHEN contains(x, 'область применения') THEN least(0.48::DOUBLE, 0.12::DOUBLE * {_sum_contains('substr(x, 1, 1800)', quality.TITLE_MARKERS)}) * 0.65::DOUBLE ELSE least(0.48::DOUBLE, 0.12::DOUBLE * {_sum_contains('substr(x, 1, 1800)', quality.TITLE_MARKERS)}) END, 4) AS title_penalty FROM l)
SELECT doc_id, 0.5::DOUBLE AS base_score, lexical_bonus, substantive_bonus, path_bonus, exact_hits, 0.25::DOUBLE * exact_hits AS exact_bonus, table_penalty,
round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + 0.25::DOUBLE * exact_hits + lexical_bonus + substantive_bonus + path_bonus - title_penalty - table_penalty)), 4) AS score FROM p"""
