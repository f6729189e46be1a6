"""Corpus maintenance, graph, routing and event queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import corpus, graph
from tesserae.operators.incremental import current_files, usable
from tesserae.plans import routing
from tesserae.queries.retrieval import _CUR, CH, LIVE, chunks
from tesserae.session import load
from tesserae.streaming import events as ev


def doc_identity_keys(spark, d):
    p = F.col("source_path")
    return load(spark, d, "files").filter("source_path is not null").select("source_path").distinct().select("source_path", T.retrieval_identity(p).alias("retrieval"), T.table_identity(p).alias("tables"), T.family_identity(p).alias("family"), T.pair_identity(p).alias("pair"), T.document_id(p).alias("doc_id"))


def doc_centroids(spark, d):
    c = graph.centroids(chunks(spark, d).select("doc_id", "vector"), 64)
    return c.select("doc_id", "chunks", F.round(F.get("centroid", F.lit(0)), 5).alias("first"), F.round(F.get("centroid", F.lit(63)), 5).alias("last"))


def graph_edges(spark, d):
    return graph.top_edges(graph.both_ways(load(spark, d, "doc_edges")), 5).select("doc_id_a", "doc_id_b", "similarity", F.col("rank").cast("long").alias("rank"))


def graph_built(spark, d):
    return graph.build_edges(chunks(spark, d).select("doc_id", "vector"), 64, 5).select("doc_id_a", "doc_id_b", F.round("similarity", 6).alias("similarity"))


def graph_neighbors(spark, d):
    return graph.neighbours(load(spark, d, "doc_edges"), load(spark, d, "files"), 5).select("doc_id_a", "doc_id_b", F.col("rank").cast("long").alias("rank"), "source_path")


def graph_measured(spark, d):
    c = graph.centroids(chunks(spark, d).select("doc_id", "vector"), 64)
    return graph.measured(load(spark, d, "doc_edges"), c).select("doc_id_a", "doc_id_b", F.round("similarity", 5).alias("similarity"))


def graph_stats(spark, d):
    return graph.stats(graph.both_ways(load(spark, d, "doc_edges")))


def changed_files(spark, d):
    s = usable(load(spark, d, "file_scans")).groupBy("source_path").agg(F.max_by("sha256", F.struct("scanned_at", "scan_id")).alias("sha256"))
    return corpus.changed_files(s, current_files(load(spark, d, "files")))


def corpus_gap(spark, d):
    return corpus.corpus_gap(load(spark, d, "file_scans").filter("source_path is not null"), load(spark, d, "files").filter("source_path is not null"))


def orphan_check(spark, d):
    files = current_files(load(spark, d, "files")).filter("status <> 'failed'")
    return corpus.consistency(files, load(spark, d, "parent_chunks"), load(spark, d, "documents_64"))


def missing_rules(spark, d):
    files = current_files(load(spark, d, "files")).select("source_path")
    return corpus.missing(files, load(spark, d, "extracted_values").filter("source_path is not null"))


def cache_split(spark, d):
    c = chunks(spark, d)
    cache = c.filter(F.md5("chunk_id") < "8").groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.min("chunk_id").alias("vector_id"))
    return corpus.cache_split(c.select("chunk_id", "text"), cache, c.filter("vector is not null").select("chunk_id")).groupBy("reused").agg(F.count("*").alias("chunks"), F.count_distinct("vector_id").alias("vectors"))


def exact_duplicates(spark, d):
    return corpus.exact_duplicates(current_files(load(spark, d, "files")))


def version_families(spark, d):
    return corpus.version_families(current_files(load(spark, d, "files")))


def dedup_plan(spark, d):
    return corpus.dedup_plan(current_files(load(spark, d, "files")), load(spark, d, "extracted_values").filter("source_path is not null"))


def rules_dedup(spark, d):
    v = load(spark, d, "extracted_values").filter("value_id is not null").dropDuplicates(["value_id"])
    return corpus.keep_first(v, ["record", "label", "unit"], "value_id").select("value_id")


def duplicate_stats(spark, d):
    return corpus.duplicate_stats(load(spark, d, "documents").filter("text is not null"), ["text"])


def search_rules(spark, d):
    v = load(spark, d, "extracted_values").filter("value_id is not null").dropDuplicates(["value_id"])
    r = v.select(F.col("value_id").alias("id"), F.col("evidence").alias("rule_text"), F.col("record").alias("subject"), F.col("label").alias("parameter"))
    return corpus.search_rules(r, "поз.", "П", "давление", 50)


def list_indexed(spark, d):
    f = current_files(load(spark, d, "files"))
    return f.filter(F.col("source_path").contains("Проекты")).groupBy("dataset").agg(F.count("*").alias("files"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"))


def replace_document(spark, d):
    base = chunks(spark, d).select("doc_id", "chunk_id", "text")
    doc = base.agg(F.min("doc_id")).first()[0]
    new = base.filter(F.col("doc_id") == doc).filter(F.col("chunk_id").endswith("0")).withColumn("text", F.upper("text"))
    r = corpus.replace_document(base, new, doc) if doc is not None else base
    return r.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"), F.min(F.md5("text")).alias("digest"))


def source_counts(spark, d):
    return load(spark, d, "documents_64").groupBy("source_path").agg(F.count("*").alias("rows"))


def embedding_drift(spark, d):
    from tesserae.functions.vectors import cosine

    c = chunks(spark, d).filter("vector is not null").select("chunk_id", "vector")
    fresh = c.select("chunk_id", F.transform("vector", lambda x: F.round(x, 2)).alias("fresh"))
    return corpus.drift(c, fresh, cosine(F.col("vector"), F.col("fresh"))).select("n", F.round("least", 5).alias("least"), F.round("median", 5).alias("median"), "verdict")


def route_domains(spark, d):
    return routing.route_all(load(spark, d, "documents"), "doc_id", "text")


def _events(spark, d):
    e = load(spark, d, "events")
    action = F.when(F.col("event_type") == "purchase", "delete").otherwise(F.col("event_type"))
    path = F.concat(F.lit("Q:/d/"), F.col("user_id").cast("string"), F.when(F.col("user_id") % 7 == 0, ".dwg").otherwise(".pdf"))
    e = e.select(path.alias("path"), "ts", F.col("event_id").alias("seq"), action.alias("action"), "value", "user_id", "event_type")
    return e.withColumn("priority", ev.priority(F.col("action"), F.col("path"), (F.col("value") * 100000).cast("long")))


def coalesce_events(spark, d):
    return ev.coalesced(_events(spark, d)).select("path", "action", "priority", "events")


def defer_priority(spark, d):
    return _events(spark, d).groupBy("action", "priority").agg(F.count("*").alias("events"))


def events_tumbling(spark, d):
    return ev.tumbling(load(spark, d, "events"), "event_type", "1 hour").select("start", "event_type", "n", F.round("total", 3).alias("total"))


def events_session(spark, d):
    return ev.sessions(load(spark, d, "events"), "user_id", "30 minutes").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"), F.max("n").alias("longest"))


QUERIES = {
    f.__name__: f
    for f in (
        doc_identity_keys, doc_centroids, graph_edges, graph_built, graph_neighbors, graph_measured, graph_stats, changed_files, corpus_gap, orphan_check, missing_rules, cache_split, exact_duplicates, version_families,
        dedup_plan, rules_dedup, duplicate_stats, search_rules, list_indexed, replace_document, source_counts, embedding_drift, route_domains, coalesce_events, defer_priority, events_tumbling, events_session,
    )
}

_stem = r"lower(regexp_replace(regexp_extract(source_path, '[^\\/]*$'), '\.[A-Za-z][A-Za-z0-9]{0,4}$', ''))"
_pair = rf"regexp_replace({_stem}, '[\s_]*\(\d+\)$', '')"
_family = rf"trim(regexp_replace(regexp_replace(regexp_replace({_stem}, '(\s*\(\d+\)|_part\d+)', '', 'g'), '(-\d{{2}}|\.\d{{2}})+$', ''), '\s+', ' ', 'g'))"
_key = "CASE WHEN len(trim(sha256)) > 0 THEN lower(substr(trim(sha256), 1, 16)) END"
_q = r"trim(regexp_replace(translate(lower(text), 'ё', 'е'), '\s+', ' ', 'g'))"
_edges = "e AS (SELECT doc_id_a AS a, doc_id_b AS b, similarity AS s FROM doc_edges WHERE doc_id_a <> doc_id_b AND similarity IS NOT NULL), w AS (SELECT a, b, max(s) AS s FROM (SELECT a, b, s FROM e UNION ALL SELECT b, a, s FROM e) GROUP BY ALL)"
_cent = f"c AS (SELECT doc_id, count(*) AS chunks, list(m ORDER BY i) AS v FROM (SELECT doc_id, i, avg(x) AS m, count(*) AS n FROM (SELECT doc_id, unnest(range(1, 65)) AS i, unnest(vector::DOUBLE[]) AS x FROM {CH} WHERE len(vector) = 64) GROUP BY ALL) GROUP BY 1)"
_ev = "v AS (SELECT 'Q:/d/' || user_id || CASE WHEN user_id % 7 = 0 THEN '.dwg' ELSE '.pdf' END AS path, ts, event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'delete' ELSE event_type END AS action, trunc(value * 100000)::BIGINT AS size FROM events), p AS (SELECT *, CASE WHEN action = 'delete' THEN 0 WHEN path LIKE '%.dwg' OR coalesce(size, 0) > 10485760 THEN 1 ELSE 0 END AS priority FROM v)"


def _points(d: routing.Domain) -> str:
    def one(t: str) -> str:
        p = "(?:^|[^0-9a-zа-я])" + t.replace("ё", "е").replace(".", r"\.") + ("(?:$|[^0-9a-zа-я])" if len(t) < 5 else "")
        return f"regexp_matches({_q}, '{p}')::INT"

    return " + ".join([*(one(t) for t in d.terms), *(f"2 * regexp_matches({_q}, '(?i){p}')::INT" for p in d.patterns)])


SQL = {
    "doc_identity_keys": rf"SELECT DISTINCT source_path, CASE WHEN regexp_matches({_pair}, '\d\.\d') THEN regexp_replace({_pair}, '([\d)])-\d{{2}}$', '\1') ELSE {_pair} END AS retrieval, regexp_replace({_pair}, '-\d{{2}}$', '') AS tables, {_family} AS family, {_pair} AS pair, substr(sha256(source_path), 1, 8) AS doc_id FROM files WHERE source_path IS NOT NULL",
    "doc_centroids": f"WITH {_cent.replace('count(*) AS chunks', 'max(n) AS chunks')} SELECT doc_id, chunks, round(v[1], 5) AS first, round(v[64], 5) AS last FROM c",
    "graph_edges": f"WITH {_edges} SELECT a AS doc_id_a, b AS doc_id_b, s AS similarity, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rank FROM w QUALIFY rank <= 5",
    "graph_built": f"""WITH {_cent}, p AS (SELECT c.doc_id AS a, h.doc_id AS b, max(round(list_cosine_similarity(c.v, h.vector::DOUBLE[]), 9)) AS s FROM c JOIN (SELECT * FROM {CH} WHERE {LIVE} AND len(vector) = 64) h ON h.doc_id <> c.doc_id GROUP BY ALL),
t AS (SELECT a, b, greatest(0, s) AS s FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT a AS doc_id_a, b AS doc_id_b, round(max(s), 6) AS similarity FROM (SELECT a, b, s FROM t UNION ALL SELECT b, a, s FROM t) GROUP BY ALL""",
    "graph_neighbors": f"WITH {_edges}, t AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rank FROM w QUALIFY rank <= 5), n AS (SELECT substr(sha256(source_path), 1, 8) AS b, min(source_path) AS source_path FROM files WHERE source_path IS NOT NULL GROUP BY 1) SELECT a AS doc_id_a, b AS doc_id_b, rank, source_path FROM t LEFT JOIN n USING (b)",
    "graph_measured": f"WITH {_cent}, p AS (SELECT DISTINCT least(doc_id_a, doc_id_b) AS a, greatest(doc_id_a, doc_id_b) AS b FROM doc_edges WHERE doc_id_a <> doc_id_b) SELECT a AS doc_id_a, b AS doc_id_b, round(list_cosine_similarity(x.v, y.v), 5) AS similarity FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b",
    "graph_stats": f"WITH {_edges} SELECT count(*) AS edges, count(DISTINCT a) AS documents FROM w",
    "changed_files": f"WITH {_CUR}, s AS (SELECT source_path, arg_max(lower(left(trim(sha256), 16)), {{'a': scanned_at, 'b': scan_id}}) AS n FROM file_scans WHERE len(trim(sha256)) > 0 AND source_path IS NOT NULL AND run_id IS NOT NULL GROUP BY 1), r AS (SELECT s.source_path, CASE WHEN cur.source_path IS NULL THEN 'new' WHEN status = 'reindexing' THEN 'reindexing' WHEN n IS DISTINCT FROM {_key} THEN 'changed' END AS reason FROM s LEFT JOIN cur ON s.source_path = cur.source_path) SELECT source_path, reason FROM r WHERE reason IS NOT NULL",
    "corpus_gap": r"WITH k AS (SELECT DISTINCT source_path, regexp_replace(regexp_replace(lower(trim(source_path)), '[\\/]+', '/', 'g'), '/$', '') AS k FROM file_scans WHERE source_path IS NOT NULL AND NOT starts_with(regexp_extract(source_path, '[^\\/]*$'), '~$') AND regexp_matches(lower(source_path), '\.(pdf|docx|xlsx|txt|md|csv|json|py)$')) SELECT source_path FROM k ANTI JOIN (SELECT regexp_replace(regexp_replace(lower(trim(source_path)), '[\\/]+', '/', 'g'), '/$', '') AS k FROM files WHERE source_path IS NOT NULL) USING (k)",
    "orphan_check": f"""WITH {_CUR}, f AS (SELECT * FROM cur WHERE status <> 'failed'), p AS (SELECT DISTINCT source_path FROM parent_chunks WHERE source_path IS NOT NULL), v AS (SELECT DISTINCT source_path FROM documents_64 WHERE source_path IS NOT NULL)
SELECT 'orphan_parents' AS kind, source_path FROM p ANTI JOIN f USING (source_path) UNION ALL SELECT 'orphan_vectors', source_path FROM v ANTI JOIN f USING (source_path)
UNION ALL SELECT 'missing_vectors', source_path FROM (SELECT * FROM f WHERE chunk_count > 0) ANTI JOIN v USING (source_path) UNION ALL SELECT 'reindexing', source_path FROM f WHERE status = 'reindexing'""",
    "missing_rules": f"WITH {_CUR} SELECT source_path FROM cur ANTI JOIN extracted_values USING (source_path)",
    "cache_split": f"WITH c AS (SELECT * FROM {CH}), k AS (SELECT sha256(text) AS h, min(chunk_id) AS v FROM c WHERE md5(chunk_id) < '8' GROUP BY 1), j AS (SELECT x.chunk_id, y.chunk_id AS v FROM c x LEFT JOIN k ON sha256(x.text) = k.h LEFT JOIN (SELECT chunk_id FROM c WHERE vector IS NOT NULL) y ON y.chunk_id = k.v) SELECT v IS NOT NULL AS reused, count(*) AS chunks, count(DISTINCT v) AS vectors FROM j GROUP BY 1",
    "exact_duplicates": f"WITH {_CUR}, g AS (SELECT {_key} AS sha256, count(DISTINCT source_path) AS files FROM cur GROUP BY 1) SELECT sha256, files, files - 1 AS wasted FROM g WHERE sha256 IS NOT NULL AND files > 1",
    "version_families": f"WITH {_CUR} SELECT {_family} AS family, count(DISTINCT source_path) AS files, count(DISTINCT {_key}) AS contents FROM cur GROUP BY 1 HAVING count(DISTINCT source_path) > 1",
    "dedup_plan": rf"""WITH {_CUR}, f AS (SELECT DISTINCT source_path, {_pair} AS pair, lower(regexp_extract(source_path, '\.([A-Za-z]+)$', 1)) AS form FROM cur), r AS (SELECT DISTINCT source_path, 1 AS r FROM extracted_values WHERE source_path IS NOT NULL),
g AS (SELECT pair, count(*) AS n, array_to_string(list_sort(list(DISTINCT form)), ',') AS formats, min(source_path) FILTER (form = 'pdf') AS pdf, max(r) FILTER (form = 'pdf') AS rp, max(r) FILTER (form = 'docx') AS rd FROM f LEFT JOIN r USING (source_path) GROUP BY 1 HAVING count(*) > 1),
a AS (SELECT *, CASE WHEN n = 2 AND formats = 'docx,pdf' THEN CASE WHEN rp IS NOT NULL AND rd IS NULL THEN 'refused' ELSE 'drop_pdf' END ELSE 'skipped' END AS action FROM g) SELECT pair, formats, action, CASE WHEN action = 'drop_pdf' THEN pdf END AS drop_path FROM a""",
    "rules_dedup": "SELECT min(value_id) AS value_id FROM extracted_values WHERE value_id IS NOT NULL GROUP BY record, label, unit",
    "duplicate_stats": "SELECT count(*) AS groups, coalesce(sum(n - 1), 0)::BIGINT AS rows FROM (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1)",
    "search_rules": "WITH v AS (SELECT DISTINCT value_id AS id, evidence AS rule_text, record AS subject, label AS parameter FROM extracted_values WHERE value_id IS NOT NULL) SELECT * FROM v WHERE (contains(lower(rule_text), 'поз.') OR contains(lower(subject), 'поз.') OR contains(lower(parameter), 'поз.')) AND contains(lower(subject), 'п') AND contains(lower(parameter), 'давление') ORDER BY id LIMIT 50",
    "list_indexed": f"WITH {_CUR} SELECT dataset, count(*) AS files, coalesce(sum(chunk_count), 0)::BIGINT AS chunks FROM cur WHERE contains(source_path, 'Проекты') GROUP BY 1",
    "replace_document": f"""WITH b AS (SELECT doc_id, chunk_id, text FROM {CH}), x AS (SELECT min(doc_id) AS x FROM b), n AS (SELECT doc_id, chunk_id, text FROM b, x WHERE doc_id IS DISTINCT FROM x UNION ALL SELECT doc_id, chunk_id, upper(text) FROM b, x WHERE doc_id = x AND chunk_id LIKE '%0')
SELECT doc_id, count(*) AS chunks, sum(len(text))::BIGINT AS chars, min(md5(text)) AS digest FROM n GROUP BY 1""",
    "source_counts": "SELECT source_path, count(*) AS rows FROM documents_64 GROUP BY 1",
    "embedding_drift": f"""WITH c AS (SELECT vector::DOUBLE[] AS v, list_transform(vector, lambda x: round(x, 2))::DOUBLE[] AS w FROM {CH} WHERE vector IS NOT NULL),
d AS (SELECT list_cosine_similarity(v, w) AS c FROM c WHERE list_dot_product(v, v) > 0 AND list_dot_product(w, w) > 0), a AS (SELECT count(*) AS n, min(c) AS l, median(round(c, 6)) AS m FROM d)
SELECT n, round(l, 5) AS least, round(m, 5) AS median, CASE WHEN n = 0 THEN 'EMPTY' WHEN l >= 0.998 AND m >= 0.999 THEN 'PASS' WHEN l >= 0.99 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM a""",
    "route_domains": f"WITH s AS (SELECT doc_id, unnest([{', '.join(f'''{{'d': '{d.name}', 'p': {_points(d)}}}''' for d in routing.DOMAINS)}]) AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, s.d AS domain, s.p::BIGINT AS points, round(s.p::DOUBLE / sum(s.p) OVER (PARTITION BY doc_id), 4) AS confidence FROM s QUALIFY sum(s.p) OVER (PARTITION BY doc_id) > 0 AND row_number() OVER (PARTITION BY doc_id ORDER BY s.p DESC, s.d) = 1",
    "coalesce_events": f"WITH {_ev} SELECT path, arg_max(action, {{'a': ts, 'b': seq}}) AS action, min(priority) AS priority, count(*) AS events FROM p GROUP BY 1",
    "defer_priority": f"WITH {_ev} SELECT action, priority, count(*) AS events FROM p GROUP BY ALL",
    "events_tumbling": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL",
    "events_session": "WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true)::INT AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e), g AS (SELECT user_id, k, count(*) AS n FROM n GROUP BY ALL) SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events, max(n) AS longest FROM g GROUP BY 1",
}
