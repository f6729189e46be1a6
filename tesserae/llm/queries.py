"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import encode, knn, mix, neardup, noise, rank, repetition, survive
from tesserae.session import load

Query = Callable[[SparkSession, str], DataFrame]
SCORES = {"_distance": (False, 1.0), "_relevance_score": (True, 1.0), "score": (True, 1.0)}


def _near(spark: SparkSession, d: str) -> neardup.NearDuplicates:
    """Word runs of three and half of them in common, as TESTDATA.md states the cases."""
    return neardup.NearDuplicates(load(spark, d, "parent_chunks"), "parent_id", "parent_text", run=3, threshold=0.5, rows=3, bands=32)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).found().select(F.col("a").alias("parent_id_a"), F.col("b").alias("parent_id_b"))


def p1_members(spark: SparkSession, d: str) -> DataFrame:
    """At the parameters of p1_found: each parent's class of equal words, by its first member, and its number of near classes."""
    return _near(spark, d).rows()


def p1_member_groups(spark: SparkSession, d: str) -> DataFrame:
    """The connected groups of p1_found."""
    return _near(spark, d).groups()


def p1_rows(spark: SparkSession, d: str) -> DataFrame:
    """Five words and a similarity of 0.8, a row for each parent with its class and number of links."""
    return neardup.NearDuplicates(load(spark, d, "parent_chunks"), "parent_id", "parent_text").rows()


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.NearDuplicates(load(spark, d, "parent_chunks"), "parent_id", "parent_text").groups()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    ranked = rank.median_rank(load(spark, d, "search_hits"), "query_id", "chunk_id", SCORES)
    return rank.best_of_each(ranked, "query_id", "chunk_id", 5).select("query_id", "chunk_id")


def p3_ranking(spark: SparkSession, d: str) -> DataFrame:
    return rank.median_rank(load(spark, d, "search_hits"), "query_id", "chunk_id", SCORES)


def _scans(spark: SparkSession, d: str) -> noise.Scans:
    a = load(spark, d, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").cast("string").alias("row_key"), "text")
    b = load(spark, d, "parent_chunks").select(F.lit("parent_chunks").alias("src"), F.col("parent_id").alias("row_key"), F.col("parent_text").alias("text"))
    return noise.Scans(a.union(b))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d).found()


def p4_texts(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d).repaired()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return survive.survivors(load(spark, d, "files"), load(spark, d, "format_trust")).select("source_path")


def p6_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survive.survivors(load(spark, d, "files"), load(spark, d, "format_trust"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    index = knn.VectorIndex(load(spark, d, "documents_64"), "chunk_id", "vector", 64)
    return index.mutual(0.9).select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p7_closest(spark: SparkSession, d: str) -> DataFrame:
    """The ten closest of every chunk whose id is divisible by 100, against all."""
    return knn.VectorIndex(load(spark, d, "documents_64"), "chunk_id", "vector", 64).closest()


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(load(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.Mixture(load(spark, d, "documents"), load(spark, d, "mix_targets")).texts()


def p9_order(spark: SparkSession, d: str) -> DataFrame:
    return mix.Mixture(load(spark, d, "documents"), load(spark, d, "mix_targets")).order()


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.Mixture(load(spark, d, "documents"), load(spark, d, "mix_targets")).shares()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repeating(load(spark, d, "documents"))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition(load(spark, d, "documents")).select("doc_id", "n_runs", "repeated_runs", F.round("repeated_share", 6).alias("repeated_share"))


def p10_retained(spark: SparkSession, d: str) -> DataFrame:
    return repetition.retained(load(spark, d, "documents")).select("doc_id", F.round("content_share", 6).alias("content_share"), "retained")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_members, p1_member_groups, p1_rows, p1_groups, p3_found, p3_ranking, p4_found, p4_texts, p6_found, p6_survivors, p7_found, p7_closest, p8_ids, p9_mix, p9_order, p9_shares, p10_found, p10_shares, p10_retained)}


_P1 = r"""
WITH t AS (SELECT DISTINCT parent_id, parent_text FROM parent_chunks WHERE parent_text IS NOT NULL AND parent_id IS NOT NULL),
w AS (SELECT parent_id, regexp_extract_all(lower(parent_text), '[\p{L}\p{N}]+') AS w FROM t),
r AS (SELECT parent_id, unnest(list_distinct(list_transform(range(1, len(w) - RUN + 2), lambda i: array_to_string(w[i:i+RUN-1], ' ')))) AS r FROM w WHERE len(w) >= RUN),
n AS (SELECT parent_id, count(*) AS n FROM r GROUP BY 1),
c AS (SELECT x.parent_id AS a, y.parent_id AS b, count(*) AS c FROM r x JOIN r y ON x.r = y.r AND x.parent_id < y.parent_id GROUP BY ALL)
"""


def _p1_sql(run: int) -> str:
    return _P1.replace("RUN-1", str(run - 1)).replace("RUN", str(run))


#: (first, class and links) of texts of equal words, for runs of RUN words and a similarity of LEAST.
_P1_ROWS = r"""
WITH t AS (SELECT DISTINCT parent_id, parent_text FROM parent_chunks WHERE parent_id IS NOT NULL),
w AS (SELECT parent_id, regexp_extract_all(lower(parent_text), '[\p{L}\p{N}]+') AS w FROM t),
m AS (SELECT parent_id, CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') END AS c, w FROM w),
c AS (SELECT c, min(parent_id) AS first, any_value(w) AS w FROM m WHERE c IS NOT NULL GROUP BY c),
r AS (SELECT first, unnest(list_distinct(list_transform(range(1, len(w) - RUN + 2), lambda i: array_to_string(w[i:i+RUN-1], ' ')))) AS r FROM c WHERE len(w) >= RUN),
n AS (SELECT first, count(*) AS n FROM r GROUP BY 1),
x AS (SELECT a.first AS a, b.first AS b, count(*) AS k FROM r a JOIN r b ON a.r = b.r AND a.first <> b.first GROUP BY ALL),
l AS (SELECT a AS first, count(*) AS links FROM x JOIN n p ON a = p.first JOIN n q ON b = q.first WHERE k >= LEAST * (p.n + q.n - k) GROUP BY 1)
SELECT m.parent_id, c.first AS class_id, coalesce(l.links, 0) AS links FROM m LEFT JOIN c USING (c) LEFT JOIN l ON l.first = c.first
"""



def _p1_rows_sql(run: int, least: float) -> str:
    return _P1_ROWS.replace("RUN-1", str(run - 1)).replace("RUN", str(run)).replace("LEAST", str(least))


def _p1_groups_sql(run: int, least: float) -> str:
    """Reachability over the near pairs of all parents; a pair of equal texts is near if it has a run."""
    near = _p1_sql(run).replace("\nWITH ", "\nWITH RECURSIVE ", 1).rstrip()
    return f"""{near},
e AS (SELECT a, b FROM c JOIN n p ON a = p.parent_id JOIN n q ON b = q.parent_id WHERE c >= {least} * (p.n + q.n - c)),
w2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM w2 UNION SELECT r.a, w2.b FROM reach r JOIN w2 ON r.b = w2.a)
SELECT a AS parent_id, min(least(a, b)) AS "group" FROM reach GROUP BY a"""


_P3 = """
WITH items AS (
  SELECT query_id, chunk_id, max(CASE WHEN NOT isnan(_distance) THEN -_distance END) a,
         max(CASE WHEN NOT isnan(_relevance_score) THEN _relevance_score END) b, max(CASE WHEN NOT isnan(score) THEN score END) c
  FROM search_hits WHERE chunk_id IS NOT NULL GROUP BY ALL),
ranks AS (
  SELECT query_id, chunk_id,
    rank() OVER (PARTITION BY query_id ORDER BY a DESC NULLS LAST) + (count(*) OVER (PARTITION BY query_id, a) - 1) / 2.0 AS ra,
    rank() OVER (PARTITION BY query_id ORDER BY b DESC NULLS LAST) + (count(*) OVER (PARTITION BY query_id, b) - 1) / 2.0 AS rb,
    rank() OVER (PARTITION BY query_id ORDER BY c DESC NULLS LAST) + (count(*) OVER (PARTITION BY query_id, c) - 1) / 2.0 AS rc
  FROM items),
r AS (SELECT query_id, chunk_id, list_sort([ra, rb, rc])[2]::DOUBLE AS median_rank, (ra + rb + rc)::DOUBLE / 3 AS mean_rank FROM ranks)
"""
_P6 = r"""
WITH RECURSIVE cur AS (SELECT * FROM files WHERE source_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY try_cast(indexed_at AS TIMESTAMPTZ) DESC NULLS LAST) = 1),
a AS (SELECT *, trim(regexp_replace(lower(regexp_replace(regexp_extract(source_path, '[^\\\\/]*$'), '\.[A-Za-z][A-Za-z0-9]{0,4}$', '')), '[\s_]+', ' ', 'g')) AS n0 FROM cur),
b AS (SELECT *, regexp_replace(n0, '^(копия|copy of|copy)(\s*\(\d+\))?\s+([-–—]\s+)?', '') AS n1 FROM a),
c AS (SELECT *, trim(regexp_replace(n1, '(\s*\(\s*\d+\s*\)|\s*[-–—]?\s*\(?(копия|copy)\)?(\s*\(?\d+\)?)?)+$', '')) AS n2 FROM b),
e AS (SELECT *, trim(regexp_replace(n2, '[\s,;(\-–—]*(изменение|изм|ревизия|рев|редакция|ред|revision|rev)\.?\s*№?\s*\d+\)?$', '')) AS n3 FROM c),
k AS (SELECT source_path, modified_at, format, lower(trim(sha256)) AS s, trim(regexp_replace(n3, '(\d\.\d{1,4})-\d{2}$', '\1')) AS n FROM e),
edges AS (SELECT x.source_path AS a, y.source_path AS b FROM k x JOIN k y ON x.n = y.n OR (x.s = y.s AND x.s <> '')),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
roots AS (SELECT a AS source_path, min(b) AS root FROM reach GROUP BY a),
members AS (SELECT k.*, root, coalesce(t.trust_rank, 1073741824) AS r FROM k JOIN roots USING (source_path) LEFT JOIN format_trust t ON lower(regexp_replace(trim(k.format), '^\.', '')) = t.fmt)
"""
_P6_FOUND = """SELECT source_path FROM members QUALIFY count(*) OVER (PARTITION BY root) > 1
  AND row_number() OVER (PARTITION BY root ORDER BY try_cast(modified_at AS TIMESTAMPTZ) DESC NULLS LAST, r, source_path) = 1
"""


def _p6_survivors_sql() -> str:
    """Votes for every field but the path, whose place is by time, trust and order alone."""
    times = ("created_at", "modified_at", "indexed_at")
    fields = [f for f in survive.FIELDS]
    value = {f: f"m.{f}::VARCHAR" if f in ("chunk_count", "is_deprecated") else f"m.{f}" for f in fields}
    plain = "lower(regexp_replace(trim(value), '\\s+', ' ', 'g'))"
    norm = f"CASE WHEN field IN {times} THEN coalesce(epoch_us(try_cast(value AS TIMESTAMPTZ))::VARCHAR, {plain}) WHEN field = 'format' THEN regexp_replace({plain}, '^\\.', '') WHEN field = 'source_path' THEN value ELSE {plain} END"
    rows = " UNION ALL ".join(f"SELECT m.root, m.source_path AS p, '{f}' AS field, {value[f]} AS value, late, m.r, vote FROM m" for f in fields)
    kind = {"chunk_count": "INT", "is_deprecated": "BOOLEAN"}
    out = ", ".join(f"max(CASE WHEN field = '{f}' THEN value END)::{kind.get(f, 'VARCHAR')} AS {f}" for f in fields)
    return f"""{_P6}, full_rows AS (SELECT f.*, k.root, k.r FROM members k JOIN cur f USING (source_path)),
m AS (SELECT *, coalesce(-epoch_us(try_cast(modified_at AS TIMESTAMPTZ)), 4611686018427387904) AS late,
  pow(2.0::DOUBLE, (coalesce(epoch_us(try_cast(modified_at AS TIMESTAMPTZ)), 0) / 86400000000.0::DOUBLE - 18000) / {survive.HALF_LIFE}::DOUBLE) / r AS vote FROM full_rows),
long AS ({rows}), v AS (SELECT *, {norm} AS norm FROM long WHERE trim(value) <> ''),
each AS (SELECT root, field, norm, sum(vote) AS votes, min({{'a': late, 'b': r, 'c': p}}) AS place, arg_min(value, {{'a': late, 'b': r, 'c': p}}) AS value FROM v GROUP BY ALL),
won AS (SELECT root, field, arg_min(value, {{'v': CASE WHEN field = 'source_path' THEN 0.0 ELSE -round(votes, 9) END, 'p': place}}) AS value FROM each GROUP BY ALL),
size AS (SELECT root, count(*) AS n_paths FROM m GROUP BY 1 HAVING count(*) > 1)
SELECT root AS "group", {out}, any_value(n_paths) AS n_paths FROM won JOIN size USING (root) GROUP BY root"""


_P7 = """
WITH v AS (SELECT DISTINCT chunk_id, vector::DOUBLE[] AS v FROM documents_64 WHERE vector IS NOT NULL AND chunk_id IS NOT NULL),
n AS (SELECT chunk_id, v, sqrt(list_dot_product(v, v)) AS n FROM v),
u AS (SELECT chunk_id, list_transform(v, lambda x: x / n) AS v FROM n WHERE n > 0),
p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_dot_product(a.v, b.v) AS c FROM u a JOIN u b ON a.chunk_id <> b.chunk_id),
t AS (SELECT a, b FROM p WHERE c >= 0.9 QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(c, 12) DESC, b) <= 10)
SELECT x.a AS chunk_id_a, x.b AS chunk_id_b FROM t x JOIN t y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b
"""
_P10 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
r AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) ELSE [] END AS r FROM w),
s AS (SELECT doc_id, len(r)::BIGINT AS n_runs, (len(r) - len(list_distinct(r)))::BIGINT AS repeated_runs FROM r)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _p1_sql(3) + "SELECT a AS parent_id_a, b AS parent_id_b FROM c JOIN n p ON a = p.parent_id JOIN n q ON b = q.parent_id WHERE c >= 0.5 * (p.n + q.n - c)",
        "p1_rows": _p1_rows_sql(5, 0.8),
        "p1_members": _p1_rows_sql(3, 0.5),
        "p1_groups": _p1_groups_sql(5, 0.8),
        "p1_member_groups": _p1_groups_sql(3, 0.5),
        "p3_ranking": _P3 + "SELECT query_id, chunk_id, median_rank, mean_rank FROM r",
        "p3_found": _P3 + "SELECT query_id, chunk_id FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY median_rank, mean_rank, chunk_id) <= 5",
        "p6_found": _P6 + _P6_FOUND,
        "p6_survivors": _p6_survivors_sql(),
        "p7_found": _P7,
        "p10_shares": _P10 + "SELECT doc_id, n_runs, repeated_runs, round(repeated_runs / greatest(n_runs, 1), 6) AS repeated_share FROM s",
        "p10_found": _P10 + "SELECT DISTINCT doc_id FROM s WHERE n_runs >= 20 AND repeated_runs >= 0.3 * n_runs",
    }
