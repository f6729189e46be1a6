"""Table analytics, chunking, extraction and evaluation queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import chunking, evaluate, extract, tables
from tesserae.session import load

LABELS = ["Подпор воздуха", "Глубина заложения", "Теплопотеря"]
SUBJECT = ["клапан"]


def _rows(spark, d):
    return tables.text_tables(load(spark, d, "documents"), "doc_id", "text")


def table_rows(spark, d):
    return _rows(spark, d).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "pos", "name", "unit", "unit_key", "qty")


def _matching(spark, d):
    return _rows(spark, d).filter(tables.row_matches(F.col("name"), SUBJECT))


def sum_table_values(spark, d):
    return tables.total(_matching(spark, d).filter("unit_key = 'шт'"), "qty").select("field", "matched", "total", "count", "status", "fallback")


def count_table_values(spark, d):
    return tables.total(_matching(spark, d), op="count", limited=True).select("field", "matched", "count", "status")


def totals_by_unit(spark, d):
    return tables.totals_by_unit(_matching(spark, d), "qty")


def mixed_units_status(spark, d):
    return tables.total(_matching(spark, d), "qty").select("field", "matched", "total", F.size("totals_by_unit").cast("long").alias("units"), "status")


def field_fallback(spark, d):
    return tables.total(_matching(spark, d).filter("unit_key = 'шт'"), "amount", explicit=False).select("field", "total", "count", "status", "fallback")


def group_by_column(spark, d):
    return tables.count_by(_rows(spark, d), F.col("unit"))


def rows_by_section(spark, d):
    r = _rows(spark, d).join(load(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return r.filter("source is not null").groupBy("source").agg(F.count("*").alias("rows"))


def column_signature_groups(spark, d):
    return tables.signatures(_rows(spark, d)).select(F.concat_ws("|", "headers").alias("headers"), "rows", F.col("position").cast("long").alias("position"))


def table_page(spark, d):
    r = _matching(spark, d).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "name")
    return r.orderBy("doc_id", "line_no").offset(10).limit(10)


def section_near_miss(spark, d):
    r = _rows(spark, d).join(load(spark, d, "documents").select("doc_id", F.col("file_name").alias("section_name")), "doc_id")
    mark = F.regexp_extract("name", r"[A-Z]\.[A-Z]\d\.\d\d\.\d\d\d", 0)
    r = r.select(F.col("section_name").alias("section"), mark.alias("mark"), (F.col("doc_id") * 100000 + F.col("line_no")).alias("row_index"))
    return tables.near_sections(r, ["спецификация"]).select("section", "rows", F.array_join("marks", "|").alias("marks"))


def header_mapping(spark, d):
    heads = tables.text_tables(load(spark, d, "documents"), "doc_id", "text").select(F.explode("headers").alias("header")).groupBy("header").agg(F.count("*").alias("cells"))
    return heads.select("header", "cells", tables.header_field(F.col("header")).alias("field"))


def parsed_grids(spark, d):
    lines = load(spark, d, "documents").filter(F.col("text").contains("|")).select("doc_id", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("line_no", "line"))
    cells = lines.select("doc_id", "line_no", F.transform(F.split("line", r"\|"), lambda c: F.trim(c)).alias("cells"))
    return tables.parse_grids(cells, ["doc_id"]).select("doc_id", "line_no", "name", "unit", "qty")


def one_file_per_document(spark, d):
    from tesserae.operators.incremental import current_files

    return tables.one_file_per_document(current_files(load(spark, d, "files"))).select("document", "source_path")


def to_number_ru(spark, d):
    v = load(spark, d, "extracted_values").filter("value_id is not null").dropDuplicates(["value_id"])
    return v.select("value_id", T.number(F.col("evidence")).alias("number"))


def normalise_unit(spark, d):
    return load(spark, d, "extracted_values").select("unit").distinct().select("unit", T.unit(F.col("unit")).alias("unit_key"))


def format_total(spark, d):
    s = load(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_extendedprice"), 2).alias("t"), F.round(F.sum("l_quantity"), 0).alias("q"))
    return s.select("l_returnflag", "l_linestatus", T.formatted(F.col("t")).alias("amount"), T.formatted(F.col("q")).alias("quantity"))


def section_forward_fill(spark, d):
    lines = load(spark, d, "documents").filter(F.col("text").contains("\n#") | F.col("text").startswith("#")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("title", F.when(F.col("line").rlike("^#{1,3} "), F.regexp_replace("line", "^#{1,3} ", "")))
    return tables.fill_sections(lines, "doc_id").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "section")


def labeled_values(spark, d):
    r = extract.labelled_values(load(spark, d, "documents"), "doc_id", "text", LABELS)
    return r.select("doc_id", "record", "label", "value", "unit", "confidence", F.col("line_no").cast("long").alias("line_no"))


def quote_locator(spark, d):
    """Every document whose id is divisible by 100 as a quote, looked for in all documents."""
    pages = load(spark, d, "documents").select("doc_id", "text")
    r = extract.locate_all(pages, pages.filter("doc_id % 100 = 0"), "doc_id", "text", "doc_id")
    return r.select("quote_id", "doc_id", F.col("probe_words").cast("long").alias("probe_words"), F.col("place").cast("long").alias("place"))


def chunk_windows(spark, d):
    w = chunking.windows(chunking.words(F.col("text")), chunking.CHILD, chunking.CHILD_OVERLAP)
    return load(spark, d, "documents").select("doc_id", F.posexplode(w).alias("no", "w")).select("doc_id", F.col("no").cast("long").alias("no"), F.md5(F.array_join("w", " ")).alias("digest"), F.size("w").cast("long").alias("words"))


def chunk_parent_child(spark, d):
    r = chunking.parents_and_children(load(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return r.select("doc_id", "parent_id", "chunk_id", F.md5("child_text").alias("digest"))


def heading_split(spark, d):
    return load(spark, d, "documents").select("doc_id", F.posexplode(chunking.sections(F.col("text"))).alias("no", "s")).select("doc_id", F.col("no").cast("long").alias("no"), F.md5("s").alias("digest"))


def textualise_rows(spark, d):
    r = tables.text_tables(load(spark, d, "documents"), "doc_id", "text")
    return r.select("doc_id", F.col("line_no").cast("long").alias("line_no"), chunking.textualised(r).alias("line"))


def _judged(spark, d):
    h = load(spark, d, "search_hits").filter("chunk_id is not null").groupBy("query_id", "chunk_id").agg(F.min("_distance").alias("_distance"), F.max("score").alias("score"), F.max("_relevance_score").alias("r"))
    return h.withColumn("relevant", F.coalesce(F.col("_distance") < 0.9, F.lit(False)))


def _run(spark, d, by):
    r = evaluate.ranked(_judged(spark, d), "query_id", [F.col(by).desc_nulls_last(), F.asc("chunk_id")])
    return evaluate.case_metrics(r, "query_id", 5)


def eval_cases(spark, d):
    return _run(spark, d, "score").select("query_id", "hit", F.round("rr", 6).alias("rr"), F.round("precision", 6).alias("precision"), "n")


def eval_metrics(spark, d):
    return evaluate.averages(_run(spark, d, "score"))


def _runs(spark, d):
    return _run(spark, d, "score").withColumn("run", F.lit(1)).unionByName(_run(spark, d, "r").withColumn("run", F.lit(2)))


def eval_repeats(spark, d):
    return evaluate.spread(_runs(spark, d), ["query_id"], "rr")


def eval_unstable(spark, d):
    return evaluate.unstable(_runs(spark, d), "query_id", "rr")


def eval_gates(spark, d):
    r = evaluate.ranked(_judged(spark, d), "query_id", [F.desc_nulls_last("score"), F.asc("chunk_id")]).filter("rank <= 5")
    return evaluate.gates(r, "query_id", {"source_any": F.col("relevant"), "source_top_any": F.col("relevant") & (F.col("rank") == 1), "min_score": F.col("score") >= 0.85})


def eval_arms(spark, d):
    a = evaluate.spread(_run(spark, d, "score"), ["query_id"], "rr")
    b = evaluate.spread(_run(spark, d, "r"), ["query_id"], "rr")
    return evaluate.significant(a, b, "query_id")


QUERIES = {
    f.__name__: f
    for f in (
        table_rows, sum_table_values, count_table_values, totals_by_unit, mixed_units_status, field_fallback, group_by_column, rows_by_section, column_signature_groups, table_page, section_near_miss,
        header_mapping, parsed_grids, one_file_per_document, to_number_ru, normalise_unit, format_total, section_forward_fill, labeled_values, quote_locator, chunk_windows, chunk_parent_child,
        heading_split, textualise_rows, eval_cases, eval_metrics, eval_repeats, eval_unstable, eval_gates, eval_arms,
    )
}


def _number(x: str) -> str:
    t = rf"replace(regexp_extract(translate({x}, chr(160) || chr(8239) || chr(8201), '   '), '-?[0-9][0-9 .,]*[0-9]|-?[0-9]'), ' ', '')"
    return f"""(CASE WHEN {t} = '' THEN NULL WHEN contains({t}, '.') AND contains({t}, ',') THEN CASE WHEN instr(reverse({t}), ',') < instr(reverse({t}), '.') THEN try_cast(replace(replace({t}, '.', ''), ',', '.') AS DOUBLE) ELSE try_cast(replace({t}, ',', '') AS DOUBLE) END
WHEN contains({t}, ',') THEN try_cast(replace({t}, ',', '.') AS DOUBLE) WHEN len({t}) - len(replace({t}, '.', '')) > 1 THEN try_cast(replace({t}, '.', '') AS DOUBLE) ELSE try_cast({t} AS DOUBLE) END)"""


_units = ", ".join(f"'{k}': '{v}'" for k, v in T.UNIT_ALIASES.items())


def _unit(x: str) -> str:
    k = rf"regexp_replace(translate(lower(coalesce({x}, '')), 'ё', 'е'), '[\s\x{{A0}}\x{{202F}}.-]', '', 'g')"
    return f"coalesce(MAP {{{_units}}}[{k}], {k})"


def _field(h: str) -> str:
    """The header rules as one CASE, from the same tables."""
    mark = rf"(regexp_matches({h}, '(^|[^\p{{L}}\p{{N}}_])(тип|марка|модель)($|[^\p{{L}}\p{{N}}_])') AND NOT regexp_matches({h}, ',\s*(в|вт|квт|а|гц|дб|дба|мм|см|м|кг|т|па|кпа|%|°c|об/мин|м3/ч|л/с|ч)\s*$|(^|[^\p{{L}}\p{{N}}_])(дб|квт|вт|гц)($|[^\p{{L}}\p{{N}}_])'))"
    out = "CASE " + " ".join(f"WHEN {h} = '{k}' THEN '{v}'" for k, v in tables.EXACT_HEADERS.items())
    for field, hints in tables.HEADER_HINTS.items():
        cond = "(" + " OR ".join(f"contains({h}, '{x}')" for x in hints) + ")"
        out += f" WHEN {cond}{f' AND {mark}' if field == 'mark' else ''} THEN '{field}'"
    return out + " ELSE 'skip' END"


_clean = r"trim(regexp_replace(c, '[\s\x{A0}]+', ' ', 'g'))"
_h = r"trim(regexp_replace(lower(h), '\s+', ' ', 'g'))"
# tables as islands: a table's number is how many lines up to it begin one
_TT = rf"""lines AS (SELECT doc_id, unnest(list_zip(range(1, len(l) + 1), l)) AS x FROM (SELECT doc_id, string_split_regex(text, '\r\n|\n|\r') AS l FROM documents WHERE contains(text, '|'))),
cells AS (SELECT doc_id, x[1]::BIGINT AS line_no, list_transform(string_split(x[2], '|'), lambda c: {_clean}) AS c FROM lines WHERE len(x[2]) - len(replace(x[2], '|', '')) >= 2),
named AS (SELECT *, len(list_filter(list_distinct(list_transform(c, lambda h: HEADER_FIELD)), lambda f: f <> 'skip')) AS known, NOT regexp_matches(array_to_string(c, '|'), '\p{{Nd}}') AS wordy FROM cells),
begins AS (SELECT *, coalesce(line_no - lag(line_no) OVER w <> 1 OR len(c) <> lag(len(c)) OVER w, true) OR (wordy AND known >= 2) AS b FROM named WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
numbered AS (SELECT *, sum(b::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS t FROM begins),
tt AS (SELECT n.doc_id, n.line_no, h.c AS headers, n.c AS cells FROM numbered n JOIN numbered h ON n.doc_id = h.doc_id AND n.t = h.t AND h.b WHERE NOT n.b)""".replace("HEADER_FIELD", _field(r"trim(regexp_replace(lower(h), '\s+', ' ', 'g'))"))
_TYPED = rf"""{_TT}, f AS (SELECT *, list_transform(headers, lambda h: {_field(_h)}) AS f FROM tt),
rows AS (SELECT doc_id, line_no, headers, cells,
  list_filter(list_transform(range(1, len(f) + 1), lambda i: CASE WHEN f[i] = 'pos' THEN cells[i] END), lambda v: len(v) > 0)[1] AS pos,
  list_filter(list_transform(range(1, len(f) + 1), lambda i: CASE WHEN f[i] = 'name' THEN cells[i] END), lambda v: len(v) > 0)[1] AS name,
  list_filter(list_transform(range(1, len(f) + 1), lambda i: CASE WHEN f[i] = 'unit' THEN cells[i] END), lambda v: len(v) > 0)[1] AS unit,
  list_filter(list_transform(range(1, len(f) + 1), lambda i: CASE WHEN f[i] = 'qty' THEN {_number('cells[i]')} END), lambda v: v IS NOT NULL)[1] AS qty FROM f),
r AS (SELECT *, {_unit('unit')} AS unit_key FROM rows), m AS (SELECT * FROM r WHERE contains(lower(name), 'клапан'))"""
_JUDGED = "j AS (SELECT query_id, chunk_id, min(_distance) AS _distance, max(score) AS score, max(_relevance_score) AS r, coalesce(min(_distance) < 0.9, false) AS relevant FROM search_hits WHERE chunk_id IS NOT NULL GROUP BY ALL)"


def _cases(by: str, name: str) -> str:
    return f"""{name} AS (SELECT query_id, max(relevant::INT) AS hit, coalesce(1.0::DOUBLE / min(rank) FILTER (relevant), 0) AS rr, avg(relevant::INT) AS precision, count(*) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {by} DESC NULLS LAST, chunk_id) AS rank FROM j) WHERE rank <= 5 GROUP BY 1)"""


_rec = r"[А-ЯA-Z]{1,3}\d?-[А-ЯA-Z0-9]{2,}-\d{2}-\d{2}"
_lab = "CASE " + " ".join(f"WHEN contains(lower(line), '{x.lower()}') THEN '{x}'" for x in LABELS) + " END"
_words = r"list_filter(string_split(trim(regexp_replace(text, '[\s\x{A0}\x{85}\x{2000}-\x{200A}\x{202F}\x{3000}\x{2028}\x{2029}\x{1680}\x{205F}]+', ' ', 'g')), ' '), lambda w: len(w) > 0)"

SQL = {
    "table_rows": f"WITH {_TYPED} SELECT doc_id, line_no, pos, name, unit, unit_key, qty FROM r",
    "sum_table_values": f"WITH {_TYPED} SELECT 'qty' AS field, count(*) > 0 AS matched, round(sum(qty), 4) AS total, count(qty) AS count, CASE WHEN count(*) = 0 THEN 'NOT_FOUND' ELSE 'VERIFIED' END AS status, false AS fallback FROM m WHERE unit_key = 'шт'",
    "count_table_values": f"WITH {_TYPED} SELECT 'qty' AS field, count(*) > 0 AS matched, count(*) AS count, CASE WHEN count(*) > 0 THEN 'PARTIAL' ELSE 'NOT_FOUND' END AS status FROM m",
    "totals_by_unit": f"WITH {_TYPED} SELECT unit_key, round(sum(qty), 4) AS total, count(*) AS count FROM m WHERE qty IS NOT NULL GROUP BY 1",
    "mixed_units_status": f"WITH {_TYPED}, u AS (SELECT count(DISTINCT unit_key) FILTER (qty IS NOT NULL) AS u, count(*) AS n, sum(qty) AS t FROM m) SELECT 'qty' AS field, n > 0 AS matched, CASE WHEN u <= 1 AND n > 0 THEN round(t, 4) END AS total, u AS units, CASE WHEN n = 0 THEN 'NOT_FOUND' WHEN u > 1 THEN 'MIXED_UNITS' ELSE 'VERIFIED' END AS status FROM u",
    "field_fallback": f"WITH {_TYPED} SELECT CASE WHEN count(qty) > 0 THEN 'qty' ELSE 'amount' END AS field, CASE WHEN count(qty) > 0 THEN round(sum(qty), 4) END AS total, count(qty) AS count, CASE WHEN count(*) = 0 THEN 'NOT_FOUND' ELSE 'VERIFIED' END AS status, count(qty) > 0 AS fallback FROM m WHERE unit_key = 'шт'",
    "group_by_column": f"WITH {_TYPED} SELECT unit AS value, count(*) AS count FROM r WHERE unit <> '' GROUP BY 1",
    "rows_by_section": f"WITH {_TT} SELECT source, count(*) AS rows FROM tt JOIN (SELECT doc_id, source FROM documents) USING (doc_id) WHERE source IS NOT NULL GROUP BY 1",
    "column_signature_groups": f"WITH {_TT}, g AS (SELECT array_to_string(headers, '|') AS headers, count(*) AS rows FROM tt GROUP BY 1) SELECT headers, rows, row_number() OVER (ORDER BY rows DESC, headers) AS position FROM g",
    "table_page": f"WITH {_TYPED} SELECT doc_id, line_no, name FROM m ORDER BY doc_id, line_no LIMIT 10 OFFSET 10",
    "section_near_miss": f"""WITH {_TYPED}, s AS (SELECT file_name AS section, regexp_extract(name, '[A-Z]\\.[A-Z]\\d\\.\\d\\d\\.\\d\\d\\d') AS mark, doc_id * 100000 + line_no AS i FROM r JOIN (SELECT doc_id, file_name FROM documents) USING (doc_id) WHERE contains(lower(file_name), 'спецификаци')),
k AS (SELECT section, mark, min(i) AS i FROM s WHERE mark <> '' GROUP BY ALL), t AS (SELECT section, string_agg(mark, '|' ORDER BY i) AS marks FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY section ORDER BY i) <= 8) GROUP BY 1)
SELECT section, n AS rows, coalesce(marks, '') AS marks FROM (SELECT section, count(*) AS n FROM s GROUP BY 1) LEFT JOIN t USING (section)""",
    "header_mapping": f"WITH {_TT}, h AS (SELECT h, count(*) AS cells FROM (SELECT unnest(headers) AS h FROM tt) GROUP BY 1) SELECT h AS header, cells, {_field(_h)} AS field FROM h",
    "one_file_per_document": r"""WITH cur AS (SELECT * FROM files WHERE source_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY try_cast(indexed_at AS TIMESTAMPTZ) DESC NULLS LAST) = 1),
k AS (SELECT source_path, regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(source_path, '[^\\/]*$'), '\.[A-Za-z][A-Za-z0-9]{0,4}$', '')), '[\s_]*\(\d+\)$', ''), '-\d{2}$', '') AS document, coalesce(modified_at, '') AS m,
coalesce(try_cast(regexp_extract(source_path, '-(\d{2})[\s_]*(?:\(\d+\))?\.[A-Za-z]+$', 1) AS INT), 0) AS i, coalesce(list_position(['xlsx', 'csv', 'docx', 'pdf'], lower(regexp_extract(source_path, '\.([A-Za-z]+)$', 1))), 5) AS f FROM cur)
SELECT document, source_path FROM k QUALIFY row_number() OVER (PARTITION BY document ORDER BY m DESC, i DESC, f, source_path) = 1""",
    "to_number_ru": f"SELECT DISTINCT value_id, {_number('evidence')} AS number FROM extracted_values WHERE value_id IS NOT NULL",
    "normalise_unit": f"SELECT DISTINCT unit, {_unit('unit')} AS unit_key FROM extracted_values",
    "format_total": "WITH s AS (SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS t, round(sum(l_quantity), 0) AS q FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_linestatus, CASE WHEN t = floor(t) THEN replace(format('{:,.0f}', t), ',', ' ') ELSE replace(format('{:,.2f}', t), ',', ' ') END AS amount, replace(format('{:,.0f}', q), ',', ' ') AS quantity FROM s",
    "section_forward_fill": r"""WITH l AS (SELECT doc_id, unnest(list_zip(range(0, len(l)), l)) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE contains(text, chr(10) || '#') OR starts_with(text, '#'))),
t AS (SELECT doc_id, x[1]::BIGINT AS line_no, CASE WHEN regexp_matches(x[2], '^#{1,3} ') THEN regexp_replace(x[2], '^#{1,3} ', '') END AS t FROM l)
SELECT doc_id, line_no, last_value(t IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM t""",
    "labeled_values": rf"""WITH l AS (SELECT doc_id, unnest(list_zip(range(1, len(l) + 1), l)) AS x FROM (SELECT doc_id, string_split_regex(text, '\r\n|\n|\r') AS l FROM documents)),
a AS (SELECT doc_id, x[1]::BIGINT AS n, trim(regexp_replace(x[2], '[\s\x{{A0}}\x{{202F}}\f]+', ' ', 'g')) AS line FROM l),
b AS (SELECT *, nullif(regexp_extract(line, '(?i)(^|[^\p{{L}}\p{{N}}_])({_rec}(\s*\([^)]{{1,40}}\))?)($|[^\p{{L}}\p{{N}}_])', 2), '') AS rec, {_lab} AS label,
  regexp_extract(line, '(?i)(-?\d+(?:[,.]\d+)?)\s*(кПа|Па|м3/ч|м³/ч|м/с|кВт|Вт|мм|м|кг|%)?(?:$|[^\p{{L}}\p{{N}}_])', ['v', 'u']) AS v FROM a),
c AS (SELECT *, last_value(rec IGNORE NULLS) OVER w AS now, lead(n, 1) OVER w AS n1, lead(n, 2) OVER w AS n2, lead(n, 3) OVER w AS n3,
  {', '.join(f"lead(line, {k}) OVER w AS l{k}, lead(rec, {k}) OVER w AS r{k}, lead(label, {k}) OVER w AS b{k}, lead(v, {k}) OVER w AS v{k}" for k in (1, 2, 3))} FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, l1 <> '' AND (r1 IS NOT NULL OR b1 IS NOT NULL) AS s1, l2 <> '' AND (r2 IS NOT NULL OR b2 IS NOT NULL) AS s2, l3 <> '' AND (r3 IS NOT NULL OR b3 IS NOT NULL) AS s3 FROM c WHERE label IS NOT NULL AND now IS NOT NULL AND line <> ''),
e AS (SELECT doc_id, now AS record, label, CASE WHEN v.v <> '' AND rec IS NULL THEN 0 WHEN NOT s1 AND v1.v <> '' THEN 1 WHEN NOT s1 AND NOT s2 AND v2.v <> '' THEN 2 WHEN NOT s1 AND NOT s2 AND NOT s3 AND v3.v <> '' THEN 3 END AS k, n, v, v1, v2, v3 FROM d),
f AS (SELECT *, CASE k WHEN 0 THEN v WHEN 1 THEN v1 WHEN 2 THEN v2 ELSE v3 END AS x FROM e WHERE k IS NOT NULL)
SELECT doc_id, record, label, replace(x.v, ',', '.')::DOUBLE AS value, x.u AS unit, CASE WHEN k = 0 THEN 0.82 WHEN x.u <> '' THEN 0.88 ELSE 0.72 END::DOUBLE AS confidence, n + k AS line_no FROM f""",
    "chunk_windows": f"""WITH w AS (SELECT doc_id, {_words} AS w FROM documents), s AS (SELECT doc_id, w, unnest(CASE WHEN len(w) > 0 THEN range(1, greatest(1, len(w) - 20) + 1, 130) ELSE [] END) AS s FROM w)
SELECT doc_id, (s - 1) // 130 AS no, md5(array_to_string(w[s:s + 149], ' ')) AS digest, len(w[s:s + 149])::BIGINT AS words FROM s""",
    "chunk_parent_child": rf"""WITH t AS (SELECT doc_id, string_split(regexp_replace(text, '(?m)^(#{{1,3}} )', chr(1) || '\1', 'g'), chr(1)) AS s FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, list_filter(s, lambda x: len(trim(x, ' ')) > 0) AS s FROM t), u AS (SELECT doc_id, unnest(list_zip(range(0, len(s)), s)) AS x FROM f),
w AS (SELECT doc_id, x[1] AS sec, {_words.replace('text', 'x[2]')} AS w FROM u),
p AS (SELECT doc_id, sec, s AS ps, w[s:s + 999] AS p FROM (SELECT doc_id, sec, w, unnest(CASE WHEN len(w) > 0 THEN range(1, greatest(1, len(w) - 100) + 1, 900) ELSE [] END) AS s FROM w)),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sec, ps) - 1 AS pno FROM p),
c AS (SELECT doc_id, pno, s, p[s:s + 149] AS c FROM (SELECT *, unnest(range(1, greatest(1, len(p) - 20) + 1, 130)) AS s FROM n)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pno, s) - 1 AS cno, substr(sha256(doc_id::VARCHAR), 1, 8) AS h FROM c)
SELECT doc_id, h || '_p_' || lpad(pno::VARCHAR, 4, '0') AS parent_id, h || '_c_' || lpad(cno::VARCHAR, 4, '0') AS chunk_id, md5(array_to_string(c, ' ')) AS digest FROM k""",
    "quote_locator": r"""WITH n AS (SELECT doc_id, lower(trim(regexp_replace(text, '[\s\x{A0}\x{202F}\x{2009}]+', ' ', 'g'))) AS t FROM documents WHERE text IS NOT NULL),
q AS (SELECT doc_id AS quote_id, list_filter(string_split(t, ' '), lambda w: len(w) > 0) AS w FROM n WHERE doc_id % 100 = 0),
p AS (SELECT quote_id, k, array_to_string(w[least(3, len(w) - k) + 1:least(3, len(w) - k) + k], ' ') AS p FROM q, (SELECT unnest([12, 8, 5]) AS k) WHERE len(w) >= k),
h AS (SELECT quote_id, doc_id, k FROM p JOIN n ON contains(t, p)), b AS (SELECT * FROM h QUALIFY k = max(k) OVER (PARTITION BY quote_id))
SELECT quote_id, doc_id, k::BIGINT AS probe_words, row_number() OVER (PARTITION BY quote_id ORDER BY doc_id) AS place FROM b QUALIFY place <= 3""",
    "heading_split": r"""WITH t AS (SELECT doc_id, string_split(regexp_replace(text, '(?m)^(#{1,3} )', chr(1) || '\1', 'g'), chr(1)) AS s FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, list_filter(s, lambda x: len(trim(x, ' ')) > 0) AS s FROM t), u AS (SELECT doc_id, unnest(list_zip(range(0, len(s)), s)) AS x FROM f) SELECT doc_id, x[1]::BIGINT AS no, md5(x[2]) AS digest FROM u""",
    "textualise_rows": f"WITH {_TT} SELECT doc_id, line_no, array_to_string(list_filter(list_transform(range(1, len(headers) + 1), lambda i: CASE WHEN len(cells[i]) > 0 THEN headers[i] || ': ' || cells[i] END), lambda x: x IS NOT NULL), '. ') AS line FROM tt",
    "eval_cases": f"WITH {_JUDGED}, {_cases('score', 'a')} SELECT query_id, hit, round(rr, 6) AS rr, round(precision, 6) AS precision, n FROM a",
    "eval_metrics": f"WITH {_JUDGED}, {_cases('score', 'a')} SELECT count(*) AS n, round(avg(hit), 6) AS hit_rate, round(avg(rr), 6) AS mrr, round(avg(precision), 6) AS precision FROM a",
    "eval_repeats": f"WITH {_JUDGED}, {_cases('score', 'a')}, {_cases('r', 'b')}, u AS (SELECT query_id, rr FROM a UNION ALL SELECT query_id, rr FROM b) SELECT query_id, round(median(rr), 6) AS median, round(min(rr), 6) AS least, round(max(rr), 6) AS most, round(round(max(rr), 6) - round(min(rr), 6), 6) AS spread FROM u GROUP BY 1",
    "eval_unstable": f"WITH {_JUDGED}, {_cases('score', 'a')}, {_cases('r', 'b')}, u AS (SELECT query_id, rr FROM a UNION ALL SELECT query_id, rr FROM b) SELECT query_id, count(DISTINCT round(rr, 3)) AS values FROM u GROUP BY 1 HAVING count(DISTINCT round(rr, 3)) > 1",
    "eval_gates": f"""WITH {_JUDGED}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, chunk_id) AS rank FROM j QUALIFY rank <= 5),
g AS (SELECT query_id, bool_or(relevant) AS a, bool_or(relevant AND rank = 1) AS b, coalesce(bool_or(score >= 0.85), false) AS c FROM t GROUP BY 1)
SELECT query_id, concat_ws(',', CASE WHEN NOT a THEN 'source_any' END, CASE WHEN NOT b THEN 'source_top_any' END, CASE WHEN NOT c THEN 'min_score' END) AS failed FROM g""",
    "eval_arms": f"WITH {_JUDGED}, {_cases('score', 'a')}, {_cases('r', 'b')} SELECT query_id, round(round(b.rr, 6) - round(a.rr, 6), 6) AS delta, abs(round(round(b.rr, 6) - round(a.rr, 6), 6)) > 0 AS significant FROM a JOIN b USING (query_id)",
}
