"""Operators on the small cases a retrieval engine must get right."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import chunking, corpus, evaluate, extract, graph, lexical, quality, retrieval, tables
from tesserae.functions.text import unit as T_unit
from tesserae.plans import routing


def test_exact_channel(spark):
    rows = [("a", "Система П1-TRF-01-02 аварийный", [1.0, 0.0, 0.0, 0.0]), ("b", "Система П1-TRF-01-01", [0.0, 0.0, 1.0, 0.0]), ("c", "П1-TRF-01-01 ближе", [1.0, 0.1, 0.0, 0.0]), ("d", "код A'1-B-2", None), ("e", None, None), ("f", "", [0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "chunk_id string, text string, vector array<float>")
    assert [r["chunk_id"] for r in retrieval.exact_channel(df, ["П1-TRF-01-01"], [1.0, 0.0, 0.0, 0.0]).collect()] == ["c", "b"]
    assert [r["chunk_id"] for r in retrieval.exact_channel(df, ["A'1-B-2"]).collect()] == ["d"]
    assert [r["chunk_id"] for r in retrieval.dense_topk(df, [1.0, 0.0, 0.0, 0.0], 9).collect()] == ["a", "c", "b"]


def test_occurrences(spark):
    rows = [(1, "ОВ2.pdf", "Клапан КПУ-1 в системе П1-TRF-01-01, этаж 2."), (2, "ОВ2.pdf", "Система п1-trf-01-01 обслуживает коридор."), (3, "ОВ2.pdf", "Соседняя П1-TRF-01-012"), (4, "АР.pdf", "План, П1-TRF-01-01 в шахте."), (5, "x", None)]
    df = spark.createDataFrame(rows, "id int, file string, text string")
    hits = retrieval.occurrences(df, "П1-TRF-01-01")
    assert {r["file"]: r["count"] for r in hits.groupBy("file").count().collect()} == {"ОВ2.pdf": 2, "АР.pdf": 1}
    first, second = (retrieval.page(hits, ["id"], o, 2).select("id").collect() for o in (0, 2))
    assert [r[0] for r in first + second] == [1, 2, 4]
    with pytest.raises(ValueError):
        retrieval.occurrences(df, "ab")


def test_focus_fill_and_diversify(spark):
    rows = [(1, 1, "d1", 0.92, "t1"), (1, 2, "d1", 0.85, "t2"), (1, 3, "d2", 0.80, "t3"), (1, 4, "d3", 0.45, "t3"), (1, 5, "d4", 0.30, "t5"), (2, 1, "d9", 0.1, "t1")]
    df = spark.createDataFrame(rows, "q int, rank int, doc string, score double, text string")
    got = sorted((r["q"], r["doc"]) for r in retrieval.focus(df, "q", "doc", 0.4, 2).select("q", "doc").distinct().collect())
    assert got == [(1, "d1"), (1, "d2"), (2, "d9")]
    assert retrieval.focus(df.limit(0), "q", "doc").count() == 0
    assert [r["rank"] for r in retrieval.diversify_exact(df.filter("q = 1"), "q", "doc", 3, 1).orderBy("rank").collect()] == [1, 3, 5]
    assert [r["rank"] for r in retrieval.diversify(df.filter("q = 1"), "q", "doc", 9, 1).orderBy("rank").collect()] == [1, 3, 5]
    # a row bounded out must not use up its text for another document
    x = spark.createDataFrame([(1, 1, "a", 1.0, "p"), (1, 2, "a", 0.9, "s"), (1, 3, "b", 0.8, "s")], df.schema)
    assert [r["rank"] for r in retrieval.diversify_exact(x, "q", "doc", 9, 1).orderBy("rank").collect()] == [1, 3]
    filled = retrieval.fill(df.filter("rank = 2 and q = 1"), df.filter("q = 1"), "q", "rank", 3)
    assert [r["rank"] for r in filled.orderBy("position").collect()] == [2, 1, 3]


def test_cache_bounds(spark):
    now = F.lit("2025-01-31").cast("timestamp")
    c = spark.sql("select id, timestamp'2025-01-30' + make_interval(0,0,0,0,id) created_at from range(5) union all select 99L, timestamp'2025-01-01'")
    assert sorted(r["id"] for r in retrieval.cache_keep(c, now, 14, 3).collect()) == [2, 3, 4]


def test_maxsim(spark):
    t = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "i int, qv array<double>")
    p = spark.createDataFrame([("a", [2.0, 0.0]), ("a", [0.0, 3.0]), ("b", [1.0, 0.0]), ("b", None)], "page string, vector array<float>")
    assert {r["page"]: round(r["maxsim"], 6) for r in retrieval.maxsim(p, t, "page").collect()} == {"a": 1.0, "b": 0.5}


def test_grade_and_decision(spark):
    g = spark.createDataFrame([(0.6, 3), (0.4, 3), (0.1, 3), (None, 0)], "t double, n int").select(retrieval.grade(F.col("t"), F.col("n")).alias("v"))
    assert [r["v"]["grade"] for r in g.collect()] == ["correct", "ambiguous", "incorrect", "incorrect"]


def test_evaluation(spark):
    r = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, True), ("b", 1, False)], "c string, rank int, relevant boolean")
    m = {x["c"]: (x["hit"], x["rr"], round(x["precision"], 4)) for x in evaluate.case_metrics(r, "c", 3).collect()}
    assert m == {"a": (1, 0.5, 0.6667), "b": (0, 0.0, 0.0)}


SIMPLE = [["Поз.", "Наименование", "Ед. изм.", "Кол-во"], ["1", "Воздуховод 300x400", "м", "30,5"], ["2", "Отвод 90° 300x400", "шт.", "8"]]
GOST = [["Отопительные агрегаты", "", "", ""], ["Обозна-\nчение", "Наимено-\nвание", "Вентилятор", ""], ["", "", "L, м3/ч", "Кол."], ["1", "2", "3", "4"], ["П1", "Агрегат", "100", "2"], ["П2", "Агрегат 2", "200", "3"], ["Воздушно-тепловые завесы", "", "", ""], ["У1", "КЭВ-200П512W", "1", "1"]]
HEADERLESS = [["", "Клапан обратный", "RD-1", "шт.", "2"], ["", "Клапан запорный", "RD-2", "шт.", "4"], ["", "Воздуховод прямой", "", "м", "7,5"]]


def test_grids(spark):
    a = tables.Grid(SIMPLE).rows()
    assert [(r["pos"], r["name"], r["unit"], r["qty"]) for r in a] == [("1", "Воздуховод 300x400", "м", 30.5), ("2", "Отвод 90° 300x400", "шт.", 8.0)]
    b = tables.Grid(GOST).rows()
    assert [(r["pos"], r["qty"], r["section"]) for r in b] == [("П1", 2.0, "Отопительные агрегаты"), ("П2", 3.0, "Отопительные агрегаты"), ("У1", 1.0, "Воздушно-тепловые завесы")]
    assert [(r["name"], r["unit"], r["qty"]) for r in tables.Grid(HEADERLESS).rows()] == [("Клапан обратный", "шт.", 2.0), ("Клапан запорный", "шт.", 4.0), ("Воздуховод прямой", "м", 7.5)]
    assert tables.Grid([]).rows() == [] and tables.Grid([["x"]]).rows() == []
    lines = spark.createDataFrame([("f", 0, i, r) for i, r in enumerate(SIMPLE)], "file string, table_no int, line_no int, cells array<string>")
    assert tables.parse_grids(lines, ["file", "table_no"]).count() == 2


def test_spans():
    m = [[{"text": "Система", "rowspan": 2}, {"text": "Вентилятор", "colspan": 2}], [{"text": "L, м3/ч"}, {"text": "P, Па"}], [{"text": "П1"}, {"text": "1"}, {"text": "2"}]]
    assert tables.expand_spans(m) == [["Система", "Вентилятор", "Вентилятор"], ["Система", "L, м3/ч", "P, Па"], ["П1", "1", "2"]]


def typed(spark, rows):
    return spark.createDataFrame(rows, "unit string, qty double, amount double").withColumn("unit_key", T_unit(F.col("unit")))


def test_totals(spark):
    r = typed(spark, [("м", 61.27, 0.0), ("м.", 37.1, 0.0), ("шт.", 2.0, 0.0)])
    one = tables.total(r).first()
    assert one["status"] == "MIXED_UNITS" and one["total"] is None and {(x["unit"], x["total"], x["count"]) for x in one["totals_by_unit"]} == {("м", 98.37, 2), ("шт", 2.0, 1)}
    same = typed(spark, [("м", 1.0, 0.0), ("п.м.", 2.0, 0.0), ("М", 4.0, 0.0)])
    assert tables.total(same).first()["total"] == 7.0
    assert tables.total(same, "amount").first()["total"] == 0.0
    auto = tables.total(same, "amount", explicit=False).first()
    assert (auto["field"], auto["total"], auto["fallback"]) == ("qty", 7.0, True)
    assert tables.total(same, unreadable=1).first()["status"] == "PARTIAL"
    none = tables.total(same.limit(0)).first()
    assert not none["matched"] and none["status"] == "NOT_FOUND"


def test_labelled_values(spark):
    t = "SYS-AUX-01-01\nчто-то\nПараметр настройки\n400 Па\nСкорость\nSYS-AUX-01-02\n5 м/с\nПараметр настройки 7,5"
    df = spark.createDataFrame([(1, t), (2, None), (3, "")], "id int, text string")
    got = [(r["record"], r["value"], r["unit"], r["line_no"]) for r in extract.labelled_values(df, "id", "text", ["Параметр настройки", "Скорость"]).collect()]
    assert got == [("SYS-AUX-01-01", 400.0, "Па", 4), ("SYS-AUX-01-02", 7.5, "", 8)]


def test_chunking(spark):
    t = "# A\n" + " ".join(f"w{i}" for i in range(400)) + "\n## B\nxyz"
    df = spark.createDataFrame([(1, t), (2, ""), (3, None)], "id int, text string")
    rows = chunking.parents_and_children(df, "id", "text").orderBy("child_no").collect()
    assert [r["child_no"] for r in rows] == list(range(len(rows))) and rows[-1]["child_text"] == "## B xyz"
    assert set(rows[0]["child_text"].split()) | {"x"} and {w for r in rows for w in r["child_text"].split()} >= {f"w{i}" for i in range(400)}
    assert chunking.code_chunks("def f(:\n") == ["def f(:\n"]


def test_rules_and_replace(spark):
    rules = spark.createDataFrame([(1, "s", "r"), (2, "s", "r"), (3, "s", "r"), (4, "s", "q")], "id int, s string, r string")
    assert tuple(corpus.duplicate_stats(rules, ["s", "r"]).first()) == (1, 2)
    assert sorted(r["id"] for r in corpus.keep_first(rules, ["s", "r"], "id").collect()) == [1, 4]
    base = spark.createDataFrame([("d", "c1"), ("d", "c2"), ("e", "c3")], "doc_id string, chunk_id string")
    new = spark.createDataFrame([("d", "c1")], base.schema)
    assert sorted(map(tuple, corpus.replace_document(base, new, "d").collect())) == [("d", "c1"), ("e", "c3")]
    assert corpus.replace_document(base, new.limit(0), "d").count() == 1
    with pytest.raises(ValueError):
        corpus.replace_document(base, new.union(new), "d")


def test_lexical(spark):
    df = spark.createDataFrame([(1, "клапан обратный клапан"), (2, "вентилятор"), (3, None), (4, "")], "id int, text string")
    got = lexical.bm25(df, "id", "text", ["клапан"]).collect()
    assert [r["id"] for r in got] == [1]
    v = df.filter("id = 1").select(lexical.sparse_vector(F.col("text")).alias("v")).first()["v"]
    assert sorted(v.values()) == [1.0, 2.0]
    assert quality.query_words("как расход для 12") == ["расход"]


def test_routing():
    assert routing.codes_of("расход 60 м3/ч для R.L2.15.114 и 12,5") == ["R.L2.15.114"]
    assert routing.norms_of("СП 60.13330 и 123-ФЗ, пункт 7.4.1") == ["СП 60.13330", "123-ФЗ"]
    p = routing.plan("R.L2.15.114 где стоит")
    assert p.alpha == 0.25 and p.queries == ("R.L2.15.114 где стоит",) and "exact" in p.channels
    assert routing.route("предел огнестойкости по пожарным требованиям").dataset == "normative"
    assert routing.route("").name == "default"
    assert routing.distinct_queries(["А  б", "а б", "в"], 4) == ("А б", "в")


def test_edges_are_found_in_the_chunks(spark, monkeypatch):
    monkeypatch.setattr(graph, "CENTRES", 7)
    monkeypatch.setattr(graph, "CHUNKS", 50)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 4)).astype(np.float32)
    of = [f"d{i % 20:02d}" if i < 120 else "d00" for i in range(200)]
    rows = [(d, [float(y) for y in v]) for d, v in zip(of, x)] + [("d03", None), ("d03", [0.0] * 4), (None, [1.0] * 4), ("odd", [1.0]), ("zero", [0.0] * 4)]
    got = {(r["doc_id_a"], r["doc_id_b"]): r["similarity"] for r in graph.build_edges(spark.createDataFrame(rows, "doc_id string, vector array<float>"), 4, 3).collect()}
    have = [(d, np.array(v)) for d, v in rows if d and v and len(v) == 4]
    want: dict = {}
    for a in {d for d, _ in have}:
        c = np.mean([v for d, v in have if d == a], axis=0)
        best = {b: max([float(v @ c / np.linalg.norm(v) / np.linalg.norm(c)) for d, v in have if d == b and v.any()], default=None) for b in {d for d, _ in have} if b != a and c.any()}
        for b, s in sorted(((b, s) for b, s in best.items() if s is not None), key=lambda p: (-p[1], p[0]))[:3]:
            for pair in ((a, b), (b, a)):
                want[pair] = max(want.get(pair, 0.0), s)
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-6 for p in want)
    assert graph.build_edges(spark.createDataFrame([], "doc_id string, vector array<float>"), 4, 3).count() == 0


def test_inflected_words_are_one_term(spark):
    df = spark.createDataFrame([(1, "обратные клапаны"), (2, "нет клапана"), (3, "клапан"), (4, "клапанный вентилятор"), (5, None), (6, "")], "id int, text string")
    assert sorted(r["id"] for r in lexical.bm25_stemmed(df, "id", "text", "о клапане").collect()) == [1, 2, 3]
    assert lexical.bm25_stemmed(df, "id", "text", "и").count() == 0
    assert {(r["id"], r["term"]) for r in lexical.sparse_terms(df, "id", "text").collect()} >= {(1, "клапан"), (2, "клапан"), (3, "клапан")}


def test_search_finds_inflected_words(spark):
    from tesserae.operators.embed import Hashing
    from tesserae.plans import search

    rows = [(f"c{i}", f"d{i}", t, [0.0] * 64, f"Q:/{i}.pdf", f"{i}.pdf", None, None, None) for i, t in enumerate(["ремонт чиллеров", "ремонт насоса", "клапаны"])]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id string, text string, vector array<float>, source_path string, file_name string, parent_id string, modified_at string, namespace string")
    parents = spark.createDataFrame([], "parent_id string, source_path string, parent_text string, created_at string")
    plan = routing.plan("чиллера", 5)
    got = search._one(search.Corpus(chunks, parents), "чиллера", plan, Hashing(64), F.lit(True), 0)[0].collect()
    assert [r["chunk_id"] for r in got] == ["c0"]


def test_all_quotes_are_located(spark):
    said = [" ".join(f"слово{i}x{j}" for j in range(14)) for i in range(60)]
    quotes = spark.createDataFrame([(i, t) for i, t in enumerate(said)] + [(90, "одно два"), (91, None), (92, "а б  в\nг Д")], "id bigint, text string")
    pages = [(f"p{i:02d}", f"Начало {t.upper()} конец") for i, t in enumerate(said)] + [("odd", "пра б в г дом"), ("whole", "кА б в г Да"), ("none", None), ("same", said[7])]
    got = [tuple(r) for r in extract.locate_all(spark.createDataFrame(pages, "page string, text string"), quotes, "page", "text", "id").collect()]
    # a probe may begin and end within a page's words, as contains has it
    assert sorted(got) == sorted([(i, f"p{i:02d}", 12, 1) for i in range(60)] + [(7, "same", 12, 2), (92, "odd", 5, 1), (92, "whole", 5, 2)])


def test_several_tables_in_one_text(spark):
    from tesserae.operators.tables import text_tables

    text = "\n".join((
        "Поз. | Наименование | Кол-во", "1 | насос | 2", "2 | клапан | 3",
        "Наименование | Поз. | Кол-во", "вентиль | 7 | 4",
        "Поз. | Наименование | Ед. изм. | Кол-во", "1 | труба | м | 12,5",
        "текст без таблицы", "Марка | Тип | Прим.", "А | Б | В",
        "Поз. | Наименование | Кол-во", "9 | люк | 1", "одна | черта",
    ))
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "a | b"), (5, "x | y | z")], "k int, text string")
    rows = text_tables(df, "k", "text").orderBy("line_no").collect()
    assert [(r["table_no"], r["line_no"], r["pos"], r["name"], r["unit"], r["qty"]) for r in rows] == [
        (0, 2, "1", "насос", None, 2.0), (0, 3, "2", "клапан", None, 3.0), (1, 5, "7", "вентиль", None, 4.0),
        (2, 7, "1", "труба", "м", 12.5), (3, 10, None, None, None, None), (4, 12, "9", "люк", None, 1.0),
    ]


def test_one_text_functions_equal_their_columns(spark):
    from pyspark.sql import functions as F

    from tesserae.functions import text as T
    from tesserae.operators import tables

    texts = ["1 234,5 м", "-7.5", "1.234.567", "1,234.56", "1.234,56", "нет", "", "12 \u00a0345", "Масса ед., кг", "Тип, кВт", "тип изделия", "Наимено-\nвание", "Кол-во", "пог. м", "М²", "шт.", "т.", "№ п/п"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.number(F.col("t")).alias("n"), T.unit(F.col("t")).alias("u"), tables.header_field(F.col("t")).alias("f"))
    for r in df.collect():
        assert (tables.number_in(r["t"]), tables.unit_name(r["t"]), tables.field_of(r["t"])) == (r["n"], r["u"], r["f"])
