import json

import pytest
from pyspark.sql import functions as F

from tesserae.operators import maintenance, reranking, resolve
from tesserae.plans import routing, vocabulary
from tesserae.session import fresh_path
from tesserae.sources import cache, files, pages


def test_upkeep_is_due():
    due = maintenance.upkeep_due
    assert due(0, 1.0, 2.0, force=True) == "forced" and due(0, None, 2.0) == "first" and due(20_000, 1.0, 2.0) == "rows"
    assert due(1, 0.0, 24 * 3600.0) == "age" and due(0, 0.0, 1e9) is None and due(19_999, 0.0, 10.0) is None


def test_recovery_is_complete_after_one_run(spark):
    f = spark.createDataFrame([("a", "indexed", 1), ("b", "indexed", 2), ("c", "indexed", 0)], "source_path string, status string, chunk_count int")
    p = spark.createDataFrame([("a", "p1"), ("x", "p2")], "source_path string, parent_id string")
    c = spark.createDataFrame([("a", "c1"), ("y", "c2")], "source_path string, chunk_id string")
    f2, p2, c2 = maintenance.recover(f, p, c)
    assert {r["source_path"]: r["status"] for r in f2.collect()} == {"a": "indexed", "b": "reindexing", "c": "indexed"}
    assert [r["source_path"] for r in p2.collect()] == ["a"] and [r["source_path"] for r in c2.collect()] == ["a"]


def test_backfill_is_all_or_nothing(spark):
    rows = [("a", "1", "не менее 5"), ("a", "2", "без чисел"), ("b", "3", "сбой 7"), ("b", "4", "8"), ("c", "5", "сбой 9")]

    def extract(t):
        if "сбой" in t:
            raise RuntimeError
        return [f"правило {t}"]

    got = {r["source_path"]: (r["status"], r["processed_chunks"], r["rules"]) for r in maintenance.backfill_rules(spark.createDataFrame(rows, "source_path string, parent_id string, parent_text string"), extract).collect()}
    assert got == {"a": ("success", 1, ["правило не менее 5"]), "b": ("partial", 1, []), "c": ("failed", 0, [])}


def test_parts_comparison_and_cache(spark):
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(100)], "k string, v int")
    parts = [set(r["k"] for r in maintenance.work_part(rows, "k", 3, i).collect()) for i in range(3)]
    assert sum(map(len, parts)) == 100 and set.union(*parts) == {f"k{i}" for i in range(100)}
    a = spark.createDataFrame([("x", 1), ("y", None), ("z", 3)], "k string, v int")
    b = spark.createDataFrame([("x", 2), ("y", None), ("w", 4)], "k string, v int")
    assert {r["k"]: r["outcome"] for r in maintenance.compare(a, b, "k", "v").collect()} == {"x": "changed", "y": "same", "z": "missing", "w": "new"}
    c = spark.createDataFrame([(3,), (None,), (4,)], "hit_count int")
    assert tuple(maintenance.cache_stats(c).first()) == (3, 7) and tuple(maintenance.cache_stats(c.limit(0)).first()) == (0, 0)
    key = spark.range(1).select(maintenance.scope_key(F.lit("m"), F.lit(None).cast("string"), F.lit("r"), F.lit("d"), F.lit(None).cast("string"), F.lit(0.7)).alias("k")).first()["k"]
    assert key == "m||r|d||0.7"
    hits = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 0.5), ("a", "b", 0.9), ("a", "c", 0.7), ("a", "d", 0.1)], "own string, doc string, s double")
    assert [tuple(r) for r in maintenance.best_per_document(hits, "own", "doc", "s", 2).orderBy("doc").collect()] == [("a", "b", 0.9), ("a", "c", 0.7)]


def test_rerank_documents(spark):
    long = " ".join(f"слово{i}" for i in range(400))
    child = " ".join(f"слово{i}" for i in range(300, 320))
    df = spark.createDataFrame([("СП 7. Своды.pdf", long, child), (None, None, None), ("a.txt", "коротко | | | | и . . . . . конец", "коротко"), ("b.md", long, "нет такого текста")], "f string, p string, c string")
    got = [r["t"] for r in df.select(reranking.rerank_text(F.col("f"), F.col("p"), F.col("c"), 200).alias("t")).collect()]
    assert got[0].startswith("СП 7. Своды\nслово0 ") and "слово310" in got[0] and " … " in got[0] and len(got[0]) <= 200 * 1.8 + 20
    assert got[1] == "" and got[2] == "a\nкоротко | и конец" and got[3] == "b\nнет такого текста"


def test_reranking_survives_its_scorer(spark):
    rows = spark.createDataFrame([(1, r, "q", t) for r, t in ((1, "a"), (2, "bbbb"), (3, "cc"))], "q int, rank int, query_text string, text string")

    def size(qs, ts):
        if any(len(t) > 3 for t in ts):
            raise reranking.Oversize
        return [float(len(t)) for t in ts]

    assert [r["text"] for r in reranking.reranked(rows.coalesce(1), "q", size, "text").orderBy("position").collect()] == ["bbbb", "cc", "a"]

    def broken(qs, ts):
        raise RuntimeError

    got = reranking.reranked(rows, "q", broken, "text").orderBy("position").collect()
    assert [r["text"] for r in got] == ["a", "bbbb", "cc"] and all(r["rerank_score"] is None for r in got)


def test_files_are_resolved(spark):
    f = spark.createDataFrame([("x/a-01.xlsx", "project", "2024"), ("x/a-02.xlsx", "project", "2025"), ("x/b.pdf", "project", None), ("y/c.docx", "norms", None), ("y/d.txt", "norms", None)], "source_path string, dataset string, modified_at string")
    p = spark.createDataFrame([("x/b.pdf", "Обратный клапан"), ("x/a-02.xlsx", "насос"), (None, "клапаны")], "source_path string, parent_text string")
    names = lambda **k: [r["source_path"] for r in resolve.resolve_files(f, p, **k).orderBy("position").collect()]
    assert names(keywords=["клапаны"]) == ["x/b.pdf"]
    assert names(keywords=["клапаны"], source_like="X/") == ["x/b.pdf", "x/a-02.xlsx"]
    assert names(keywords=["нет такого"]) == ["x/a-02.xlsx", "x/b.pdf", "y/c.docx"]
    assert names(keywords=[], dataset="norms") == ["y/c.docx"]


def test_rows_for_showing(spark):
    df = spark.createDataFrame([("насос", 2.0, None, {"Наименование": "насос", "name": "чужое", "Прим.": " ", "Масса": "7"}), (None, None, "К1", {"Марка": "К1"}), ("люк", None, "12", {"Мощность, кВт": "12"}), (None, None, None, None)], "name string, qty double, mark string, raw_row map<string,string>")
    got = df.select(resolve.full_row(["name", "qty", "mark"]).alias("f"), resolve.repaired_mark(F.col("mark"), F.col("raw_row")).alias("m"), resolve.row_mark(F.col("mark"), F.col("name"), F.col("raw_row")).alias("r")).collect()
    assert got[0]["f"] == {"name": "насос", "qty": "2.0", "Наименование": "насос", "Масса": "7"}
    assert [r["m"] for r in got] == [None, "К1", None, None] and [r["r"] for r in got] == ["насос", "К1", "12", ""]
    t = spark.createDataFrame([("ошибка в C:\\Users\\a\\b.txt и /home/x/y.py, см. стр. 1/2", "1,5 и 2, 3", '{"a": "b"}')], "t string, d string, j string")
    r = t.select(resolve.redacted(F.col("t")), resolve.decimal_points(F.col("d")), resolve.json_row(F.col("j")), resolve.safe_error(F.lit("")), resolve.safe_error(F.lit("boom"))).first()
    assert tuple(r) == ("ошибка в [redacted-path] и [redacted-path], см. стр. 1/2", "1.5 и 2, 3", {"a": "b"}, "", "internal_error")


def test_table_cache_opens_a_file_once(spark, tmp_path, monkeypatch):
    (tmp_path / "t.csv").write_text("Поз.;Наименование;Ед.;Кол-во\n1;насос;шт;2\n2;клапан;шт;3\n")
    (tmp_path / "empty.csv").write_text("одна строка")
    c = cache.TableCache(spark, fresh_path(spark, "cache"))
    scan = lambda: files.scan(spark, str(tmp_path))
    assert sorted((r["name"], r["qty"]) for r in c.rows(scan()).collect()) == [("клапан", 3.0), ("насос", 2.0)]
    assert c.table.version() == 1 and c.missing(scan()).count() == 0 and c.fill(scan()) == 1
    (tmp_path / "t.csv").write_text("Поз.;Наименование;Ед.;Кол-во\n1;насос;шт;21\n2;клапан;шт;3\n")
    assert sorted(r["qty"] for r in c.rows(scan()).collect()) == [3.0, 21.0] and c.table.version() == 2
    monkeypatch.setattr(files, "LARGE", 3)
    assert c.too_large(scan()).count() == 2


def test_pages_and_their_codes(spark, tmp_path):
    class Fake(pages.PageReader):
        def texts(self, data):
            return data.decode().split("\f")

        def tables(self, data):
            yield 0, [["Поз.", None], ["1", "насос"]]

    class Reader(pages.Recogniser):
        def page(self, data, number):
            if number == 2:
                raise RuntimeError
            return f"распознано {number}"

    long = "текст страницы " * 5
    (tmp_path / "a.pdf").write_text(f"{long}\f-\f ")
    (tmp_path / "b.dwg").write_text("x")
    scan = files.scan(spark, str(tmp_path))
    got = {(r["source_path"][-5:], r["page"]): (r["text"], r["scanned"], r["error"]) for r in pages.pages(scan, {"pdf": Fake()}, Reader()).collect()}
    assert got == {("a.pdf", 0): (long, False, None), ("a.pdf", 1): ("распознано 1", True, None), ("a.pdf", 2): (" ", True, "recogniser_failed"), ("b.dwg", None): (None, False, "no_reader")}
    docs = {r["source_path"][-5:]: r for r in pages.assembled(pages.pages(scan, {"pdf": Fake()}, Reader())).collect()}
    assert docs["a.pdf"]["text"] == f"{long}\nраспознано 1\n " and docs["a.pdf"]["scanned"] == 2 and docs["b.dwg"]["error"] == "no_reader"
    assert pages.page_grids(scan, {"pdf": Fake()}).count() == 2

    class Away(Reader):
        external = True

    with pytest.raises(PermissionError):
        pages.pages(scan, {}, Away())


def test_vocabulary_of_files(tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"confidence": {"confident": 0.5}, "domains": [{"id": "a", "dataset": "project", "terms": ["насос"]}, {"id": "b", "dataset": "normative", "terms": ["пожар"]}]}))
    (tmp_path / "v.local.json").write_text(json.dumps({"domains": [{"id": "a", "dataset": "project", "terms": ["клапан"], "folder_filter": "ОВ1"}, {"id": "c", "dataset": "project", "terms": ["щит"]}]}))
    v = vocabulary.load_vocabulary(tmp_path / "v.json")
    assert [d.name for d in v.domains] == ["a", "b", "c"] and v.domains[0].terms == ("клапан",) and v.confident == 0.5 and v.gap == 0.12
    assert routing.route("обратный клапан", domains=v.domains).name == "a"
    assert vocabulary.load_vocabulary(tmp_path / "none.json").domains == routing.DOMAINS
    assert vocabulary.label_hint("Какая  потеря давления?") == "Потеря давления" and vocabulary.label_hint("расход") is None


def test_second_store(spark):
    from tesserae.sources import points

    pay = lambda **k: {"node_role": "evidence", **k}
    rows = [
        ("1", [1.0, 0.0], pay(text="а", doc_type="NORMATIVE", file_name="x/n.pdf", context_before="до", doc_id="d")),
        ("2", [0.9, 0.1], pay(text="б", doc_type="PROJECT", file_name="y\\p.pdf")), ("3", [0.0, 1.0], pay(text="в")), ("4", [1.0, 0.0], {"node_role": "summary", "text": "г"}), ("5", None, None),
    ]
    p = spark.createDataFrame(rows, "id string, vector array<double>, payload map<string,string>")
    got = points.search(p, [1.0, 0.0], spark.createDataFrame([("3", 5.0), ("4", 9.0)], "id string, bm25 double"), 2).collect()
    assert {r["chunk_id"] for r in got} <= {"1", "2", "3"} and len(got) == 2
    assert [r["chunk_id"] for r in points.search(p, [1.0, 0.0], None, 5, "normative").collect()] == ["1"]
    one = points.search(p, [1.0, 0.0], None, 5, "project").collect()
    assert [(r["chunk_id"], r["file_name"]) for r in one] == [("2", "p.pdf"), ("3", "")]
    r = points.rows(p.filter("id = '1'").withColumn("score", F.lit(0.12345))).first()
    assert (r["text"], r["child_text"], r["context_source"], r["parent_id"], r["score"]) == ("до\nа", "а", "window", "1", 0.1235)


def test_a_queue_under_pressure(spark, tmp_path):
    from tesserae.streaming import events

    df = spark.createDataFrame([(f"p{i}", int(i % 4 != 0), f"2025-01-01 00:00:{i:02d}") for i in range(20)], "path string, priority int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    run = lambda most: {r["path"] for r in events.under_pressure(df, most).filter("run_now").collect()}
    urgent = {f"p{i}" for i in range(0, 20, 4)}
    assert run(20) == run(100) == urgent and run(0) == {f"p{i}" for i in range(20)}
    some = run(17)
    assert urgent | {"p1", "p2", "p3"} == some
    for i in range(5):
        df.limit(2).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sizes = []
    q = events.source(spark, str(tmp_path / "in"), "path string, priority int, ts timestamp", 2).writeStream.foreachBatch(lambda b, n: sizes.append(b.count())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sizes == [4, 4, 2]
