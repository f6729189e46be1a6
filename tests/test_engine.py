from tesserae.api import Engine
from tesserae.operators import indexing
from tesserae.operators.embed import Hashing
from tesserae.session import fresh_path, load
from tesserae.sources.versions import VersionedTable


def test_index_and_again(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Предел огнестойкости воздуховода не менее EI 30")
    (tmp_path / "b.md").write_text("# Насос\nРасход 60 м3/ч")
    (tmp_path / "c.bin").write_bytes(b"x")
    schema = spark.createDataFrame([], indexing.CHUNKS).schema
    t = VersionedTable(spark, fresh_path(spark, "idx"), schema)
    version, report = indexing.index(spark, str(tmp_path), t, Hashing(16))
    assert version == 1 and {r["source_path"][-5:]: r["outcome"] for r in report.collect()} == {"a.txt": "new", "/b.md": "new", "c.bin": "no_parser"}
    (tmp_path / "b.md").write_text("# Насос\nРасход 75 м3/ч")
    version, report = indexing.index(spark, str(tmp_path), t, Hashing(16))
    assert version == 2 and {r["source_path"][-5:]: r["outcome"] for r in report.collect()} == {"a.txt": "unchanged", "/b.md": "changed", "c.bin": "no_parser"}
    rows = t.read().collect()
    assert len(rows) == 2 and any("75" in r["text"] for r in rows) and all(len(r["vector"]) == 16 for r in rows)
    assert t.read(1).filter("text like '%60%'").count() == 1


def test_index_drops_what_is_gone_and_keeps_vectors(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Предел огнестойкости воздуховода")
    (tmp_path / "t.csv").write_text("Поз.;Наименование;Ед.;Кол-во\n1;насос;шт;2\n2;клапан;шт;3\n")
    (tmp_path / "m.py").write_text("def f():\n    return 1\n")
    schema = spark.createDataFrame([], indexing.CHUNKS).schema
    t = VersionedTable(spark, fresh_path(spark, "idx"), schema)
    indexing.index(spark, str(tmp_path), t, Hashing(8))
    at = indexing.Index(spark, t)
    assert {(r["name"], r["qty"]) for r in at.read("rows").collect()} == {("насос", 2.0), ("клапан", 3.0)}
    assert at.read("parents").count() == 1 and {r["source_path"][-5:]: r["chunk_count"] for r in at.read("files").collect()} == {"a.txt": 1, "t.csv": 2, "/m.py": 1}
    first = {r["chunk_id"]: r["text"] for r in t.read().collect()}
    assert any("Наименование: насос" in x.replace("наименование", "Наименование") for x in first.values()) and len(first) == 4
    # an unchanged folder makes no version
    version, report = indexing.index(spark, str(tmp_path), t, Hashing(8))
    assert version == 1 and {r["outcome"] for r in report.collect()} == {"unchanged"}
    (tmp_path / "m.py").unlink()
    (tmp_path / "a.txt").write_text("  ")
    # a writer dies after it wrote beside: nothing is seen of it
    at.beside["files"].replace(at.named()["files"], at.read("files"), "source_path", at.read("files").limit(0), named=False)
    version, report = indexing.index(spark, str(tmp_path), t, Hashing(8))
    assert version == 2 and {r["source_path"][-5:]: r["outcome"] for r in report.collect()} == {"a.txt": "empty", "t.csv": "unchanged", "/m.py": "deleted"}
    assert t.read().count() == 2 and {r["source_path"][-5:] for r in at.read("files").collect()} == {"a.txt", "t.csv"}
    version, report = indexing.index(spark, str(tmp_path), t, Hashing(8))
    assert version == 2


def test_tools(spark):
    from conftest import DATA

    from tesserae.operators.embed import embed
    from tesserae.operators.tables import text_tables

    chunks = embed(load(spark, DATA, "documents_64").dropDuplicates(["chunk_id"]).drop("vector"), Hashing(32)).cache()
    e = Engine(chunks, load(spark, DATA, "parent_chunks"), load(spark, DATA, "files"), load(spark, DATA, "doc_edges"), manifest={"model": "hashing", "dimension": 32}, provider=Hashing(32),
               table_rows=text_tables(load(spark, DATA, "documents"), "doc_id", "text"), jobs=load(spark, DATA, "index_runs"))
    a = e.search_documents("предел огнестойкости воздуховода", 4)
    assert a.blocked is None and 0 < a.rows.count() <= 4 and a.trace["fusion"] == "rrf"
    e.manifest = {"model": "other", "dimension": 32}
    assert e.search_documents("x").blocked
    page, by = e.find_occurrences("чиллер", limit=5)
    assert page.count() <= 5 and by.count() >= 0
    page, total = e.list_indexed(limit=3)
    assert page.count() == 3 and total.first()["files"] > 3
    assert e.sum_table_values(["клапан"]).count() == 1
    assert e.get_table(group_by="unit").count() > 0 and e.get_table(limit=2).count() <= 2
    assert e.jobs_status(5).count() == 5
    path = load(spark, DATA, "files").first()["source_path"]
    e.graph_neighbors(path).collect()
