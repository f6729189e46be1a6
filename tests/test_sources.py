import io
import zipfile

import pytest

from tesserae.operators.embed import Hashing, compatible, contract, embed
from tesserae.sources import files, sinks
from tesserae.sources.versions import VersionedTable

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def zipped(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return b.getvalue()


def cell(t, props=""):
    return f"<w:tc><w:tcPr>{props}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"


DOCX = zipped({"word/document.xml": f'<w:document xmlns:w="{W}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Раздел</w:t></w:r></w:p><w:tbl><w:tr>{cell("Система", "<w:vMerge w:val=&quot;restart&quot;/>".replace("&quot;", chr(34)))}{cell("Вентилятор", "<w:gridSpan w:val=&quot;2&quot;/>".replace("&quot;", chr(34)))}</w:tr><w:tr>{cell("", "<w:vMerge/>")}{cell("L")}{cell("P")}</w:tr></w:tbl></w:body></w:document>'})
XLSX = zipped({
    "xl/workbook.xml": f'<workbook xmlns="{S}"><sheets><sheet name="Лист"/></sheets></workbook>',
    "xl/sharedStrings.xml": f'<sst xmlns="{S}"><si><t>Кол-во</t></si></sst>',
    "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{S}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Поз</t></is></c></row><row><c r="A2"><v>2.5</v></c></row></sheetData><mergeCells><mergeCell ref="B1:B2"/></mergeCells></worksheet>',
})


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("привет".encode("cp1251"))
    (tmp_path / "b.json").write_text('[{"a": 1}, 2]')
    (tmp_path / "c.csv").write_text("Поз;Кол-во\n1;2,5\n2;3\n")
    (tmp_path / "d.docx").write_bytes(DOCX)
    (tmp_path / "e.xlsx").write_bytes(XLSX)
    (tmp_path / "f.docx").write_bytes(b"no zip")
    (tmp_path / "g.dwg").write_bytes(b"x")
    (tmp_path / "h.txt").write_bytes(b" ")
    scan = files.scan(spark, str(tmp_path))
    got = {r["file_name"]: r for r in files.documents(scan).collect()}
    assert got["a.txt"]["text"] == "привет" and got["b.json"]["text"].splitlines()[1] == "[1] 2"
    assert got["c.csv"]["text"].splitlines()[1] == "[1] 1 | 2,5"
    assert "Система | Вентилятор | Вентилятор\nСистема | L | P" in got["d.docx"]["text"]
    assert got["e.xlsx"]["text"] == "# Лист\nКол-во | Поз\n2.5 | Поз"
    assert got["f.docx"]["error"].startswith("unreadable") and got["g.dwg"]["error"] == "no_parser" and got["h.txt"]["error"] == "empty"
    assert files.grids(scan).filter("source_path like '%.csv'").count() == 3


def test_pages(spark):
    p = spark.createDataFrame([(1, 2, "x", "scan two"), (1, 1, "a" * 60, None), (1, 3, None, None)], "d int, page int, text string, ocr string")
    r = files.merge_pages(p, "d").first()
    assert r["text"] == "a" * 60 + "\nscan two\n" and r["scanned"] == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b")], "k int, v string")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("sep", ";").option("header", "true").csv(str(tmp_path / "c")).first()["v"] == "a|b"
    assert "a\\|b" in sinks.markdown(df.collect(), ["k", "v"], "T")
    assert sinks.backup(spark, {"t": df}, f"file://{tmp_path}/b") == {"t": 1}
    t = VersionedTable(spark, f"file://{tmp_path}/t", df.schema)
    t.append(spark.createDataFrame([(5, "z")], df.schema))
    sinks.restore(spark, f"file://{tmp_path}/b", "t", t)
    assert [tuple(r) for r in t.read().collect()] == [(1, "a|b")]


def test_embedding(spark):
    df = spark.createDataFrame([("a", "x y"), ("b", None), ("c", "y x")], "chunk_id string, text string")
    v = {r["chunk_id"]: r["vector"] for r in embed(df, Hashing(8)).collect()}
    assert v["a"] == v["c"] and sum(x * x for x in v["a"]) == pytest.approx(1) and set(v["b"]) == {0.0}
    assert compatible("org/Model-Name.gguf", "model-name") and not compatible("a", "")
    assert contract(Hashing(8), {"model": "hashing", "dimension": 8}) is None and contract(Hashing(8), {"model": "hashing", "dimension": 9})
    p = Hashing(8)
    p.external = True
    with pytest.raises(PermissionError):
        embed(df, p)
