import numpy as np
import pytest

from tesserae.llm import noise
from tesserae.llm.boost import Boosted


def test_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.4)).astype(float)
    m = Boosted().fit(x[:400], y[:400])
    assert ((m.predict(x[400:]) > 0.5) == y[400:]).mean() > 0.95


def test_differences():
    assert noise.difference("налзор", "надзор") == ("л", "д")
    assert noise.explained("агрега†", "агрегат") == (1, 0)
    assert noise.explained("предусллатри8ают", "предусматривают") == (2, 0)
    assert noise.explained("агрегату", "агрегата")[1] == 1
    assert noise.explained("rnoisture", "moisture") == (1, 0)


def test_words():
    def of(text):
        joined, a, b, _, _ = noise.tokens([text])
        return [joined[i:j] for i, j in zip(a, b)]

    assert of("Со-\nгласно П9-ENE-10-92, R.L2.15.092 и ТРК-173М659: 12,5 м0нтажный дроссель-клапан") == ["согласно", "м0нтажный", "дроссель", "клапан"]
    assert of("") == of("12 345") == []
    assert of("конец стро-") == ["конец"]


WORDS = "вентилятор насос участок предел огнестойкости монтажная бригада согласует крышный агрегат поставщик осматривает дренажный поддон расход воздуха составляет значение комиссия принимает решение узел смешения остаётся приточная установка".split()


@pytest.fixture(scope="module")
def scans(spark):
    rng = np.random.default_rng(1)
    said = lambda n: " ".join(map(str, rng.choice(WORDS, n))).capitalize() + "."
    rows = [("documents", str(i), " ".join(said(9) for _ in range(8))) for i in range(60)]
    rows += [("documents", f"v{i}", "\n".join(f"{said(2)[:-1]}\n{rng.integers(10, 999)},5 Па\n{rng.integers(10, 300)}\n{said(8)}" for _ in range(4))) for i in range(20)]
    page = "Монтажная бригада согласует крышный\nагрегат поставщик осматривает дренаж-\nный поддон расход воздуха\nНТД 513.36.60 Общие указания\n- 31 -\nсоставляет значение комиссия принимает\nрешение узел смешения остаётся приточная\nНТД 513.36.60 Общие указания\n- 32 -\nустановка монтажная бригада."
    rows += [("documents", "scan", page), ("documents", "scan", page), ("documents", "misread", said(6) + " крышный агрега† сог†асует дренажнblй п0ддон."), ("documents", "none", None), ("documents", "empty", ""), ("documents", "blank", " \n \n"), ("documents", "long", said(9) * 3000)]
    return noise.Scans(spark.createDataFrame([(*r, 1) for r in rows], "src string, row_key string, text string, noise int"))


def test_kinds(scans):
    got = {}
    for r in scans.found().collect():
        got.setdefault(r["row_key"], []).append(r["noise"])
    assert sorted(got.pop("scan")) == ["broken_word", "page_number", "running_header"]
    assert got.pop("misread") == ["wrong_character"]
    assert not got


def test_repair(scans):
    text = {r["row_key"]: r["text"] for r in scans.repaired().collect()}
    assert text["scan"] == "Монтажная бригада согласует крышный агрегат поставщик осматривает дренажный поддон расход воздуха составляет значение комиссия принимает решение узел смешения остаётся приточная установка монтажная бригада."
    assert "агрегат" in text["misread"] and "дренажный поддон" in text["misread"]


def test_empty(spark):
    assert noise.Scans(spark.createDataFrame([], "src string, row_key string, text string")).found().count() == 0


def test_all_differences():
    rng = np.random.default_rng(4)
    letters = list("оаермнилвы08lrn†buсxяfx")
    words = ["".join(rng.choice(letters, rng.integers(1, 19))) for _ in range(4000)]
    reads = [w[: (p := int(rng.integers(0, len(w))))] + str(rng.choice(letters)) + w[p + 1 :] for w in words[:2000]] + words[:1000][::-1] + ["rnoisture"] * 1000
    looks, edits = noise.explained_all(reads, words)
    assert list(zip(looks.tolist(), edits.tolist())) == [noise.explained(r, t) for r, t in zip(reads, words)]


def test_every_candidate_is_ranked(spark):
    near = [f"р{a}{b}{c}" for a, b, c in zip("аоуыияюаоуыияюаоуы", "клмнтспвдзбгклмнтс", "аоыияуаоыияуаоыияу")]
    vocab = [(w, 400) for w in WORDS if len(w) > 2] + [(w, 900) for w in near] + [("реже", 300), ("рeжe", 1)]
    assert len(near) > 12 and len({w for w, _ in vocab}) == len(vocab)
    got = {r["word"]: r["correction"] for r in noise.corrections(spark.createDataFrame(vocab, "word string, n bigint")).collect()}
    assert got.get("рeжe") == "реже"


def test_long_words_are_counted_and_corrected(spark):
    long = "электрогидрогазодинамическиуравновешенный"
    assert len(long) > 40
    vocab = [(w, 400) for w in WORDS if len(w) > 2] + [(long, 300), (long.replace("гидро", "гидр0"), 1)]
    got = {r["word"]: r["correction"] for r in noise.corrections(spark.createDataFrame(vocab, "word string, n bigint")).collect()}
    assert got.get(long.replace("гидро", "гидр0")) == long
    joined, a, b, _, _ = noise.tokens([f"x {long} y"])
    assert [joined[i:j] for i, j in zip(a, b)] == [long]


def test_two_letters_read_as_one():
    assert noise.explained("smoisture", "srnoisture")[1] == 0 and noise.explained("modem", "modern") == (1, 0)
    long, read = "ab" * 20 + "rn" + "cd" * 10, "ab" * 20 + "m" + "ce" * 10
    assert noise.explained(read, long)[1] > 0 and list(zip(*(x.tolist() for x in noise.explained_all([read], [long])))) == [noise.explained(read, long)]


def test_furniture_without_numbers_and_long_headers():
    head = "Общие указания по монтажу и наладке"
    page = noise.Page("\n".join(["текст первой строки листа", head, "вторая строка текста", head, "третья строка", "Заметка"]))
    assert [page.lines[page.full[k]] for k in page.candidates()] == [head, head]
    wide = "РТН 12.345 " + "Ведомость объёмов работ " * 5
    page = noise.Page(f"первая строка\n{wide}\nвторая строка\n58.\nтретья")
    assert len(wide) > 100 and [page.full[k] for k in page.candidates()] == [1]


def test_any_word_of_the_corpus_is_known_to_joins(scans):
    # the pieces are joined to the vocabulary, so no bound of a lexicon decides
    assert scans.joined.filter("left = 'дренаж' and right = 'ный'").count() == 1
    assert scans.known.filter("word = 'дренажный'").count() == 1
