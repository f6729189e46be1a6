from pyspark.sql import functions as F

from tesserae.functions import text as T


def col(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_numbers(spark):
    assert col(spark, ["15 030,72", "1 234.56", "1.234,5", "1,234.5", "1.234.567", "-5", "нет", "", None, "30,5 м", "7" + chr(0xA0) + "368"], T.number) == [15030.72, 1234.56, 1234.5, 1234.5, 1234567.0, -5.0, None, None, None, 30.5, 7368.0]


def test_units(spark):
    assert col(spark, ["м.", "п.м.", "М", "кв. м", "м²", "шт.", "компл.", None, "ведро"], T.unit) == ["м", "м", "м", "м2", "м2", "шт", "компл", "", "ведро"]


def test_whole_token(spark):
    texts = ["Система П1-TRF-01-01 приточная", "П1-TRF-01-012", "П1-TRF-01-01A", "П1-TRF-01-01, резерв", "п1-trf-01-01", "А-П1-TRF-01-01", "П1-TRF-01-01.2", "(П1-TRF-01-01)", "", None]
    assert col(spark, texts, lambda c: T.contains_whole(c, "П1-TRF-01-01")) == [True, False, False, True, True, False, False, True, False, None]


def test_identities(spark):
    p = ["Q:/a/8624-31.02.1-04.pdf", "Q:/a/8624-31.02.1-06.pdf", "Q:/a/8624-31.02.2.pdf", "Q:/a/8624-10.03 (1).pdf", "Q:/a/ГОСТ 12.1.019-2017. Стандарт.docx", "Q:/a/Приложение-02.pdf"]
    r = col(spark, p, T.retrieval_identity)
    assert r[0] == r[1] != r[2]
    assert r[3] == "8624-10.03" and r[4].endswith("2017. стандарт") and r[5] == "приложение-02"
    assert col(spark, p, T.table_identity)[5] == "приложение"


def test_identifiers_and_norms(spark):
    q = ["расход 60 м3/ч по 1.02.11.024 и П1-TRF-01-01, В1-а; 12,5 O01163", None, ""]
    assert col(spark, q, T.identifiers) == [["1.02.11.024", "П1-TRF-01-01", "В1-а", "O01163"], None, []]
    assert col(spark, ["по СП 60.13330 и ГОСТ Р 12.1, пункт 7.4.1"], T.norm_designations) == [["СП 60.13330", "ГОСТ Р 12.1"]]


def test_stems_and_ids(spark):
    assert col(spark, ["завеса", "воздуховоды", "дом", "R.L2"], T.subject_stem) == ["завес", "воздуховод", "дом", "r.l2"]
    assert col(spark, ["BB_63"], lambda c: T.term_id(F.lower(c))) == [__import__("zlib").crc32(b"bb_63") & 0x7FFFFFFF]


def test_times(spark):
    got = col(spark, ["2023-09-19T06:28:50Z", "2023-09-19T09:28:50+03:00", "2023-09-19T06:28:50.000000+00:00", "x", None], T.instant)
    assert got[0] == got[1] == got[2] is not None and got[3:] == [None, None]
