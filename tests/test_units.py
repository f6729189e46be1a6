import math
import random

from tesserae.operators import units as U

ROWS = "value_id bigint, record string, label string, value double, unit string, evidence string, extra string"
LABELS = [("Длина участка", "м"), ("Температура подачи", "°C"), ("Доля воздуха", "%"), ("Тепловая мощность", "Вт")]


def run(spark, rows):
    v = spark.createDataFrame([(*r, "x") for r in rows], ROWS)
    c = U.common_values(v, spark.createDataFrame(LABELS, "label string, common_unit string"))
    return {r["value_id"]: (None if r["common_value"] is None else round(r["common_value"], 6), r["unit_from"]) for r in c.collect()}, {tuple(r) for r in U.agreeing(c).collect()}


def test_where_the_unit_comes_from(spark):
    rows = [
        (1, "П1", "Длина участка", 1.5, "м.", "Длина участка | 1,5 м."),
        (2, "п1", "ДЛИНА УЧАСТКА, мм", 1500.0, None, "Длина участка, мм | 1500"),
        (3, "П1", "Длина участка", None, "", "Длина участка : 1 500 mm | лист 7"),
        (4, "П1", "Длина участка", 1.5, "?", "Длина участка | 1,5"),
        (5, "П1", "Длина участка", None, "cm", "Длина участка принят 150,4"),
        (6, None, "Длина участка", 1.5, "м", ""),
        (7, "П1", None, 1.5, "м", None),
        (8, "П1", "Длина участка", float("nan"), "м", None),
        (9, "П1", "Длина участка", 1.6, "м", "x" * 100_000),
        (1, "П1", "Длина участка", 1.5, "м.", "Длина участка | 1,5 м."),
        (10, "П1", "Температура подачи", 300.15, "K", None),
        (11, "П1", "Температура подачи", 80.6, "град. F", None),
        (12, "П1", "Доля воздуха", 0.3, "о.е.", None),
        (13, "П1", "Неизвестное", 1.0, "м", None),
    ]
    got, pairs = run(spark, rows)
    assert got[1] == (1.5, "unit") and got[2] == (1.5, "label") and got[3] == (1.5, "evidence") and got[5][0] == 1.504
    assert got[4][0] is None and got[8][0] is None and got[13][0] is None and got[12][0] == 30.0
    assert got[10][0] == got[11][0] == 27.0
    assert pairs == {(1, 2), (1, 3), (1, 5), (2, 3), (2, 5), (3, 5), (10, 11)}


def test_pairs_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["A", "B"]), "Тепловая мощность", rng.choice([0.0, 1.0, -1.0]) * round(100 * (1 + rng.random() * 0.05), 3), rng.choice(["Вт", "кВт"]), None) for i in range(200)]
    _, pairs = run(spark, rows)
    common = {r[0]: r[3] * (1000 if r[4] == "кВт" else 1) for r in rows}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and abs(common[a[0]] - common[b[0]]) <= max(abs(common[a[0]]), abs(common[b[0]])) * (0.005 + 1e-9)}
    assert pairs == want and want


def test_empty(spark):
    assert run(spark, []) == ({}, set())


def test_longest_alias_of_the_kind():
    assert U.unit_after("5 мм вод. ст. | поз. 1", 1, "pressure") == "ммводст"
    assert U.unit_after("5 мм вод. ст.", 1, "length") == "мм" or U.unit_after("5 мм вод. ст.", 1, "length") is None
    assert U.unit_after("5 м/с", 1, "length") is None and U.unit_after("5м/с", 1, "speed") == "м/с"
    assert U.number_of("7 368,5") == 7368.5 and math.isclose(U.number_of("1e3"), 1000)
