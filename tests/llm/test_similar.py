import random
import re

import numpy as np
import pytest

from tesserae.llm import knn, neardup

WORD = re.compile(r"[^\W_]+")


def shingles(t, k):
    w = WORD.findall((t or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"слово{i}" for i in range(400)]
    rows = []
    for i in range(60):
        t = rng.choices(words, k=rng.randint(20, 60))
        rows.append(" ".join(t))
        for _ in range(rng.randint(0, 3)):
            u = list(t)
            for _ in range(rng.randint(0, 8)):
                u[rng.randrange(len(u))] = rng.choice(words)
            rows.append(" ".join(u) if rng.random() < 0.5 else "  ".join(u).upper() + ".")
    return rows + [None, "", "  ", "раз два", "раз два", "x " * 40_000, rows[0], rows[0]]


@pytest.mark.parametrize("run,least", [(3, 0.5), (5, 0.8)])
def test_pairs_against_brute_force(spark, run, least):
    rows = corpus()
    df = spark.createDataFrame([(f"k{i:04d}", t, "z") for i, t in enumerate(rows)], "id string, text string, class string")
    n = neardup.NearDuplicates(df.union(df.limit(3)), "id", "text", run=run, threshold=least, rows=2, bands=24)
    sets = [shingles(t, run) for t in rows]
    want = {(f"k{i:04d}", f"k{j:04d}") for i in range(len(rows)) for j in range(i + 1, len(rows)) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])}
    assert {tuple(r) for r in n.found().collect()} == want and len(want) > 10
    one = n.rows().collect()
    assert len(one) == len(rows)
    groups = {r["id"]: r["group"] for r in n.groups().collect()}
    assert all(groups[a] == groups[b] for a, b in want) and set(groups) == {x for p in want for x in p}


def test_large_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FEW", 2)
    monkeypatch.setattr(neardup, "PART", 3)
    t = [f"w{i}" for i in range(60)]
    rows = [" ".join(t[:i] + ["x"] + t[i + 1 :]) for i in range(0, 60, 3)]
    n = neardup.NearDuplicates(spark.createDataFrame(list(enumerate(rows)), "id int, text string"), "id", "text", run=3, threshold=0.5, rows=3, bands=32)
    sets = [shingles(x, 3) for x in rows]
    want = {(i, j) for i in range(20) for j in range(i + 1, 20) if len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])}
    assert {tuple(r) for r in n.found().collect()} == want and len(want) > 100


def test_large_class_is_told_by_its_first_member(spark, monkeypatch):
    monkeypatch.setattr(neardup, "EXPAND", 9)
    df = spark.createDataFrame([(i, "a b c d e f g") for i in range(10)] + [(99, "a b c d e f g h"), (50, "p q"), (51, "P, q")], "id int, text string")
    n = neardup.NearDuplicates(df, "id", "text", run=3, threshold=0.5, rows=2, bands=16)
    found = {tuple(r) for r in n.found().collect()}
    assert found == {(0, i) for i in range(1, 10)} | {(0, 99)}
    # every near pair is read back from the pairs and the classes
    of = {r["id"]: r["class_id"] for r in n.rows().collect()}
    long = set(range(10)) | {99}
    near = {(a, b) for a in long for b in long if a < b and (of[a] == of[b] or (of[a], of[b]) in found)}
    assert near == {(a, b) for a in long for b in long if a < b} and of[50] == of[51] == 50


def test_nothing(spark):
    n = neardup.NearDuplicates(spark.createDataFrame([], "id int, text string"), "id", "text")
    assert n.found().count() == n.rows().count() == n.groups().count() == 0


def vectors(n=600, dim=64, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for i in range(0, n, 3):
        x[i + 1] = x[i] + 0.3 * rng.standard_normal(dim) * rng.random()
    x[5] = x[10] = x[20]
    x[30] = 2 * x[40]
    return x.astype(np.float16).astype(np.float32)


def brute(x, ids, k):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    c = u @ u.T
    out = {}
    for i in range(len(ids)):
        out[ids[i]] = [ids[j] for j in sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(c[i, j], 9), ids[j]))[:k]]
    return c, out


@pytest.mark.parametrize("cell", [6000, 60])
def test_mutual_pairs(spark, cell):
    x = vectors()
    ids = [f"c{i:04d}" for i in range(len(x))]
    rows = [(i, v.tolist(), "e") for i, v in zip(ids, x)]
    bad = [("n1", None, "e"), ("n2", [0.0] * 64, "e"), ("n3", [1.0] * 3, "e"), ("n4", [float("nan")] * 64, "e"), (None, [1.0] * 64, "e"), ("n5", [None] * 64, "e")]
    df = spark.createDataFrame(rows + bad + rows[:7], "id string, v array<float>, cell string")
    index = knn.VectorIndex(df, "id", "v", 64, cell=cell)
    c, near = brute(x, ids, 10)
    at = {k: i for i, k in enumerate(ids)}
    want = {(a, b) for a in ids for b in near[a] if a < b and a in near[b] and c[at[a], at[b]] >= 0.9}
    got = {tuple(r) for r in index.mutual(0.9).collect()}
    assert got <= want and len(got & want) >= 0.99 * len(want) and len(want) > 100


def test_large_class_of_equal_vectors(spark):
    df = spark.createDataFrame([(f"k{i:03d}", [1.0, 2.0, 3.0]) for i in range(40)] + [("x", [3.0, -2.0, 1.0])], "id string, v array<float>")
    got = {tuple(r) for r in knn.VectorIndex(df, "id", "v", 3, k=10).mutual(0.9).collect()}
    ids = [f"k{i:03d}" for i in range(40)]
    near = {a: [b for b in ids if b != a][:10] for a in ids}
    assert got == {(a, b) for a in ids for b in near[a] if a < b and a in near[b]}


def test_every_copy_of_a_vector_asks(spark):
    df = spark.createDataFrame([(f"k{i:03d}", [1.0, 2.0, 3.0]) for i in range(30)] + [("x", [3.0, -2.0, 1.0]), ("y", [3.0, -2.0, 1.5])], "id string, v array<float>")
    got = {}
    for r in knn.VectorIndex(df, "id", "v", 3, k=10).closest(lambda id: id.isNotNull()).orderBy("id", "position").collect():
        got.setdefault(r["id"], []).append(r["other"])
    ids = [f"k{i:03d}" for i in range(30)]
    assert set(got) == {*ids, "x", "y"} and all(got[a] == [b for b in ids if b != a][:10] for a in ids)
    assert got["x"][0] == "y" and got["y"][0] == "x"


def test_hot_cells_are_split_on_both_sides(spark, monkeypatch):
    monkeypatch.setattr(knn, "ASKS", 100)
    x = vectors(900)
    x[:600] = x[0] + 0.02 * np.random.default_rng(1).standard_normal((600, 64)).astype(np.float16)
    ids = [f"c{i:04d}" for i in range(len(x))]
    index = knn.VectorIndex(spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id string, v array<float>"), "id", "v", 64, cell=50)
    c, near = brute(x, ids, 10)
    at = {k: i for i, k in enumerate(ids)}
    want = {(a, b) for a in ids for b in near[a] if a < b and a in near[b] and c[at[a], at[b]] >= 0.9}
    got = {tuple(r) for r in index.mutual(0.9, 8).collect()}
    assert index._blocks(8).max() > 1 and len(got & want) >= 0.9 * len(want)
    slots = index._visits(index.classes, 8, index._blocks(8), True, True).groupBy("slot").count().collect()
    assert max(r["count"] for r in slots) < 600


def test_recall_of_the_closest(spark):
    x = vectors(1500)
    ids = [f"c{i:04d}" for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id string, v array<float>")
    got = {}
    for r in knn.VectorIndex(df, "id", "v", 64, cell=100).closest().collect():
        got.setdefault(r["id"], set()).add(r["other"])
    _, near = brute(x, ids, 10)
    assert got and all(len(v) == 10 for v in got.values())
    assert np.mean([len(got[i] & set(near[i])) / 10 for i in got]) >= 0.9


def test_no_vectors(spark):
    df = spark.createDataFrame([("a", None)], "id string, v array<float>")
    index = knn.VectorIndex(df, "id", "v", 64)
    assert index.mutual(0.9).count() == 0 and index.closest().count() == 0
