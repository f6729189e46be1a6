import random
import re

import pytest

from tesserae.llm import rank, repetition, survive

WORD = re.compile(r"[^\W_]+")


def runs(text):
    w = WORD.findall((text or "").lower())
    r = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    return len(r), len(r) - len(set(r))


def test_shares_against_brute_force(spark):
    from conftest import DATA

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = {r["doc_id"]: runs(r["text"]) for r in docs.collect()}
    got = repetition.repetition(docs).collect()
    assert {r["doc_id"]: (r["n_runs"], r["repeated_runs"]) for r in got} == want
    found = {r["doc_id"] for r in repetition.repeating(docs).collect()}
    assert found == {d for d, (n, k) in want.items() if n >= 20 and k >= 0.3 * n}


def test_no_repeating_text_escapes_the_labels(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(150):
        base = [" ".join(rng.choices(words, k=rng.randint(3, 14))) for _ in range(rng.randint(3, 10))]
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(base))
            base.insert(rng.randint(at, len(base)), base[at] if rng.random() < 0.6 else " ".join(base[at].split()[: rng.randint(2, 8)]))
        rows.append((i, rng.choice(["\n", ". ", " ", "\r\n"]).join(base)))
    rows += [(900, None), (901, ""), (902, "  \n"), (903, "раз два"), (904, "a b c d e " * 5000), (905, "один " * 30)]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id bigint, text string, n_runs string")
    got = {r["doc_id"] for r in repetition.repeating(df).collect()}
    assert got == {d for d, t in rows if runs(t)[0] >= 20 and runs(t)[1] >= 0.3 * runs(t)[0]} and {904, 905} <= got
    one = {r["doc_id"]: r for r in repetition.repetition(df).collect()}
    assert len(one) == len(rows) and one[900]["content_share"] == one[903]["content_share"] == 1.0 and one[900]["repeated_share"] == 0.0


def test_empty(spark):
    e = spark.createDataFrame([], "doc_id bigint, text string")
    assert repetition.repetition(e).count() == 0 and repetition.repeating(e).count() == 0


def brute_rank(rows, names):
    items = {}
    for g, i, *v in rows:
        if i is None:
            continue
        best = items.setdefault((g, i), [None] * len(names))
        for k, x in enumerate(v):
            if x is not None and x == x:
                x = x if names[k] else -x
                best[k] = x if best[k] is None else max(best[k], x)
    out = {}
    for (g, i), v in items.items():
        ranks = []
        for k, x in enumerate(v):
            peers = [b[k] for (h, _), b in items.items() if h == g]
            if x is None:
                better, same = sum(p is not None for p in peers), sum(p is None for p in peers)
            else:
                better, same = sum(p is not None and p > x for p in peers), sum(p == x for p in peers)
            ranks.append(better + (same + 1) / 2)
        out[g, i] = (sorted(ranks)[len(ranks) // 2], round(sum(ranks) / len(ranks), 9))
    return out


@pytest.mark.parametrize("large", [50_000, 40, 3])
def test_median_rank_against_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(rank, "LARGE", large)
    rng = random.Random(2)
    val = lambda: rng.choice([None, float("nan"), float("inf"), 1.0, 2.0, rng.random() * 1e6, rng.random()])
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice(["a", "b", None, *map(str, range(30))]), val(), val(), val()) for _ in range(150)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "q bigint, c string, x double, y double, z double")
    r = rank.median_rank(df, "q", "c", {"x": (False, 1.0), "y": (True, 1.0), "z": (True, 1.0)})
    got = {(t["q"], t["c"]): (t["median_rank"], round(t["mean_rank"], 9)) for t in r.collect()}
    assert got == brute_rank(rows, [False, True, True])
    top = rank.best_of_each(r, "q", "c", 5).collect()
    for q in {k[0] for k in got}:
        want = [i for i, _ in sorted(((k[1], v) for k, v in got.items() if k[0] == q), key=lambda x: (x[1][0], x[1][1], x[0]))][:5]
        assert [t["c"] for t in sorted((t for t in top if t["q"] == q), key=lambda t: t["position"])] == want


def test_weights_and_empty(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 9.0), (1, "b", 2.0, 1.0)], "q bigint, c string, x double, y double")
    r = {t["c"]: t["median_rank"] for t in rank.median_rank(df, "q", "c", {"x": (False, 3.0), "y": (True, 1.0)}).collect()}
    assert r == {"a": 1.0, "b": 2.0}
    assert rank.median_rank(df.limit(0), "q", "c", {"x": (True, 1.0)}).count() == 0


FILES = "source_path string, file_name string, format string, sha256 string, created_at string, modified_at string, chunk_count int, status string, indexed_at string, dataset string, is_deprecated boolean, parent_source_path string"


def file(path, sha=None, modified=None, fmt=None, dataset=None, indexed="2025-01-01T00:00:00Z", chunks=None):
    return (path, path.split("/")[-1] if path else None, fmt, sha, None, modified, chunks, "indexed", indexed, dataset, None, None)


def survivors(spark, rows):
    trust = spark.createDataFrame([("docx", 1), ("pdf", 4)], "fmt string, trust_rank int")
    return survive.survivors(spark.createDataFrame(rows, FILES), trust).collect()


def test_names(spark):
    from pyspark.sql import functions as F

    names = {"А/Паспорт агрегата 7.pdf": "паспорт агрегата 7", "А/ПАСПОРТ__агрегата 7 (2).docx": "паспорт агрегата 7", "Копия Паспорт  агрегата 7.md": "паспорт агрегата 7", "Паспорт агрегата 7 — копия (3).md": "паспорт агрегата 7", "Паспорт_агрегата_7_copy_2.md": "паспорт агрегата 7",
             "7201-РД-496.12.6 изм.4.pdf": "7201-рд-496.12.6", "7201-РД-496.12.6_изм8.pdf": "7201-рд-496.12.6", "7201-РД-496.12.6-03 (1).pdf": "7201-рд-496.12.6", "Приложение 585-09.pdf": "приложение 585-09", "НТД 54.8.1094-2033.txt": "нтд 54.8.1094-2033", "Вх. 51 лот Ж4.pdf": "вх. 51 лот ж4", "(1).pdf": "(1)"}
    df = spark.createDataFrame([(k,) for k in names], "p string")
    assert {r["p"]: r["k"] for r in df.select("p", survive.name_key(F.col("p")).alias("k")).collect()} == names


def test_groups_reach_through_others(spark):
    rows = [file("x/a.pdf", "S1", "2024-01-01T00:00:00Z"), file("y/b.pdf", "s1", "2024-01-01T03:00:00+03:00", ".DOCX"), file("z/b (1).txt", "s2", None), file("w/c.txt", "S2"), file("q/solo.pdf", ""), file("r/other.pdf", ""), file("x/a.pdf", "old", "2029-01-01T00:00:00Z", indexed="2020-01-01T00:00:00Z"), file(None, "S1")]
    got = survivors(spark, rows)
    # equal instants: the more trusted format is taken
    assert [(r["source_path"], r["n_paths"]) for r in got] == [("y/b.pdf", 4)]
    assert survivors(spark, []) == []


def test_fields_are_voted(spark):
    rows = [file("a/x.pdf", "s", "2024-01-01T00:00:00Z", "pdf", "Project", chunks=3), file("b/x.docx", "s", "2024-01-02T00:00:00Z", "docx", None), file("c/x.txt", "s", "2024-01-01T00:00:00Z", "txt", "archive"), file("d/x.md", "s", "2010-01-01T00:00:00Z", "md", "archive")]
    r = survivors(spark, rows)[0]
    assert (r["source_path"], r["dataset"], r["chunk_count"], r["format"]) == ("b/x.docx", "Project", 3, "docx")


def test_long_chain(spark):
    n = 40
    rows = [file(f"d{i}/n{i // 2}.pdf", f"s{(i + 1) // 2}") for i in range(n)]
    assert [r["n_paths"] for r in survivors(spark, rows)] == [n]


def test_labels_of_planted_boilerplate_held_out(spark):
    import numpy as np
    from conftest import DATA

    texts = sorted(r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").filter("length(text) > 200").select("text").distinct().collect())
    field = repetition.fit_field(texts[::2])
    lines, truth = repetition.labelled(repetition.planted([t for t in texts[1::2] if not repetition.Lines([t]).repeated[0] and len(t) == len(t.lower())], 3))
    label = field.decode(lines)
    hit = ((label == 1) & (truth == 1)).sum()
    assert hit >= 0.9 * label.sum() and hit >= 0.85 * truth.sum() and truth.sum() > 100
    total = np.bincount(lines.text, lines.words)
    share, real = (np.bincount(lines.text, lines.words * (x == 0)) / np.maximum(total, 1) for x in (label, truth))
    assert ((share >= repetition.RETAIN) == (real >= repetition.RETAIN)).mean() >= 0.95


def test_content_decides_retention(spark):
    clean = " ".join(f"слово{i} значение{i * 3} число{i * 5}." for i in range(40))
    rows = [(1, clean), (2, "\n".join(["Купить дешевые трубы и фитинги со склада сегодня"] * 30)), (3, None), (4, "  "), (5, "раз два")]
    got = {r["doc_id"]: r["retained"] for r in repetition.retained(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: True}
