import os
import unicodedata

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import encode, lexicon, mix, spans

TEXTS = ["", None, " ", "  \n ", "Расход 12,5 м³/ч — R.L2.15.114", "it's we'll 'tis 's", "''s 'S don't'll\n've x'd's'", "l'eau d'un ''re '", "a" + chr(0xA0) * 2 + "b" + chr(0x3000) + "c \r\n\r\n d", "x" + chr(0x1C) + "y  ", "😀é" + chr(0x301) + "²½", "слово " * 30_000, "Q:/a/b.pdf\t\t\tq", chr(0) + "z", ":" + chr(0x323B0) + "a", "x" + chr(0x1C89) + "y 1" + chr(0x10D40)]


@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 50_000), max_size=4), max_size=60), st.lists(st.binary(max_size=7), max_size=20))
@settings(max_examples=60, deadline=None)
def test_transducer_holds_exactly_its_words(words, others):
    t = lexicon.Transducer(lexicon.build(words))
    asked = list(words) + others
    for w, i in zip(asked, t.numbers(asked).tolist()):
        assert (t.ids_of(i).tolist() == words[w]) if w in words else i == -1


def test_suffixes_are_shared():
    t = lexicon.Transducer(lexicon.build({a + b"ing": [1] for a in (b"walk", b"talk", b"balk")}))
    assert len(t.final) == 8  # one path for the common ending


SPLITTER = regex.compile(encode.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text("'sStdmrevl \n1.,é", max_size=30)), max_size=12))
@settings(max_examples=400, deadline=None)
def test_splits_as_the_pattern(texts):
    joined, start, end, _, bounds = spans.pretokens(texts)
    for i, t in enumerate(texts):
        # the two libraries name different characters of the newest Unicode
        if all(unicodedata.category(c) != "Cn" for c in t or ""):
            assert [joined[a:b] for a, b in zip(start[bounds[i] : bounds[i + 1]], end[bounds[i] : bounds[i + 1]])] == SPLITTER.findall(t or "")


@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(os.path.dirname(encode.TOKENIZER), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.mark.parametrize("size", [0, 3, 40_000])
def test_ids_equal_the_tokenizer(spark, exact, size):
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encode.encode_corpus(df, size=size).collect()}
    assert got == {i: exact(t) for i, t in enumerate(TEXTS)}
    assert got[0] == [] and got[1] == []


def test_empty_table(spark):
    assert encode.encode_corpus(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_whole_corpus(spark, exact):
    from conftest import DATA

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: r["ids"] for r in encode.encode_corpus(docs).collect()}
    assert got == {r["doc_id"]: exact(r["text"]) for r in docs.collect()}


def test_mixture(spark, exact):
    from conftest import DATA

    docs, goal = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/mix_targets.parquet")
    m = mix.Mixture(docs, goal)
    size = {r["doc_id"]: (r["source"], len(exact(r["text"]))) for r in docs.collect()}
    cap = {r["source"]: r["max_repeats"] for r in goal.collect()}
    chosen = m.texts().collect()
    assert all(size[r["doc_id"]] == (r["source"], r["n_tokens"]) and 0 < r["uses"] <= cap[r["source"]] for r in chosen)
    assert len({r["doc_id"] for r in chosen}) == len(chosen)
    total = sum(r["uses"] * r["n_tokens"] for r in chosen)
    biggest = {s: max(n for x, n in size.values() if x == s) for s in cap if any(x == s for x, _ in size.values())}
    shares = {r["source"]: r for r in m.shares().collect()}
    assert set(shares) == set(cap) and abs(sum(r["actual_share"] for r in shares.values()) - 1) < 1e-9
    live = sum(shares[s]["target_share"] for s in biggest)
    for s, n in biggest.items():
        assert abs(shares[s]["actual_share"] - shares[s]["target_share"] / live) <= (n * len(biggest)) / total
    order = m.order().collect()
    assert len(order) == sum(r["uses"] for r in chosen)
    p = [r["position"] for r in order]
    assert p == sorted(p) and 0 <= p[0] and p[-1] <= 1
    # by the schedule a source's first half of tokens lies where its integral says
    tilt = {r["source"]: r["tilt"] for r in m.plan.collect()}
    assert abs(sum(tilt[s] * shares[s]["target_share"] for s in tilt)) < 1e-9


def test_mixture_of_nothing(spark):
    docs, goal = spark.createDataFrame([(1, None, None), (2, "", "a"), (3, "слово", "b")], "doc_id bigint, text string, source string"), spark.createDataFrame([("a", 0.5, 2), ("c", 0.5, 1)], "source string, target_share double, max_repeats int")
    m = mix.Mixture(docs, goal)
    assert m.texts().count() == 0 and m.order().count() == 0
    assert {(r["source"], r["actual_share"]) for r in m.shares().collect()} == {("a", 0.0), ("c", 0.0)}


def test_hot_source(spark):
    docs = spark.createDataFrame([(i, "слово " * (1 + i % 5), "hot" if i % 3 else "cold") for i in range(600)], "doc_id bigint, text string, source string")
    goal = spark.createDataFrame([("hot", 0.5, 1), ("cold", 0.5, 4)], "source string, target_share double, max_repeats int")
    r = {x["source"]: x["actual_share"] for x in mix.Mixture(docs, goal).shares().collect()}
    assert abs(r["hot"] - 0.5) < 0.01
