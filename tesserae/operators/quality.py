"""Quality scores of passages. All parts of a text's score come from one Arrow kernel: each text is split into words once."""

from __future__ import annotations

import functools
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tesserae.functions.text import STOP_WORDS, contains_whole

#: Phrases of title pages, of binding text and of drawing stamps.
TITLE_MARKERS = ("утвержден", "введен в действие", "национальный стандарт", "межгосударственный стандарт", "предисловие", "дата введения", "окс ", "мкс ", "информация об изменениях", "федерального агентства по техническому регулированию")
SUBSTANTIVE_MARKERS = ("должен", "должна", "должны", "следует", "не менее", "не более", "допускается", "принимается", "требования", "таблица", "пункт", "расчет", "расчёт", "предел")
STAMP_MARKERS = ("copyright by", "формат:", "подп. дата", "подп. и дата", "инв.", "инв.№", "лист листов", "стадия", "кол.уч", "№док", "заказчик:", "разраб.", "проверил", "н.контр")
#: The disciplines of a project with the words that name them, and the words of the first that exclude the third.
DISCIPLINES = {
    "ов": ("ов", "пв", "вентиляц", "дымоудален", "противодым", "подпор"),
    "вк": ("вк", "водопровод", "канализац"),
    "эом": ("эом", "электро", "освещен", "светильник", "кабель"),
    "спз": ("спз", "пожар", "сигнализац", "оповещен"),
}
OPPOSED = ("эом", ("ов", "вентиляц", "противодым", "дымоудален"))
#: Thresholds and weights of a table's or stamp's look, each with the share or count it starts from.
MOST_NOISE, BLANK = 0.58, 0.35

_TOKEN = re.compile("[0-9a-zа-яё]+")
_LINES = re.compile(r"\r\n|\n|\r")
_SIZES = re.compile(r"(?<![0-9a-zа-яё_])[0-9]{2,5} *[xх] *[0-9]{2,5}(?![0-9a-zа-яё_])")
_LEVELS = re.compile(r"[-+][0-9]{1,3}[,.][0-9]{2,3}(?![0-9a-zа-яё_])")
_FILLER = re.compile(r"(?<![0-9a-zа-яё_])а(?:[ \t\n\r]+а){8,}(?![0-9a-zа-яё_])")
_CLAUSE = re.compile(r"(?:^|[ \t\n\r])(?:п\.|пункт|таблица)[ \t\n\r]*[0-9]+")


def _words(low: str) -> list[str]:
    return [t for t in _TOKEN.findall(low) if len(t) >= 2 and t not in STOP_WORDS]


def _count(text: Column, markers: tuple[str, ...]) -> Column:
    return sum((text.contains(m).cast("int") for m in markers), F.lit(0))


def title_penalty(text: Column) -> Column:
    low = F.lower(text)
    n = _count(F.substring(low, 1, 1800), TITLE_MARKERS)
    p = F.least(F.lit(0.48), 0.12 * n)
    return F.round(F.when(n == 0, 0.0).when(low.contains("область применения"), p * 0.65).otherwise(p), 4)


def noise_of(low: str) -> float:
    """How much a lower-cased text looks like the dump of a table or a drawing's stamp; a blank text has ``BLANK``."""
    if not low.strip(" "):
        return BLANK
    words = _words(low)
    n = max(1, len(words))
    lines = [x for x in _LINES.split(low) if x.strip(" ")]
    pipes = low.count("|")
    digit = [w for w in words if any(c in "0123456789" for c in w)]
    stamps = sum(m in low for m in STAMP_MARKERS)
    top = max(Counter(words).values(), default=0)
    total = 0.0
    total += min(0.28, pipes / max(200.0, len(low)) * 4.0) if pipes >= 10 else 0
    total += 0.18 if sum(x.count("|") >= 3 for x in lines) / max(1, len(lines)) >= 0.35 else 0
    total += 0.16 if top / n >= 0.18 else 0
    total += 0.12 if low.count("шт.") >= 8 else 0
    total += 0.22 if _FILLER.search(low) else 0
    total += 0.10 if n >= 25 and sum(len(w) <= 2 for w in words) / n >= 0.55 else 0
    total += 0.14 if n >= 20 and len(digit) / n >= 0.35 else 0
    total += 0.16 if sum(len(w) >= 5 for w in digit) >= 8 else 0
    total += 0.12 if len(_SIZES.findall(low)) >= 2 else 0
    total += 0.12 if len(_LEVELS.findall(low)) >= 3 else 0
    total += min(0.34, 0.08 * stamps) if stamps >= 3 else 0
    return _round(min(MOST_NOISE, total))


def _round(x: float) -> float:
    """Four decimals, a half goes away from zero."""
    return float(int(abs(x) * 10_000 + 0.5 + 1e-9)) / 10_000 * (1 if x >= 0 else -1)


def table_penalty(text: Column) -> Column:
    """``noise_of`` of each text; a null text is a blank one."""

    @arrow_udf("double")
    def kernel(t: pa.Array) -> pa.Array:
        return pa.array([noise_of((x or "").lower()) for x in t.to_pylist()], pa.float64())

    return kernel(text)


def word_shares(text: Column) -> Column:
    """struct(top_share, tokens): the share of a text's most frequent word, and its number of words."""

    @arrow_udf("top_share double, tokens bigint")
    def kernel(t: pa.Array) -> pa.Array:
        out = []
        for x in t.to_pylist():
            w = _words((x or "").lower())
            out.append({"top_share": max(Counter(w).values(), default=0) / max(1, len(w)), "tokens": len(w)})
        return pa.array(out, pa.struct([("top_share", pa.float64()), ("tokens", pa.int64())]))

    return kernel(text)


def query_words(query: str) -> list[str]:
    return sorted({t for t in re.findall(r"[0-9a-zа-яё]+", query.lower()) if len(t) >= 3 and t not in STOP_WORDS})


@functools.lru_cache(50_000)
def discipline_points(query: str, source: str) -> float:
    """What a source's discipline adds or costs for a question about a project; both lower-cased."""
    asked = [k for k, words in DISCIPLINES.items() if any(w in query for w in (k, *words))]
    points = 0.0
    if asked:
        points += 0.24 if any(w in source for k in asked for w in (k, *DISCIPLINES[k])) else -0.18
    if OPPOSED[0] in source and any(w in query for w in OPPOSED[1]):
        points -= 0.16
    return points


def bonuses(query: str, text: Column, source: Column, dataset: Column) -> Column:
    """struct(lexical_bonus, substantive_bonus, path_bonus, table_penalty) of passages."""
    words, low_query = query_words(query), query.lower()
    phrase = " ".join(_words(low_query))
    names = ("lexical_bonus", "substantive_bonus", "path_bonus", "table_penalty")

    @arrow_udf(", ".join(f"{n} double" for n in names))
    def kernel(texts: pa.Array, sources: pa.Array, datasets: pa.Array) -> pa.Array:
        cols: list[list[float]] = [[], [], [], []]
        for t, s, d in zip(texts.to_pylist(), sources.to_pylist(), datasets.to_pylist()):
            t, s = (t or "").lower(), (s or "").lower()
            named = sum(w in s for w in words)
            said = min(0.22, sum(w in t for w in words) * 0.045) + min(0.20, named * 0.055)
            cols[0].append(_round(min(0.38, said + (0.10 if phrase and phrase in t else 0.0))) if words else 0.0)
            binding = min(0.20, sum(m in t for m in SUBSTANTIVE_MARKERS) * 0.035)
            cols[1].append(_round(min(0.25, binding + (0.05 if d == "normative" and _CLAUSE.search(t) else 0.0))))
            place = min(0.12, named * 0.03) + (discipline_points(low_query, s) if d == "project" else 0.0)
            cols[2].append(_round(max(-0.35, min(0.35, place))))
            cols[3].append(noise_of(t))
        return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in cols], list(names))

    return kernel(text, source, dataset)


def exact_bonus(codes: list[str], text: Column) -> tuple[Column, Column]:
    hits = sum((contains_whole(text, c).cast("int") for c in codes), F.lit(0))
    return hits, F.round(F.least(F.lit(0.45), 0.25 * hits), 4)


def quality(rows: DataFrame, query: str, codes: list[str], text: Column, source: Column, base: Column, dataset: Column, named: Column | None = None) -> DataFrame:
    """rows with the parts of their quality and the adjusted score in 0..1. Null texts and sources count as empty.

    dataset is "project" (disciplines count), "normative" (clauses count) or neither; codes are looked
    for in the text and in named, the file's name (by default the source).
    """
    t, s = F.coalesce(text, F.lit("")), F.coalesce(source, F.lit(""))
    hits, exact = exact_bonus(codes, F.concat_ws(" ", t, s if named is None else F.coalesce(named, F.lit(""))))
    r = rows.withColumn("_b", bonuses(query, t, s, dataset))
    r = r.withColumns({
        "base_score": F.round(F.coalesce(base, F.lit(0.0)), 4), "title_penalty": title_penalty(t), "table_penalty": F.col("_b.table_penalty"),
        "lexical_bonus": F.col("_b.lexical_bonus"), "substantive_bonus": F.col("_b.substantive_bonus"), "path_bonus": F.col("_b.path_bonus"), "exact_hits": hits, "exact_bonus": exact,
    }).drop("_b")
    total = F.expr("base_score + exact_bonus + lexical_bonus + substantive_bonus + path_bonus - title_penalty - table_penalty")
    return r.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4))
