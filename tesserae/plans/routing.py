"""Routing of questions to a domain, and the plan of subqueries."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import folded


@dataclass(frozen=True)
class Domain:
    """A subject with the words that point to it; patterns count double. authoritative domains settle the dataset."""

    name: str
    dataset: str
    terms: tuple[str, ...]
    patterns: tuple[str, ...] = ()
    folder: str | None = None
    authoritative: bool = False
    expansions: tuple[str, ...] = ()


#: Domains of the default vocabulary; a configuration replaces them by name.
DOMAINS = (
    Domain("normative_fire", "normative", ("противодым", "дымоудал", "пожар", "эвакуац", "огнестойк"), (r"сп\s*7(?:\.13130)?",), None, True, ("предел огнестойкости", "противопожарная защита")),
    Domain("normative_hvac", "normative", ("вентиляц", "отоплен", "кондиционир", "воздухообмен", "микроклимат"), (r"сп\s*60(?:\.13330)?",), None, True, ("расход воздуха", "кратность воздухообмена")),
    Domain("project_hvac", "project", ("воздуховод", "клапан", "вентилятор", "чиллер", "шумоглушител"), (), "ОВ1", False, ("спецификация оборудования", "ведомость объёмов")),
    Domain("project_electric", "project", ("кабель", "автомат", "щит", "ток утечки"), (), "ЭОМ", False, ("кабельный журнал",)),
)


def term_pattern(term: str) -> str:
    """A term begins at a word's start; a short one also ends there."""
    t = re.escape(term.lower().replace("ё", "е"))
    return rf"(?<![0-9a-zа-я]){t}" + (r"(?![0-9a-zа-я])" if len(term) < 5 else "")


@dataclass(frozen=True)
class Route:
    name: str
    dataset: str | None
    folder: str | None
    confidence: float
    ambiguous: bool
    reason: str


def scores(question: str, domains: tuple[Domain, ...] = DOMAINS) -> dict[str, int]:
    q = " ".join(question.lower().replace("ё", "е").split())
    return {d.name: sum(bool(re.search(term_pattern(t), q)) for t in d.terms) + 2 * sum(bool(re.search(p, q, re.I)) for p in d.patterns) for d in domains}


def route(question: str, dataset: str | None = None, folder: str | None = None, domains: tuple[Domain, ...] = DOMAINS) -> Route:
    """The domain of a question. What the caller names wins; a near tie, or a strong second of another
    dataset, leaves the dataset open unless the first is authoritative; a folder needs confidence."""
    s = scores(question, domains)
    order = sorted(domains, key=lambda d: (-s[d.name], d.name))
    total, top = sum(s.values()), order[0]
    if not total:
        return Route("default", dataset, folder, 0.0, False, "no_terms")
    best, second = s[top.name], s[order[1].name] if len(order) > 1 else 0
    sure, near = best / total, (best - second) / total < 0.12
    clash = len(order) > 1 and order[1].dataset != top.dataset and second >= 0.4 * best
    settled = top.dataset if top.authoritative or not (near or clash) else None
    inside = top.folder if sure >= 0.62 and not near and not clash else None
    return Route(top.name, dataset or settled, folder or inside, round(sure, 4), near or clash, "explicit" if dataset or folder else "ambiguous" if near or clash else "scored")


def route_all(questions: DataFrame, key: str, text: str, domains: tuple[Domain, ...] = DOMAINS) -> DataFrame:
    """(key, domain, points, confidence): the best domain of every question, as columns: no join, no shuffle."""
    q = folded(F.col(text))
    per = []
    for d in domains:
        points = sum((q.rlike(term_pattern(t)).cast("int") for t in d.terms), F.lit(0)) + 2 * sum((q.rlike("(?i)" + p).cast("int") for p in d.patterns), F.lit(0))
        per.append(F.struct(points.alias("points"), F.lit(d.name).alias("domain")))
    all_ = F.array(*per)
    r = questions.select(key, all_.alias("p")).withColumn("total", F.aggregate("p", F.lit(0), lambda a, x: a + x["points"]))
    best = F.array_sort("p", lambda a, b: F.when(a["points"] > b["points"], -1).when(a["points"] < b["points"], 1).when(a["domain"] < b["domain"], -1).otherwise(1))
    r = r.filter("total > 0").withColumn("b", F.get(best, F.lit(0)))
    return r.select(key, F.col("b.domain").alias("domain"), F.col("b.points").cast("long").alias("points"), F.round(F.col("b.points") / F.col("total"), 4).alias("confidence"))


@dataclass(frozen=True)
class Plan:
    route: Route
    queries: tuple[str, ...]
    codes: tuple[str, ...] = ()
    norms: tuple[str, ...] = ()
    alpha: float = 0.7
    pool: int = 30
    channels: tuple[str, ...] = field(default=("dense", "lexical"))


_CODE = re.compile(r"""[^\s,;()\[\]«»"']+""")


def codes_of(question: str) -> list[str]:
    """Identifiers in a question, at most six, without the names of norms."""
    out = []
    for t in _CODE.findall(question):
        t = t.strip(".,;:")
        if len(t) < 3 or not re.search(r"\d", t) or re.fullmatch(r"\d+(?:[.,]\d+)?", t):
            continue
        if re.fullmatch(r"\w+(?:[.\-/]\w+){2,}", t) or (re.search(r"[^\W\d_]", t) and re.fullmatch(r"[\w.\-/]{5,}", t)) or re.fullmatch(r"[^\W\d_]{1,4}\d{1,3}-\w{1,6}", t):
            out.append(t)
    return list(dict.fromkeys(out))[:6]


def norms_of(question: str) -> list[str]:
    q = " ".join(question.replace("ё", "е").split())
    found = [f"{m[1].upper()} {m[2]}" for m in re.finditer(r"(?i)(?<![а-яa-z0-9])(гост р|гост|снип|санпин|всн|сп|сто|рд|ртн|нтд|вит)\s*№?\s*(\d+(?:[.\-]\d+)*)", q)]
    found += [f"{m[1]}-ФЗ" for m in re.finditer(r"(?i)(?<![\w.])(\d{1,4})\s*-\s*фз(?!\w)", q)]
    return list(dict.fromkeys(found))[:3]


def distinct_queries(queries: list[str], most: int) -> tuple[str, ...]:
    """Questions in order, each once whatever its case and blanks."""
    seen: dict[str, str] = {}
    for q in queries:
        text = " ".join(q.split())
        if text:
            seen.setdefault(text.casefold(), text)
    return tuple(list(seen.values())[:most])


def plan(question: str, top_k: int = 8, dataset: str | None = None, folder: str | None = None, domains: tuple[Domain, ...] = DOMAINS) -> Plan:
    """Subqueries, channels and weights of a question; one with identifiers leans to the lexical channel."""
    r = route(question, dataset, folder, domains)
    d = next((x for x in domains if x.name == r.name), None)
    norms = norms_of(question)
    codes = [c for c in codes_of(question) if not any(c in n for n in norms)]
    queries = distinct_queries([question, *(f"{question} {e}" for e in (d.expansions if d and not codes else ()))], 4)
    channels = ("dense", "lexical", *(("exact",) if codes else ()), *(("named_norm",) if norms and not (dataset or folder) else ()))
    return Plan(r, queries, tuple(codes), tuple(norms), 0.25 if codes else 0.7, max(24, 8 * max(1, min(20, top_k)), 30), channels)

