"""Documents for a reranker, and reranking that survives a failing scorer."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of a document, of its title and of its head, and characters a token has at least.
BUDGET, TITLE, HEAD, CHARS = 400, 40, 100, 1.8
#: What fills tables of contents and empty cells.
FILLER = r"(?:[.…\-_·•*=~][ \t]*){3,}"
EMPTY_CELLS = r"\|(?:\s*\|){2,}"


def collapsed_filler(text: Column) -> Column:
    """A text without runs of filler and empty table cells; null is empty."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), EMPTY_CELLS, "|")
    return F.regexp_replace(F.regexp_replace(t, FILLER, " "), r"[ \t]{2,}", " ")


def title_of(file_name: Column) -> Column:
    """A document's name without its extension."""
    return F.trim(F.regexp_replace(F.coalesce(file_name, F.lit("")), r"(?i)\.(pdf|docx?|xlsx?|md|txt|csv)$", ""))


def _cut(text: str, tokens: int) -> str:
    return text[: max(16, int(tokens * CHARS))]


def window(parent: str, child: str, budget: int) -> str:
    """The part of a parent of that many tokens that holds its child: from the beginning if that reaches it,
    else the head and a stretch around the child. A child that isn't found is taken alone; without one, the head."""
    if not child.split():
        return _cut(parent, budget)
    found = re.search(r"\s+".join(map(re.escape, child.split()[:8])), parent)
    if not found:
        return _cut(child, budget)
    room = max(16, int(budget * CHARS))
    if max(len(parent), 0) <= room or found.start() + len(child) <= room:
        return parent[:room]
    head = parent[: int(min(HEAD, budget // 4) * CHARS)]
    rest = room - len(head) - 3
    begin = found.start() - max(0, rest - len(child)) // 2
    begin = max(len(head), min(begin, len(parent) - rest))
    return f"{head} … {parent[begin : begin + rest]}"


def rerank_text(file_name: Column, parent: Column, child: Column, budget: int = BUDGET) -> Column:
    """What a reranker reads of a hit: the title's line and the part of its parent around it. Nulls are empty."""

    @F.pandas_udf("string")
    def build(titles: pd.Series, parents: pd.Series, children: pd.Series) -> pd.Series:
        out = []
        for t, p, c in zip(titles, parents, children):
            head = f"{_cut(t, TITLE)}\n" if t else ""
            out.append(head + window(p, c, max(16, budget - int(len(head) / CHARS) - bool(head))))
        return pd.Series(out, dtype=object)

    return build(title_of(file_name), collapsed_filler(parent), collapsed_filler(child))


class Oversize(ValueError):
    """A scorer's answer to documents too long for it."""


def careful(scorer: Callable[[list[str], list[str]], list[float]]) -> Callable[[list[str], list[str]], list[float | None]]:
    """A scorer that tries documents too long again at half their length, and gives no scores where it fails."""

    def run(queries: list[str], texts: list[str]) -> list[float | None]:
        for part in (1, 2):
            try:
                return list(scorer(queries, [t[: len(t) // part] if part > 1 else t for t in texts]))
            except Oversize:
                continue
            except Exception:
                break
        return [None] * len(texts)

    return run


def reranked(rows: DataFrame, q: str, scorer: Callable, text: str, first: int = 64) -> DataFrame:
    """Rows (q, rank, query_text, text) in the order of their scores, with rerank_score and position.

    Only the first rows are scored, the others follow in their order. If a query has a row without a
    score that should have one, the scorer failed: the query keeps its order and has no scores.
    """
    from pyspark.sql import Window

    safe = careful(scorer)

    @F.pandas_udf("double")
    def logit(qs: pd.Series, ts: pd.Series) -> pd.Series:
        return pd.Series(safe(qs.tolist(), ts.fillna("").tolist()), dtype="float64")

    r = rows.withColumn("_l", F.when(F.col("rank") <= first, logit(F.col("query_text"), F.col(text))))
    r = r.withColumn("_l", F.when(~F.isnan("_l"), F.col("_l")))
    failed = F.max((F.col("_l").isNull() & (F.col("rank") <= first)).cast("int")).over(Window.partitionBy(q)) == 1
    r = r.withColumn("_l", F.when(~failed, F.col("_l")))
    order = Window.partitionBy(q).orderBy(F.col("_l").desc_nulls_last(), F.asc("rank"))
    return r.withColumn("rerank_score", F.round(1 / (1 + F.exp(-F.col("_l"))), 4)).withColumn("position", F.row_number().over(order)).drop("_l")
