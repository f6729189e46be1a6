"""The most frequent rows of a table of counts, brought to the driver within a bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

_STEPS = 32


def most_frequent(counts: DataFrame, n: str, size: int) -> list[Row]:
    """Rows of the highest counts, at most size of them, highest first.

    A histogram of the counts' logarithms, a few hundred rows, gives the cut; only rows above it leave
    their tasks, so what the driver receives doesn't grow with the number of tasks. Rows of the step
    that would pass the bound stay behind. counts is read twice and should be written.
    """
    step = F.floor(F.log(F.col(n).cast("double")) * _STEPS).cast("int")
    have, cut = 0, None
    for b, k in sorted(((r["b"], r["k"]) for r in counts.filter(F.col(n) > 0).groupBy(step.alias("b")).agg(F.count("*").alias("k")).collect()), reverse=True):
        have += k
        if have > size:
            break
        cut = b
    if cut is None:
        return []
    return sorted(counts.filter((F.col(n) > 0) & (step >= cut)).collect(), key=lambda r: (-r[n], r))


def sample_texts(texts: DataFrame, text: str, size: int, condition: Column) -> list[str]:
    """About size different texts that meet a condition, chosen by their hash; at most twice as many.

    Every task sends its share only, and copies of a text count once.
    """
    rows = texts.select(F.col(text).alias("t")).filter(F.col("t").isNotNull() & condition)
    n = rows.count()
    part = min(1_000_000_000, size * 1_000_000_000 // max(1, n))
    some = rows.filter(F.pmod(F.xxhash64("t"), F.lit(1_000_000_000)) < part).distinct()
    return sorted(r[0] for r in some.limit(2 * size).collect())
