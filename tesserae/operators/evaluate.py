"""Retrieval evaluation: relevance, ranks, gates and repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def relevant(expected: Column, *texts: Column) -> Column:
    """Whether one of the expected strings occurs in the texts together, whatever the case."""
    blob = F.lower(F.concat_ws(" ", *texts))
    return F.exists(expected, lambda e: F.contains(blob, F.lower(e)))


def case_metrics(results: DataFrame, case: str, k: int) -> DataFrame:
    """(case, hit, rr, precision, n) of results (case, rank, relevant); precision is of the rows returned, not of k."""
    r = results.filter(F.col("rank") <= k)
    g = r.groupBy(case).agg(F.max(F.col("relevant").cast("int")).alias("hit"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("_f"), F.avg(F.col("relevant").cast("double")).alias("precision"), F.count("*").alias("n"))
    return g.select(case, "hit", F.coalesce(1.0 / F.col("_f"), F.lit(0.0)).alias("rr"), "precision", "n")


def averages(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("precision"), 6).alias("precision"))


def spread(runs: DataFrame, by: list[str], metric: str) -> DataFrame:
    """Median, least, greatest and spread of a metric over repeated runs."""
    g = runs.groupBy(*by).agg(F.round(F.expr(f"percentile({metric}, 0.5)"), 6).alias("median"), F.round(F.min(metric), 6).alias("least"), F.round(F.max(metric), 6).alias("most"))
    return g.withColumn("spread", F.round(F.col("most") - F.col("least"), 6))


def unstable(runs: DataFrame, case: str, metric: str) -> DataFrame:
    """Cases whose metric, to three digits, differs between runs."""
    return runs.groupBy(case).agg(F.count_distinct(F.round(metric, 3)).alias("values")).filter("values > 1")


def significant(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """(by, delta, significant) of two arms with (median, spread): a difference counts beyond the larger spread."""
    j = a.select(by, F.col("median").alias("_a"), F.col("spread").alias("_sa")).join(b.select(by, F.col("median").alias("_b"), F.col("spread").alias("_sb")), by)
    delta = F.round(F.col("_b") - F.col("_a"), 6)
    return j.select(by, delta.alias("delta"), (F.abs(delta) > F.greatest("_sa", "_sb")).alias("significant"))


def gates(results: DataFrame, case: str, needs: dict[str, Column]) -> DataFrame:
    """(case, failed): the names of the gates no row of a case passes, joined by commas; forbidden ones are given negated for all rows."""
    g = results.groupBy(case).agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(f"_{n}") for n, c in needs.items()))
    return g.select(case, F.array_join(F.array_compact(F.array(*(F.when(~F.col(f"_{n}"), F.lit(n)) for n in needs))), ",").alias("failed"))


def ranked(rows: DataFrame, case: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(case).orderBy(*order)))
