"""Problem 3: one ranking from several differently scaled scores, by median rank.

Every item is ranked within its group in each score; the order is by the weighted median of its
ranks, then their weighted mean, then its identifier. Groups up to ``LARGE`` items are ranked by one
window for each score over a single shuffle. A larger group is never in one task: its distinct
values are counted and cut into ranges over all tasks, and a value's rank is the number of items in
the ranges before it plus the better ones in its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.session import checkpoint

#: Items up to which a group is ranked in one task; no result depends on it.
LARGE = 50_000


def weighted_median(ranks: Column, weights: list[float]) -> Column:
    """The least rank at which half of the weight is reached, of an array of struct(rank, weight)."""
    half = F.lit(sum(weights) / 2)
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("r"))
    step = lambda a, x: F.when(a.r.isNotNull(), a).otherwise(
        F.struct((a.w + x.weight).alias("w"), F.when(a.w + x.weight >= half, x["rank"]).alias("r"))
    )
    return F.aggregate(F.array_sort(ranks), zero, step, lambda a: a.r)


def _windowed(items: DataFrame, n: int) -> DataFrame:
    """items with _r0 .. _rn: mean ranks of _s0 .. _sn within _g."""
    out = items
    for i in range(n):
        w = Window.partitionBy("_g").orderBy(F.col(f"_s{i}").desc_nulls_last())
        equal = F.count("*").over(w.rangeBetween(Window.currentRow, Window.currentRow))
        out = out.withColumn(f"_r{i}", F.rank().over(w) + (equal - 1) / 2)
    return out


def _ranged(items: DataFrame, n: int) -> DataFrame:
    """As _windowed, for groups of any size."""
    long = items.select("_g", "_i", F.posexplode(F.array(*(F.col(f"_s{i}") for i in range(n)))).alias("_k", "_v"))
    values = long.filter("_v is not null").groupBy("_g", "_k", "_v").agg(F.count("*").alias("n"))
    # written, so that a value stays in the range it was counted in
    placed = checkpoint(values.repartitionByRange("_g", "_k", F.desc("_v")).withColumn("_p", F.spark_partition_id()))
    inside = F.sum("n").over(Window.partitionBy("_p", "_g", "_k").orderBy(F.desc("_v")).rowsBetween(Window.unboundedPreceding, -1))
    whole = placed.groupBy("_p", "_g", "_k").agg(F.sum("n").alias("_n"))
    before = whole.withColumn("_before", F.sum("_n").over(Window.partitionBy("_g", "_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    ranks = placed.withColumn("_in", inside).join(before, ["_p", "_g", "_k"])
    ranks = ranks.select("_g", "_k", "_v", (F.coalesce("_in", F.lit(0)) + F.coalesce("_before", F.lit(0)) + (F.col("n") + 1) / 2).alias("_r"))
    there = long.filter("_v is not null").join(ranks, ["_g", "_k", "_v"]).select("_g", "_i", "_k", "_r")
    # all that miss a score share the mean of the ranks behind the present ones
    have = long.groupBy("_g", "_k").agg(F.count("_v").alias("p"), F.count("*").alias("all"))
    none = long.filter("_v is null").join(have, ["_g", "_k"]).select("_g", "_i", "_k", (F.col("p") + (F.col("all") - F.col("p") + 1) / 2).alias("_r"))
    return there.union(none).groupBy("_g", "_i").agg(*(F.max(F.when(F.col("_k") == i, F.col("_r"))).alias(f"_r{i}") for i in range(n)))


def median_rank(hits: DataFrame, group: str, item: str, scores: dict[str, tuple[bool, float]]) -> DataFrame:
    """(group, item, median_rank, mean_rank) for every item; ``best_of_each`` takes the first by them.

    scores: column -> (large is good, weight). Of repeated rows of an item the best value of each
    score counts; null and NaN are missing, and a missing score ranks after all present ones,
    equally for all that miss it. Equal values share the mean of their ranks. A null group is a
    group; rows with a null item are no items. An empty table gives an empty result.
    """
    n = len(scores)
    best = [
        F.max(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double") * (1 if good else -1))).alias(f"_s{i}")
        for i, (c, (good, _)) in enumerate(scores.items())
    ]
    # a struct is equal to itself even where the group in it is null
    keyed = hits.filter(F.col(item).isNotNull()).withColumns({"_g": F.struct(F.col(group).alias("g")), "_i": F.col(item)})
    items = checkpoint(keyed.groupBy("_g", "_i").agg(*best))
    large = items.groupBy("_g").agg(F.count("*").alias("n")).filter(F.col("n") > LARGE).select("_g")
    names = ["_g", "_i", *(f"_r{i}" for i in range(n))]
    if large.isEmpty():
        ranked = _windowed(items, n).select(*names)
    else:
        ranked = _windowed(items.join(large, "_g", "left_anti"), n).select(*names).union(_ranged(items.join(large, "_g", "left_semi"), n).select(*names))
    weights = [float(w) for _, w in scores.values()]
    each = F.array(*(F.struct(F.col(f"_r{i}").cast("double").alias("rank"), F.lit(w).alias("weight")) for i, w in enumerate(weights)))
    mean = sum((F.col(f"_r{i}") * w for i, w in enumerate(weights)), F.lit(0.0)) / F.lit(sum(weights))
    return ranked.select(F.col("_g.g").alias(group), F.col("_i").alias(item), weighted_median(each, weights).alias("median_rank"), mean.alias("mean_rank"))


def best_of_each(ranked: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """The k first of each group with their position; each task keeps k rows of a group before the shuffle."""
    order = Window.partitionBy(group).orderBy("median_rank", "mean_rank", item)
    return ranked.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)
