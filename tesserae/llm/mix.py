"""Problem 9: mixing sources to target weights along a time-varying curriculum.

The size of the mixture is the largest at which every source that has text reaches its share
within its cap on repeats. A source's demand is met by whole passes over its texts and a last
part pass in a fixed pseudo-random order. Each source has a weight schedule over training time
t in [0, 1], w(t) = share * (1 + tilt * (1 - 2t)); the tilts, weighted by share, sum to zero, so
the weights sum to one at any time. Integrating a schedule gives the source's cumulative token
demand; inverting it at the middle of a text's tokens gives the text's position, and the uses are
range-sorted by position.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.encode import LEXICON_SIZE, TOKENIZER, token_counts
from tesserae.session import checkpoint

#: Texts that a slice of a source's pseudo-random order should hold at most; slices are summed apart,
#: which bounds what one task sorts.
SLICE = 20_000
MOST_TILT = 0.5


def default_tilts(shares: dict[str, float]) -> dict[str, float]:
    """Larger sources lean to the beginning, smaller ones to the end; share-weighted mean zero."""
    order = sorted(shares, key=lambda s: (-shares[s], s))
    raw = {s: 1 - 2 * i / max(1, len(order) - 1) for i, s in enumerate(order)}
    total = sum(shares.values())
    mean = sum(raw[s] * shares[s] for s in order) / total if total else 0.0
    most = max((abs(raw[s] - mean) for s in order), default=0.0)
    return {s: MOST_TILT * (raw[s] - mean) / most if most else 0.0 for s in order}


class Mixture:
    """The chosen texts, their order of training and the shares, over one written token table.

    Texts without tokens, of no source or of a source without target are never chosen. A target
    source without any text is reported with an actual share of 0. Empty tables give empty results.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, size: int = LEXICON_SIZE, tilts: dict[str, float] | None = None) -> None:
        spark = docs.sparkSession
        # one row for each target source; the table of targets is an argument, not data that grows
        goal = {r["source"]: (r["share"], r["repeats"]) for r in targets.filter("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats")).collect()}
        wanted = docs.select("doc_id", "source", "text").filter(F.col("source").isin(list(goal)))
        self.tokens = checkpoint(token_counts(wanted, ["doc_id", "source"], tokenizer=tokenizer, size=size).filter("n_tokens > 0").dropDuplicates(["doc_id"]))
        have = {r["source"]: r for r in self.tokens.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows")).collect()}
        supply = {s: r["n"] for s, r in have.items()}
        # slices of the largest source; a power of two, taken from the order's first bits
        self.bits = max(1, (max((r["rows"] for r in have.values()), default=1) // SLICE).bit_length())
        live = {s: goal[s] for s in supply}
        total = min((supply[s] * repeats / share for s, (share, repeats) in live.items()), default=0.0)
        tilt = tilts or default_tilts({s: share for s, (share, _) in live.items()})
        rows = []
        for s, (share, repeats) in sorted(live.items()):
            demand = share * total
            passes = min(int(demand // supply[s] + 1e-9), repeats)
            rows.append((s, share, repeats, passes, demand - passes * supply[s] if passes < repeats else -1.0, float(supply[s]), demand, tilt.get(s, 0.0)))
        self.missing = [(s, share) for s, (share, _) in sorted(goal.items()) if s not in supply]
        self.plan = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, passes int, rest double, supply double, demand double, tilt double")

    @cached_property
    def chosen(self) -> DataFrame:
        """(doc_id, source, n_tokens, uses, before): before is the text's place in its source's tokens. Written once."""
        t = self.tokens.withColumn("_h", F.xxhash64(F.lit("mix"), "doc_id")).withColumn("_s", F.shiftrightunsigned("_h", 64 - self.bits).cast("bigint"))
        sums = t.groupBy("source", "_s").agg(F.sum("n_tokens").alias("_n"))
        ahead = sums.select("source", "_s", F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
        inside = Window.partitionBy("source", "_s").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        t = t.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(ahead, ["source", "_s"]).withColumn("before", F.col("_ahead") + F.col("_in"))
        # a row for each target source
        t = t.join(F.broadcast(self.plan), "source")
        uses = F.col("passes") + (F.col("before") + F.col("n_tokens") / 2 <= F.col("rest")).cast("int")
        return checkpoint(t.withColumn("uses", uses).filter("uses > 0").select("doc_id", "source", "n_tokens", "uses", "before", "supply", "demand", "tilt", "target_share"))

    @staticmethod
    def position(use: Column) -> Column:
        """Where in training a text's use (0 for the first) stands: the schedule's integral inverted."""
        f = F.least(F.lit(1.0), (use * F.col("supply") + F.col("before") + F.col("n_tokens") / 2) / F.col("demand"))
        up = 1 + F.col("tilt")
        return 2 * f / (up + F.sqrt(F.greatest(F.lit(0.0), up * up - 4 * F.col("tilt") * f)))

    def order(self) -> DataFrame:
        """(position, doc_id, source, use): every use of a text, sorted by its position in training."""
        u = self.chosen.withColumn("use", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)))
        return u.select(self.position(F.col("use")).alias("position"), "doc_id", "source", (F.col("use") + 1).alias("use")).orderBy("position", "doc_id", "use")

    def shares(self) -> DataFrame:
        """(source, target_share, actual_share, n_texts, n_uses, n_tokens), a row for each target."""
        used = self.chosen.groupBy("source").agg(F.count("*").alias("n_texts"), F.sum("uses").cast("bigint").alias("n_uses"), F.sum(F.col("uses") * F.col("n_tokens")).alias("n_tokens"))
        c = self.plan.select("source", "target_share").join(used, "source", "left").na.fill(0, ["n_texts", "n_uses", "n_tokens"])
        out = c.withColumn("actual_share", F.coalesce(F.try_divide(F.col("n_tokens"), F.sum("n_tokens").over(Window.partitionBy())), F.lit(0.0)))
        if self.missing:
            none = c.sparkSession.createDataFrame(self.missing, "source string, target_share double").selectExpr("source", "target_share", "0L n_texts", "0L n_uses", "0L n_tokens", "0D actual_share")
            out = out.unionByName(none)
        return out.select("source", "target_share", "actual_share", "n_texts", "n_uses", "n_tokens")

    def texts(self) -> DataFrame:
        """(doc_id, source, n_tokens, uses, position, target_share, actual_share): the chosen texts, by first position."""
        c = self.chosen.withColumn("position", self.position(F.lit(0)))
        # a row for each target source
        shares = F.broadcast(self.shares().select("source", "actual_share"))
        return c.join(shares, "source").select("doc_id", "source", "n_tokens", "uses", "position", "target_share", "actual_share").orderBy("position", "doc_id")
