"""Problem 1: near-duplicate texts by tensored banding.

Two collections of m minhash bands are drawn for every text, and the table keys are pairs of a band
of the first and a band of the second: 2 m bands serve m * m tables. A key can only be shared where
its first band is, so texts meet in buckets of the first collection: a bucket of a few texts gives
its pairs at once, and only larger ones are cut by the bands of the second collection into the keys
of the tables. Candidates are verified exactly on their sets of word runs, so that neither way
decides anything.

Texts with the same words are one class, which one of its texts stands for. With r rows a band and
similarity s a pair is missed with probability at most 1 - (1 - (1 - s^r)^m)^2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.spans import chunks, mix, run_hashes, words
from tesserae.session import checkpoint

#: Largest class (or pair of classes) whose copies ``found`` writes out pair by pair; of a larger one
#: it writes the pairs of first members. ``rows`` tells the members of every class.
EXPAND = 4096
#: Texts of a bucket that are compared at once; a larger bucket is cut by the second collection.
FEW = 4
#: Texts of one part of a bucket that still is larger; parts meet each other in tasks of their own.
PART = 512


def _bands(runs: np.ndarray, start: np.ndarray, rows: int, bands: int, seed: int) -> np.ndarray:
    """2 * bands minhash bands of each set of runs; every set has at least one run."""
    out = np.zeros((len(start), 2 * bands), np.uint64)
    # runs are well mixed already: an odd factor orders them anew
    factor = (mix(np.arange(2 * bands * rows, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    short = (runs >> np.uint64(32)).astype(np.uint32)
    for band in range(2 * bands):
        h = np.full(len(start), band, np.uint64)
        for row in range(rows):
            h = mix(h * np.uint64(0x100000001B3) + np.minimum.reduceat(short * factor[band * rows + row], start))
        out[:, band] = h
    return out


def _digests(word: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """16 bytes that tell a text's sequence of words; none for a text without words."""
    size = np.diff(bounds)
    some = np.flatnonzero(size > 0)
    out: list[bytes | None] = [None] * len(size)
    if len(some):
        place = (np.arange(len(word)) - np.repeat(bounds[:-1], size)).astype(np.uint64)
        two = np.empty((len(some), 2), np.uint64)
        for i in range(2):
            two[:, i] = mix(np.add.reduceat(mix(word ^ mix(place + np.uint64((i + 1) << 40))), bounds[some]) + size[some].astype(np.uint64))
        for i, b in zip(some.tolist(), two):
            out[i] = b.tobytes()
    return out


def sketches(docs: DataFrame, run: int, rows: int, bands: int, seed: int) -> DataFrame:
    """(key, class, runs, bands) of (key, text), for texts with a word; runs are distinct and sorted, and
    there are no bands where a text is shorter than a run."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begin = 0
            for part in chunks(b.column(1), 300_000):
                word, _, _, _, bounds = words(part.to_pylist())
                h, of = run_hashes(word, bounds, run)
                order = np.lexsort((h, of))
                h, of = h[order], of[order]
                fresh = np.ones(len(h), bool)
                fresh[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
                h, of = h[fresh], of[fresh]
                text, start = np.unique(of, return_index=True)
                signature = _bands(h, start, rows, bands, seed) if len(h) else np.zeros((0, 2 * bands), np.uint64)
                worded = np.flatnonzero(np.diff(bounds) > 0)
                ends = np.append(np.searchsorted(of, worded), len(h))
                sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h.view(np.int64)))
                at = np.searchsorted(text, worded)
                at = np.append(at, len(text)) * 2 * bands
                sig = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(signature.ravel().view(np.int64)))
                digest = _digests(word, bounds)
                keys = b.column(0).slice(begin, len(part)).take(pa.array(worded))
                yield pa.record_batch([keys, pa.array([digest[i] for i in worded.tolist()], pa.binary()), sets, sig], ["key", "class", "runs", "bands"])
                begin += len(part)

    kind = docs.schema["key"].dataType.simpleString()
    return docs.select("key", "text").mapInArrow(work, f"key {kind}, class binary, runs array<bigint>, bands array<bigint>")


def _meet(several: DataFrame, bucket: str) -> DataFrame:
    """(a, b), a < b: the pairs of ids of each bucket, of (bucket, id, n). A large bucket is met in parts:
    its left sides are spread, its right sides go to every part."""
    parts = F.ceil(F.col("n") / PART).cast("int")
    x = several.select(bucket, F.col("id").alias("a"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("_p"))
    y = several.select(bucket, F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_p"))
    return x.join(y, [bucket, "_p"]).filter("a < b").select("a", "b")


def _shared(rows: DataFrame, bucket: str) -> DataFrame:
    """(bucket, id, n) of the rows (bucket, id) whose bucket holds n > 1 of them."""
    full = rows.groupBy(bucket).agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(full, bucket)


def candidates(s: DataFrame, reps: DataFrame, bands: int) -> DataFrame:
    """(a, b), a < b: ids of the (id, bands) rows that meet in a bucket, of those in reps (id)."""
    # all later joins find ids of reps only, so this is the one that has to choose them
    of = s.select("id", F.slice("bands", 1, bands).alias("one")).join(reps, "id", "left_semi")
    first = of.select("id", F.posexplode("one").alias("i", "h")).select("id", F.xxhash64("i", "h").alias("bucket"))
    met = checkpoint(_shared(first, "bucket"))
    few = met.filter(F.col("n") <= FEW).groupBy("bucket").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    few = few.select(F.explode("ids").alias("a"), "ids").select("a", F.explode(F.filter("ids", lambda x: x > F.col("a"))).alias("b"))
    # the tables: each band of the second collection with each large bucket of the first
    large = met.filter(F.col("n") > FEW).groupBy("id").agg(F.collect_list("bucket").alias("buckets"))
    keys = s.select("id", F.slice("bands", bands + 1, bands).alias("second")).join(large, "id").select("id", F.explode("buckets").alias("bucket"), "second")
    keys = keys.select("id", "bucket", F.posexplode("second").alias("j", "h")).select("id", F.xxhash64("bucket", "j", "h").alias("key"))
    return few.union(_meet(checkpoint(_shared(keys, "key")), "key")).distinct()


def similar(s: DataFrame, reps: DataFrame, threshold: float, bands: int) -> DataFrame:
    """(a, b, similarity), a < b: ids of the (id, runs, bands) rows whose sets of runs have at least that Jaccard similarity.

    reps (id) are rows of different classes, so that no group of copies meets in a bucket.
    """
    pairs = candidates(s, reps, bands)
    left = s.select(F.col("id").alias("a"), F.col("runs").alias("ra"))
    right = s.select(F.col("id").alias("b"), F.col("runs").alias("rb"))
    common = F.size(F.array_intersect("ra", "rb"))
    both = pairs.join(left, "a").join(right, "b")
    # sets too unlike in size can't be alike
    both = both.filter(F.least(F.size("ra"), F.size("rb")) >= threshold * F.greatest(F.size("ra"), F.size("rb")))
    both = both.select("a", "b", common.alias("c"), (F.size("ra") + F.size("rb")).alias("t"))
    return both.select("a", "b", (F.col("c") / (F.col("t") - F.col("c"))).alias("similarity")).filter(F.col("similarity") >= threshold)


class NearDuplicates:
    """Near-duplicate rows of a table of texts.

    Null, empty and wordless texts, and texts shorter than a run, are near nothing. A key that
    occurs twice identically is one row; with two texts it is near whatever either is near. Tables
    may have any other columns. Empty tables give empty results.
    """

    def __init__(self, texts: DataFrame, key: str, text: str, run: int = 5, threshold: float = 0.8, rows: int = 4, bands: int = 12) -> None:
        self.key = key
        plain = texts.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
        self.keys = plain.select("key").distinct()
        # the numbers are written with the rows, so they stay the same whenever they are read
        s = checkpoint(sketches(plain, run, rows, bands, seed=11).withColumn("id", F.monotonically_increasing_id()))
        member = s.select("key", "class", "id", (F.size("runs") > 0).alias("runs"))
        names = member.groupBy("class").agg(F.min("key").alias("first"), F.min("id").alias("rep"), F.max("runs").alias("alike"))
        self.classes = checkpoint(names)
        self.members = checkpoint(member.select("key", "class").distinct().join(self.classes, "class").select("key", "rep", "first", "alike"))
        reps = self.classes.filter("alike").select(F.col("rep").alias("id"))
        self.pairs = checkpoint(similar(s, reps, threshold, bands))

    def _named(self) -> DataFrame:
        """(a, b, fa, fb): near classes by number, with their first members."""
        a = self.classes.select(F.col("rep").alias("a"), F.col("first").alias("fa"))
        b = self.classes.select(F.col("rep").alias("b"), F.col("first").alias("fb"))
        return self.pairs.select("a", "b").join(a, "a").join(b, "b")

    def found(self) -> DataFrame:
        """(a, b), a < b: pairs of near rows.

        Two rows are near just if they are of one class (of texts that have a run) or the first
        members of their classes are a pair here: ``rows`` tells those. Classes and pairs of classes
        of up to ``EXPAND`` pairs are written out to all their members besides.
        """
        size = self.members.groupBy("rep").agg(F.count("*").alias("n"), F.max("alike").alias("alike"))
        m = self.members
        left, right = size.select(F.col("rep").alias("a"), F.col("n").alias("na")), size.select(F.col("rep").alias("b"), F.col("n").alias("nb"))
        p = self._named().join(left, "a").join(right, "b")
        small = p.filter(F.col("na") * F.col("nb") <= EXPAND)
        ma, mb = m.select(F.col("rep").alias("a"), F.col("key").alias("x")), m.select(F.col("rep").alias("b"), F.col("key").alias("y"))
        across = small.join(ma, "a").join(mb, "b").select("x", "y").union(p.filter(F.col("na") * F.col("nb") > EXPAND).select("fa", "fb"))
        copies = size.filter("n > 1 and alike")
        few = copies.filter(F.col("n") * F.col("n") <= EXPAND).select(F.col("rep").alias("a"), F.col("rep").alias("b"))
        inside = few.join(ma, "a").join(mb, "b").filter("x < y").select("x", "y")
        star = copies.filter(F.col("n") * F.col("n") > EXPAND).select("rep").join(m, "rep").filter("key <> first").select(F.col("first").alias("x"), F.col("key").alias("y"))
        every = across.union(inside).union(star)
        return every.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def rows(self) -> DataFrame:
        """(key, class_id, links): each row's class of copies, by its first member, and its number of near
        classes; a row for every key, without a class where there are no words."""
        ends = self.pairs.select(F.col("a").alias("rep")).union(self.pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
        out = self.keys.join(self.members.join(ends, "rep", "left"), "key", "left")
        return out.select(F.col("key").alias(self.key), F.col("first").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))

    def groups(self) -> DataFrame:
        """(key, group): connected groups of near rows of at least two members, named by their least key."""
        from tesserae.llm.survive import components

        near = self._named().select(F.col("fa").alias("a"), F.col("fb").alias("b"))
        copies = self.members.filter("alike").select(F.col("key").alias("a"), F.col("first").alias("b"))
        r = components(near.union(copies))
        return r.select(F.col("node").alias(self.key), F.col("root").alias("group"))
