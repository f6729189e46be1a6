"""Problem 6: one surviving record for each group of duplicate files.

Files are duplicates if their contents are equal or their names are, also through others. Groups are
connected components, found by alternating steps that link each node's larger neighbours to the
least one and then its smaller ones to it, until nothing changes. For each group the fields of its
records are unpivoted to long rows; every value gets the votes of its holders, source trust times
recency decay, summed over equal normalised values; the winner of each field is taken by max_by
order of votes, recency, trust and value, and the winners are pivoted back into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import content_key, instant, last_part
from tesserae.operators.incremental import current_files
from tesserae.session import checkpoint

#: Half-life of a record's vote in days.
HALF_LIFE = 365.0
FIELDS = ("source_path", "file_name", "format", "sha256", "created_at", "modified_at", "chunk_count", "status", "indexed_at", "dataset", "is_deprecated", "parent_source_path")

_COPY = r"(?:\s*\(\s*\d+\s*\)|\s*[-–—]?\s*\(?(?:копия|copy)\)?(?:\s*\(?\d+\)?)?)"
_CHANGE = r"[\s,;(\-–—]*(?:изменение|изм|ревизия|рев|редакция|ред|revision|rev)\.?\s*№?\s*\d+\)?"
_ISSUE = r"(?<=\d\.\d{1,4})-\d{2}"


def name_key(path: Column) -> Column:
    """What identifies a document's name: without extension, case, copy marks and revision marks.

    Revision marks are a worded change number and a two-digit issue number behind a dotted sheet
    number. A name that consists of marks only is kept as it is.
    """
    name = F.lower(F.regexp_replace(last_part(path), r"\.[A-Za-z][A-Za-z0-9]{0,4}$", ""))
    name = F.trim(F.regexp_replace(name, r"(?U)[\s_]+", " "))
    bare = F.regexp_replace(name, r"(?U)^(?:копия|copy of|copy)(?:\s*\(\d+\))?\s+(?:[-–—]\s+)?", "")
    bare = F.trim(F.regexp_replace(bare, rf"(?U)(?:{_COPY}|{_CHANGE}|{_ISSUE})+$", ""))
    return F.when(F.length(bare) > 0, bare).when(F.length(name) > 0, name)


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of links (a, b): root is the least node reachable. Distributed throughout.

    Each step reduces per node by a minimum that is combined before the shuffle; a node with very
    many links is never gathered in one place.
    """
    edges = checkpoint(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most_rounds):
        # large step: from each node, its larger neighbours link to its least one
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        edges = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.filter("m < a").select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        # small step: its smaller neighbours and the node itself link to the least one
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        edges = checkpoint(edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components: no fixed point")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def groups(files: DataFrame) -> DataFrame:
    """The current rows with their group; only groups of at least two paths.

    Rows of one key are linked to the key's least path, so a key that holds much of the table costs
    one link a row. Null and empty contents link nothing.
    """
    now = checkpoint(current_files(files))
    keys = now.select("source_path", F.explode(F.array(
        F.concat(F.lit("c:"), F.lower(F.trim("sha256"))), F.concat(F.lit("n:"), name_key(F.col("source_path"))))).alias("key"))
    keys = keys.filter("key is not null and key <> 'c:'")
    least = keys.groupBy("key").agg(F.min("source_path").alias("b"))
    root = components(keys.join(least, "key").select(F.col("source_path").alias("a"), "b"))
    return now.join(root, now.source_path == root.node).drop("node").withColumnRenamed("root", "group")


def survivors(files: DataFrame, trust: DataFrame, half_life: float = HALF_LIFE) -> DataFrame:
    """One record for each group, built field by field; columns: group, the fields of files, n_paths.

    Null and blank values have no vote; a field nobody states stays null. Values are normalised for
    the count (trimmed, small letters, single blanks; times as instants; format without a dot); of a
    value's spellings the one of the latest, most trusted holder survives. The path is elected by recency,
    trust and order alone. Formats without a rank are trusted least. A null time is the oldest.
    """
    rank = trust.filter("fmt is not null").groupBy(F.lower(F.regexp_replace(F.trim("fmt"), r"^\.", "")).alias("_f")).agg(F.min("trust_rank").alias("_rank"))
    g = groups(files).withColumn("_fmt", F.lower(F.regexp_replace(F.trim("format"), r"^\.", "")))
    g = g.join(rank, F.col("_fmt") == F.col("_f"), "left").withColumn("_rank", F.coalesce("_rank", F.lit(2**30)))
    at = F.unix_micros(instant(F.col("modified_at")))
    day = 86_400_000_000
    # votes of one group scale together, so the day the decay counts from doesn't matter
    vote = F.pow(F.lit(2.0), (F.coalesce(at, F.lit(0)) / day - 18000) / half_life) / F.col("_rank")
    have = [c for c in FIELDS if c in files.columns]
    long = g.select("group", F.col("source_path").alias("_p"), F.coalesce(-at, F.lit(2**62)).alias("_late"), "_rank", vote.alias("_vote"),
                    F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in have))).alias("x"))
    long = long.select("group", "_p", "_late", "_rank", "_vote", "x.field", "x.value").filter("trim(value) <> ''")
    plain = F.lower(F.regexp_replace(F.trim("value"), r"\s+", " "))
    norm = F.when(F.col("field").isin("created_at", "modified_at", "indexed_at"), F.coalesce(instant(F.col("value")).cast("string"), plain)).when(F.col("field") == "format", F.regexp_replace(plain, r"^\.", "")).when(F.col("field") == "source_path", F.col("value")).otherwise(plain)
    place = F.struct("_late", "_rank", "_p")
    each = long.groupBy("group", "field", norm.alias("_norm")).agg(F.sum("_vote").alias("_votes"), F.min(place).alias("_place"), F.min_by("value", place).alias("value"))
    # max_by of (votes, recency, trust, path), written as min_by of the negated order
    votes = F.when(F.col("field") == "source_path", F.lit(0.0)).otherwise(-F.round("_votes", 9))
    won = each.groupBy("group").pivot("field", have).agg(F.min_by("value", F.struct(votes.alias("v"), F.col("_place").alias("p"))))
    size = g.groupBy("group").agg(F.count("*").alias("n_paths"))
    typed = [F.col(f"`{c}`").cast(files.schema[c].dataType).alias(c) for c in have]
    return won.join(size, "group").filter("n_paths > 1").select("group", *typed, "n_paths")
