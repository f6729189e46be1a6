"""Upkeep of an index: when to compact, what to remove, recovery, backfills and comparisons."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.corpus import consistency
from tesserae.sources.versions import VersionedTable

#: Rows outside the index from which upkeep is due, and hours after which any row makes it due.
UNINDEXED, HOURS = 20_000, 24.0


def upkeep_due(unindexed: int, last: float | None, now: float, force: bool = False, limit: int = UNINDEXED, hours: float = HOURS) -> str | None:
    """Why upkeep is due; None if it isn't. Times in seconds; last is None before the first run."""
    if force:
        return "forced"
    if last is None:
        return "first"
    if unindexed >= limit:
        return "rows"
    return "age" if unindexed > 0 and now - last >= 3600 * hours else None


def upkeep(table: VersionedTable, unindexed: int, last: float | None, force: bool = False, keep: int = 1) -> dict:
    """Compact a table if that is due and remove what the last keep versions don't need."""
    reason = upkeep_due(unindexed, last, time.time(), force)
    if reason is None or not table.version():
        return {"done": False, "reason": reason}
    version = table.compact()
    return {"done": True, "reason": reason, "version": version, "removed": table.collect_garbage(max(1, version - keep + 1))}


def remove_old_folders(spark, root: str, prefixes: tuple[str, ...], min_age: float) -> list[str]:
    """Delete folders of the shared root with one of the prefixes (stages, checkpoints) that are older than min_age seconds.

    A younger one may belong to a run that hasn't committed yet.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for x in fs.listStatus(path) if fs.exists(path) else ():
        name = x.getPath().getName()
        if name.startswith(prefixes) and time.time() - x.getModificationTime() / 1000 >= min_age:
            fs.delete(x.getPath(), True)
            gone.append(name)
    return sorted(gone)


def recover(files: DataFrame, parents: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables put right: parents and chunks without a file fall away, files without their vectors
    are to be indexed again. A second run changes nothing."""
    bad = consistency(files, parents, chunks)
    of = lambda kind: bad.filter(F.col("kind") == kind).select("source_path")
    again = of("missing_vectors").withColumn("_again", F.lit(True))
    f = files.join(again, "source_path", "left").withColumn("status", F.when(F.col("_again"), "reindexing").otherwise(F.col("status"))).drop("_again")
    return f.select(*files.columns), parents.join(of("orphan_parents"), "source_path", "left_anti").select(*parents.columns), chunks.join(of("orphan_vectors"), "source_path", "left_anti").select(*chunks.columns)


def backfill_rules(parents: DataFrame, extract: Callable[[str], list[str]]) -> DataFrame:
    """(source_path, status, processed_chunks, rules): the rules of each file's parents, all or nothing.

    Parents without a digit are passed over. extract may raise: a file with a failed parent is partial,
    or failed if none was read, and has no rules, so that it replaces nothing. Files are read in
    parallel, parent by parent; a file's results meet as counts, not as texts.
    """
    rows = parents.select("source_path", "parent_id", "parent_text").filter(F.col("parent_text").rlike("[0-9]")).dropDuplicates(["parent_id"])

    @F.pandas_udf("ok boolean, rules array<string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            try:
                out.append((True, list(extract(t) or [])))
            except Exception:
                out.append((False, []))
        return pd.DataFrame(out, columns=["ok", "rules"])

    r = rows.withColumn("_r", run(F.col("parent_text"))).select("source_path", "parent_id", "_r.ok", "_r.rules")
    g = r.groupBy("source_path").agg(F.count(F.when(F.col("ok"), 1)).alias("processed_chunks"), F.bool_and("ok").alias("_all"), F.array_sort(F.collect_list(F.struct("parent_id", "rules"))).alias("_rules"))
    status = F.when(F.col("_all"), "success").when(F.col("processed_chunks") > 0, "partial").otherwise("failed")
    rules = F.when(F.col("_all"), F.flatten(F.transform("_rules", lambda x: x["rules"]))).otherwise(F.array().cast("array<string>"))
    return g.select("source_path", status.alias("status"), "processed_chunks", rules.alias("rules"))


def work_part(rows: DataFrame, order: str, modulo: int, remainder: int) -> DataFrame:
    """One worker's part of the rows: by a hash of the order column, so that parts are even and the same in every run."""
    if not 0 <= remainder < modulo:
        raise ValueError("remainder is below modulo")
    return rows.filter(F.pmod(F.xxhash64(order), F.lit(modulo)) == remainder)


def compare(before: DataFrame, now: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, now, outcome) of two runs of named results: same, changed, new or missing. Null equals null."""
    a, b = before.select(key, F.col(value).alias("before"), F.lit(True).alias("_a")), now.select(key, F.col(value).alias("now"), F.lit(True).alias("_b"))
    outcome = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "missing").when(F.col("before").eqNullSafe(F.col("now")), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, "before", "now", outcome.alias("outcome"))


def cache_stats(cache: DataFrame) -> DataFrame:
    """One row: entries and the sum of their hits."""
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum("hit_count"), F.lit(0)).cast("bigint").alias("hits"))


def scope_key(model: Column, generation: Column, route: Column, dataset: Column, folder: Column, alpha: Column) -> Column:
    """What a cached answer is bound to: another model, corpus, route, scope or weight is another question. Null is empty."""
    parts = (model, generation, route, dataset, folder, alpha.cast("string"))
    return F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts))


def best_per_document(hits: DataFrame, own: str, doc: str, similarity: str, k: int) -> DataFrame:
    """(own, doc, similarity): the best similarity of each other document, the k best of them."""
    g = hits.filter(F.col(own) != F.col(doc)).groupBy(own, doc).agg(F.max(similarity).alias(similarity))
    order = Window.partitionBy(own).orderBy(F.desc(similarity), doc)
    return g.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")
