"""Corpus maintenance: change detection, consistency, duplicates, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import content_key, family_identity, last_part, pair_identity


def changed_files(seen: DataFrame, catalog: DataFrame) -> DataFrame:
    """(source_path, reason) of seen files (source_path, sha256) that are new, changed or half indexed."""
    c = catalog.select("source_path", content_key(F.col("sha256")).alias("_old"), "status", F.lit(True).alias("_known"))
    s = seen.select("source_path", content_key(F.col("sha256")).alias("_new"))
    reason = F.when(F.col("_known").isNull(), "new").when(F.col("status") == "reindexing", "reindexing").when(~F.col("_new").eqNullSafe(F.col("_old")), "changed")
    return s.join(c, "source_path", "left").select("source_path", reason.alias("reason")).filter("reason is not null")


def path_key(c: Column) -> Column:
    """A path for comparison: one kind of slash, small letters, no slash at the end."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[\\/]+", "/"), "/$", "")


def corpus_gap(disk: DataFrame, catalog: DataFrame) -> DataFrame:
    """Indexable paths on disk that the catalog doesn't hold; lock files and unknown formats are passed over."""
    name = last_part(F.col("source_path"))
    fit = ~name.startswith("~$") & F.lower(name).rlike(r"\.(pdf|docx|xlsx|txt|md|csv|json|py)$")
    left = disk.filter(fit).select("source_path", path_key(F.col("source_path")).alias("_k"))
    right = catalog.select(path_key(F.col("source_path")).alias("_k"))
    return left.join(right, "_k", "left_anti").select("source_path").distinct()


def consistency(files: DataFrame, parents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(kind, source_path): parents and vectors without a file, files with chunks but no vector, files half indexed."""
    f = files.select("source_path").distinct()
    p = parents.select("source_path").filter("source_path is not null").distinct()
    v = chunks.select("source_path").filter("source_path is not null").distinct()
    kind = lambda rows, k: rows.select(F.lit(k).alias("kind"), "source_path")
    return (
        kind(p.join(f, "source_path", "left_anti"), "orphan_parents").union(kind(v.join(f, "source_path", "left_anti"), "orphan_vectors"))
        .union(kind(files.filter("chunk_count > 0").select("source_path").distinct().join(v, "source_path", "left_anti"), "missing_vectors"))
        .union(kind(files.filter("status = 'reindexing'").select("source_path").distinct(), "reindexing"))
    )


def missing(files: DataFrame, have: DataFrame, key: str = "source_path") -> DataFrame:
    return files.join(have.select(key).distinct(), key, "left_anti")


def cache_split(chunks: DataFrame, cache: DataFrame, vectors: DataFrame) -> DataFrame:
    """New chunks (chunk_id, text) with the vector id they can reuse: a known text hash whose vector is still there."""
    c = chunks.select("chunk_id", F.sha2("text", 256).alias("text_hash"))
    known = cache.select("text_hash", "vector_id").dropDuplicates(["text_hash"])
    alive = vectors.select(F.col("chunk_id").alias("vector_id"), F.lit(True).alias("_alive")).dropDuplicates(["vector_id"])
    return c.join(known, "text_hash", "left").join(alive, "vector_id", "left").select("chunk_id", F.when(F.col("_alive"), F.col("vector_id")).alias("vector_id"), F.coalesce("_alive", F.lit(False)).alias("reused"))


def exact_duplicates(files: DataFrame) -> DataFrame:
    """(sha256, files, wasted) of contents that lie at several paths."""
    g = files.select("source_path", content_key(F.col("sha256")).alias("sha256")).filter("sha256 is not null").distinct().groupBy("sha256").agg(F.count("*").alias("files"))
    return g.filter("files > 1").withColumn("wasted", F.col("files") - 1)


def version_families(files: DataFrame) -> DataFrame:
    """(family, files, contents) of names that differ in copy, part or issue only."""
    g = files.select("source_path", content_key(F.col("sha256")).alias("s"), family_identity(F.col("source_path")).alias("family")).distinct()
    return g.groupBy("family").agg(F.count_distinct("source_path").alias("files"), F.count_distinct("s").alias("contents")).filter("files > 1")


def dedup_plan(files: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(pair, action, drop_path): a name with exactly one docx and one pdf loses the pdf; others are skipped.

    Where only the pdf has rules the pair is refused.
    """
    form = F.lower(F.regexp_extract("source_path", r"\.([A-Za-z]+)$", 1))
    f = files.select("source_path").distinct().withColumns({"pair": pair_identity(F.col("source_path")), "form": form})
    if rules is not None:
        f = f.join(rules.select("source_path").distinct().withColumn("_r", F.lit(1)), "source_path", "left")
    else:
        f = f.withColumn("_r", F.lit(None).cast("int"))
    g = f.groupBy("pair").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("form")).alias("forms"), F.min(F.when(F.col("form") == "pdf", F.col("source_path"))).alias("pdf"), F.max(F.when(F.col("form") == "pdf", F.col("_r"))).alias("rp"), F.max(F.when(F.col("form") == "docx", F.col("_r"))).alias("rd")).filter("n > 1")
    fit = (F.col("n") == 2) & (F.concat_ws(",", "forms") == "docx,pdf")
    action = F.when(fit & F.col("rp").isNotNull() & F.col("rd").isNull(), "refused").when(fit, "drop_pdf").otherwise("skipped")
    return g.select("pair", F.concat_ws(",", "forms").alias("formats"), action.alias("action"), F.when(action == "drop_pdf", F.col("pdf")).alias("drop_path"))


def keep_first(rows: DataFrame, same: list[str], id: str) -> DataFrame:
    """Of rows equal in some columns the one with the least id."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*same).orderBy(id))).filter("_n = 1").drop("_n")


def duplicate_stats(rows: DataFrame, same: list[str]) -> DataFrame:
    """One row: how many groups of equal rows, and how many rows are too many. Rows meet by a digest, not by their texts."""
    digest = F.sha2(F.to_json(F.struct(*same)), 256)
    g = rows.select(digest.alias("_d")).groupBy("_d").agg(F.count("*").alias("n")).filter("n > 1")
    return g.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows"))


def replace_document(base: DataFrame, new: DataFrame, doc: str, key: str = "chunk_id") -> DataFrame:
    """The base with a document's rows replaced by new ones; no new rows delete it.

    New rows of another document or with repeated keys are an error.
    """
    bad = new.agg(F.count(F.when(~F.col("doc_id").eqNullSafe(F.lit(doc)), 1)).alias("foreign"), (F.count("*") - F.count_distinct(key)).alias("twice")).first()
    if bad["foreign"] or bad["twice"]:
        raise ValueError(f"{bad['foreign']} rows of another document, {bad['twice']} repeated keys")
    return base.filter(~F.col("doc_id").eqNullSafe(F.lit(doc))).unionByName(new)


def upsert(base: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Insert or replace by key."""
    return base.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def delete_files(tables: dict[str, DataFrame], paths: DataFrame, keep: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Every table without the rows of the paths, but for those kept."""
    p = paths.select("source_path").distinct()
    return {name: t if name in keep else t.join(p, "source_path", "left_anti") for name, t in tables.items()}


def search_rules(rules: DataFrame, query: str = "", subject: str = "", parameter: str = "", limit: int = 20) -> DataFrame:
    """Rules whose text, subject or parameter hold the query, and whose subject and parameter hold theirs; by id."""
    has = lambda c, s: F.lower(F.coalesce(F.col(c), F.lit(""))).contains(s.lower())
    cond = has("rule_text", query) | has("subject", query) | has("parameter", query)
    return rules.filter(cond & has("subject", subject) & has("parameter", parameter)).orderBy("id").limit(max(1, min(100, limit)))


def summary(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"))


def drift(stored: DataFrame, fresh: DataFrame, cosine: Column) -> DataFrame:
    """(n, least, median, verdict) of cosines of stored vectors to fresh ones: PASS from .998 and .999, WARN from .99.

    The median is of cosines with six decimals, so that what is counted for it has at most two million values.
    """
    j = stored.join(fresh, "chunk_id").withColumn("c", cosine).filter("c is not null")
    a = j.agg(F.count("*").alias("n"), F.min("c").alias("least"), F.expr("percentile(round(c, 6), 0.5)").alias("median"))
    return a.withColumn("verdict", F.when(F.col("n") == 0, "EMPTY").when((F.col("least") >= 0.998) & (F.col("median") >= 0.999), "PASS").when(F.col("least") >= 0.99, "WARN").otherwise("FAIL"))
