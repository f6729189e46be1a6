"""Lexical search: postings, BM25 and sparse vectors."""

from __future__ import annotations

import functools
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import LEXICAL_ENDINGS, STOP_WORDS, lexical_stem, lexical_terms, lexical_words, term_id, tokens
from tesserae.session import checkpoint, fresh_path, read_bytes, write_bytes

K1, B = 1.2, 0.75
#: Partitions that postings are written in by their term.
BUCKETS = 64

_PLAIN = re.compile("[0-9a-zа-яё]+")
_LEXICAL = re.compile("[0-9a-zа-я]+(?:[.-][0-9a-zа-я]+)*")
_RUSSIAN = re.compile("[а-яё]{4,}")


@functools.lru_cache(500_000)
def stem_of(word: str) -> str:
    """``functions.text.lexical_stem`` of one word without digits."""
    if _RUSSIAN.fullmatch(word):
        for e in LEXICAL_ENDINGS:
            if word.endswith(e) and len(word) - len(e) >= 4:
                return word[: len(word) - len(e)]
    return word


def terms_of(text: str, stemmed: bool = True) -> list[str]:
    """``lexical_terms`` (or, unstemmed, ``tokens``) of one text."""
    if not stemmed:
        return [t for t in _PLAIN.findall(text.lower()) if len(t) >= 2 and t not in STOP_WORDS]
    words = (t for t in _LEXICAL.findall(text.lower().replace("ё", "е")) if len(t) >= 3 and t not in STOP_WORDS)
    return [t if any(c in "0123456789" for c in t) else stem_of(t) for t in words]


class LexicalIndex:
    """Written postings (term, key, tf, length) in partitions by term, with the corpus's counts beside them.

    A question reads the partitions and rows of its own terms only. Texts without a term are in no
    count; null texts have none. A text's key is one row: of repeated keys every row is a text.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.about = json.loads(read_bytes(spark, f"{path}/about.json"))

    @classmethod
    def build(cls, docs: DataFrame, key: str, text: str, path: str | None = None, stemmed: bool = True) -> LexicalIndex:
        """One pass over the texts: words are cut, stemmed and counted in Arrow batches."""
        spark = docs.sparkSession
        path = path or fresh_path(spark, "postings")
        kind = docs.schema[key].dataType.simpleString()

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, term, tf, length = [], [], [], []
                for row, t in enumerate(b.column(1).to_pylist()):
                    words = Counter(terms_of(t, stemmed))
                    n = sum(words.values())
                    if n:
                        at += [row] * (len(words) + 1)
                        # the text itself, for the counts
                        term += ["", *words]
                        tf += [n, *words.values()]
                        length += [n] * (len(words) + 1)
                yield pa.record_batch([b.column(0).take(pa.array(at, pa.int64())), pa.array(term, pa.string()), pa.array(tf, pa.int64()), pa.array(length, pa.int64())], ["key", "term", "tf", "length"])

        rows = docs.filter(F.col(text).isNotNull()).select(F.col(key), F.col(text)).mapInArrow(count, f"key {kind}, term string, tf bigint, length bigint")
        bucket = F.when(F.col("term") == "", F.lit(-1)).otherwise(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        # a frequent term is spread over several files of its partition
        rows.withColumn("bucket", bucket).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
        written = spark.read.parquet(f"{path}/postings").filter("bucket = -1").agg(F.count("*").alias("n"), F.sum("length").alias("l")).first()
        write_bytes(spark, f"{path}/about.json", json.dumps({"texts": written["n"], "length": (written["l"] or 0) / max(1, written["n"]), "stemmed": stemmed, "key": key}).encode())
        return cls(spark, path)

    def search(self, query: str) -> DataFrame:
        """(key, bm25) of the texts that hold a term of the query; one without a term finds nothing."""
        words = list(dict.fromkeys(terms_of(query, self.about["stemmed"])))
        p = self.spark.read.parquet(f"{self.path}/postings")
        if words:
            # the same hash as the writer's
            buckets = [r[0] for r in self.spark.createDataFrame([(w,) for w in words], "term string").select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).distinct().collect()]
            p = p.filter(F.col("bucket").isin(buckets) & F.col("term").isin(words))
        else:
            p = p.filter("false")
        # a row for each term of the question
        df = {r["term"]: r["n"] for r in p.groupBy("term").agg(F.count("*").alias("n")).collect()} if words else {}
        n, mean = float(self.about["texts"]), self.about["length"] or 1.0
        idf = F.create_map(*(F.lit(x) for t, k in sorted(df.items()) for x in (t, k))) if df else F.create_map(F.lit(""), F.lit(0))
        k = F.coalesce(F.try_element_at(idf, F.col("term")), F.lit(0)).cast("double")
        weight = F.log(1 + (F.lit(n) - k + 0.5) / (k + 0.5))
        f = F.col("tf")
        part = weight * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / mean))
        return p.groupBy(F.col("key").alias(self.about["key"])).agg(F.sum(part).alias("bm25"))

    def vectors(self) -> DataFrame:
        """(key, term, tf): the sparse vector of every text."""
        return self.spark.read.parquet(f"{self.path}/postings").filter("bucket >= 0").select(F.col("key").alias(self.about["key"]), "term", "tf")


def postings(docs: DataFrame, key: str, text: str, terms=tokens) -> DataFrame:
    """(key, term, tf, length) of every text; a row per distinct term. To be written bucketed by term where many queries follow."""
    d = docs.select(key, terms(F.col(text)).alias("_t")).filter("size(_t) > 0")
    return d.select(key, F.size("_t").cast("bigint").alias("length"), F.explode("_t").alias("term")).groupBy(key, "term", "length").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, key: str, text: str, query: list[str], terms=tokens, same=lambda x, w: x == F.lit(w)) -> DataFrame:
    """(key, bm25) of the texts that hold a query term, in one pass over the texts without a shuffle of them.

    Counts of documents and the mean length are over all texts that have a term at all; they are one
    row. idf = ln(1 + (N - df + 0.5) / (df + 0.5)). same(term, query word) tells which terms are a query word.
    """
    query = list(dict.fromkeys(query))
    is_ = lambda w: lambda x: same(x, w)
    tf = [F.size(F.filter("_t", is_(w))).cast("bigint").alias(f"_f{i}") for i, w in enumerate(query)]
    d = checkpoint(docs.select(key, terms(F.col(text)).alias("_t")).filter("size(_t) > 0").select(key, F.size("_t").cast("bigint").alias("_len"), *tf))
    stats = d.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *(F.sum((F.col(f"_f{i}") > 0).cast("bigint")).alias(f"_d{i}") for i in range(len(query)))).first()
    n, mean = stats["_n"], stats["_avg"] or 1.0
    total: Column = F.lit(0.0)
    for i in range(len(query)):
        df = stats[f"_d{i}"] or 0
        idf = F.log(1 + (F.lit(float(n)) - df + 0.5) / (F.lit(float(df)) + 0.5))
        f = F.col(f"_f{i}")
        total = total + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_len") / mean))
    return d.select(key, total.alias("bm25")).filter("bm25 > 0")


def bm25_stemmed(docs: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """(key, bm25) over stemmed terms of texts and query: inflected words are one term.

    A word has a stem only if it begins with it, so few words of a text are stemmed. A query without a term finds nothing.
    """
    terms = docs.sparkSession.range(1).select(lexical_terms(F.lit(query)).alias("t")).first()["t"]
    return bm25(docs, key, text, terms, lexical_words, lambda x, w: x.startswith(F.lit(w)) & (lexical_stem(x) == F.lit(w)))


def sparse_terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): the sparse vector of each text over stemmed terms."""
    d = docs.select(key, F.explode(lexical_terms(F.col(text))).alias("term"))
    return d.groupBy(key, "term").agg(F.count("*").alias("tf"))


def sparse_vector(c: Column) -> Column:
    """The sparse vector of a text as a map of term number to frequency."""
    ids = F.transform(lexical_terms(c), term_id)
    distinct = F.array_distinct(ids)
    return F.map_from_arrays(distinct, F.transform(distinct, lambda i: F.size(F.filter(ids, lambda x: x == i)).cast("double")))
