"""Extraction: labelled values from lines, and quotes back to their pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.session import checkpoint

#: The form of a record's name, and of a number with its unit.
RECORD = r"(?<!\w)[А-ЯA-Z]{1,3}\d?-[А-ЯA-Z0-9]{2,}-\d{2}-\d{2}(?:\s*\([^)]{1,40}\))?(?!\w)"
VALUE = r"(?P<value>-?\d+(?:[,.]\d+)?)\s*(?P<unit>кПа|Па|м3/ч|м³/ч|м/с|кВт|Вт|мм|м|кг|%)?(?!\w)"
LOOK_AHEAD = 3
#: Most hashes of three words that are sent to every executor; more are joined by a shuffle, with the same result.
KEYS = 4_000_000


def labelled_values(docs: DataFrame, key: str, text: str, labels: list[str]) -> DataFrame:
    """(key, record, label, value, unit, confidence, evidence, line_no) of labels with a number.

    A label belongs to the last record named at or above it. Its number stands on its own line or on
    one of the next three, not beyond another label or record. Lines stay with their text: no shuffle.
    """
    record, value = re.compile(RECORD, re.I), re.compile(VALUE, re.I)
    low = [(x, x.lower()) for x in labels]

    def label_of(line: str) -> str | None:
        return next((x for x, y in low if y in line.lower()), None)

    def read(t: str) -> Iterator[tuple]:
        lines = [" ".join(x.split()) for x in re.split(r"\r\n|\n|\r", t)]
        now = ""
        for i, line in enumerate(lines):
            if not line:
                continue
            named = record.search(line)
            now = named[0] if named else now
            label = label_of(line)
            if not label or not now:
                continue
            said = value.search(line)
            if said and not named:
                yield now, label, float(said["value"].replace(",", ".")), said["unit"] or "", 0.82, line, i + 1
                continue
            seen = [line]
            for j in range(i + 1, min(i + 1 + LOOK_AHEAD, len(lines))):
                x = lines[j]
                if not x:
                    continue
                if record.search(x) or label_of(x):
                    break
                seen.append(x)
                if said := value.search(x):
                    yield now, label, float(said["value"].replace(",", ".")), said["unit"] or "", 0.88 if said["unit"] else 0.72, " | ".join(seen), j + 1
                    break

    names = [key, "record", "label", "value", "unit", "confidence", "evidence", "line_no"]
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for n, t in enumerate(b.column(1).to_pylist()):
                if t:
                    got = list(read(t))
                    rows += got
                    at += [n] * len(got)
            cols = list(zip(*rows)) if rows else [()] * 7
            types = (pa.string(), pa.string(), pa.float64(), pa.string(), pa.float64(), pa.string(), pa.int32())
            yield pa.record_batch([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), t) for c, t in zip(cols, types))], names)

    has = F.lit(False)
    for _, y in low:
        has = has | F.lower(text).contains(y)
    return docs.filter(has).select(key, text).mapInArrow(run, f"`{key}` {kind}, record string, label string, value double, unit string, confidence double, evidence string, line_no int")


def probes(text: str) -> list[str]:
    """What to look for in a page: twelve, eight and five words of a quote behind its first three."""
    words = text.split()
    out = []
    for n in (12, 8, 5):
        if len(words) >= n:
            at = min(3, len(words) - n)
            out.append(" ".join(words[at : at + n]).lower())
    return list(dict.fromkeys(out))


def locate(pages: DataFrame, quotes: list[tuple[int, str]], key: str, text: str, most: int = 3) -> DataFrame:
    """(quote_id, key, probe_words, place): the first pages that hold the longest probe of a quote which any page holds.

    quotes are a request's few; the pages are read once for all of them.
    """
    plain = F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))
    asked = [(q, n, p) for q, t in quotes for n, p in enumerate(probes(t))]
    hits = F.array_compact(F.array(*(F.when(F.contains(F.col("_t"), F.lit(p)), F.struct(F.lit(q).cast("bigint").alias("quote_id"), F.lit(n).alias("probe_no"), F.lit(len(p.split())).alias("probe_words"))) for q, n, p in asked)))
    h = pages.select(key, plain.alias("_t")).select(key, F.explode(hits).alias("h")).select(key, "h.*")
    best = Window.partitionBy("quote_id")
    h = h.withColumn("_b", F.min("probe_no").over(best)).filter("probe_no = _b")
    return h.withColumn("place", F.row_number().over(best.orderBy(key))).filter(F.col("place") <= most).select("quote_id", key, "probe_words", "place")


def locate_all(pages: DataFrame, quotes: DataFrame, key: str, text: str, quote: str, most: int = 3) -> DataFrame:
    """(quote, key, probe_words, place) as of ``locate``, for a table of quotes of any size: (quote, text).

    A page that holds a probe holds its second to fourth word as whole words, so pages and probes
    meet in a join on the hash of three words; the probe itself decides. Equal probes are looked for once.
    """
    plain = F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))
    hashed = lambda w, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    w = F.col("_w")
    q = quotes.select(F.col(quote).alias("_q"), F.filter(F.split(plain, " "), lambda x: x != "").alias("_w")).filter(F.size("_w") >= 5)
    at = lambda n: F.least(F.lit(3), F.size(w) - n)
    asked = [F.when(F.size(w) >= n, F.struct(F.lit(n).alias("probe_words"), F.array_join(F.slice(w, at(n) + 1, F.lit(n)), " ").alias("_p"), hashed(w, at(n) + 1).alias("_h"))) for n in (12, 8, 5)]
    q = checkpoint(q.select("_q", F.explode(F.array_compact(F.array(*asked))).alias("a")).select("_q", "a.*"))
    keys = q.select("_h").distinct()
    keys = F.broadcast(keys) if q.count() <= KEYS else keys
    words = pages.filter(F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.split(plain, " ").alias("_w")).filter(F.size("_w") >= 5)
    runs = words.select("_k", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: hashed(w, i)))).alias("_h"))
    # a page without a probe's first five words holds none of the longer probes that begin with them
    starts = q.select("_h", "_p", F.array_join(F.slice(F.split("_p", " "), 1, 5), " ").alias("_f")).groupBy("_h", "_f").agg(F.collect_set("_p").alias("_ps"))
    met = runs.join(keys, "_h", "left_semi").join(starts, "_h").drop("_h")
    texts = pages.filter(F.col(text).isNotNull()).select(F.col(key).alias("_k2"), plain.alias("_t"))
    held = met.join(texts, F.col("_k") == F.col("_k2")).filter(F.contains("_t", "_f"))
    held = held.select("_k", "_t", F.explode("_ps").alias("_p2")).filter(F.contains("_t", "_p2")).select("_k", "_p2").distinct()
    hits = q.join(held, F.col("_p") == F.col("_p2")).select("_q", "_k", "probe_words").distinct()
    best = Window.partitionBy("_q").orderBy(F.desc("probe_words"))
    hits = hits.withColumn("_b", F.dense_rank().over(best)).filter("_b = 1")
    place = F.row_number().over(Window.partitionBy("_q").orderBy("_k"))
    return hits.withColumn("place", place).filter(F.col("place") <= most).select(F.col("_q").alias("quote_id"), F.col("_k").alias(key), "probe_words", "place")
