"""Problem 8: encoding a whole corpus with a public byte-level tokenizer.

The words before the merges are counted over all documents; the most frequent ones, up to
``lexicon_size``, are compiled with their ids into a minimal acyclic transducer (lexicon.py).
Workers map its file into memory and look up the distinct words of a batch together; words that
it doesn't hold are merged exactly with the tokenizer's ranks. Texts are never cut.

Null and empty texts have the defined ids ``[]``; blank texts have the ids of their blanks.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import lexicon
from tesserae.llm.frequent import most_frequent
from tesserae.llm.spans import chunks, pretokens
from tesserae.session import checkpoint, fresh_path, local_file, write_bytes

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bound of the lexicon that the driver compiles; other words are merged on the workers.
LEXICON_SIZE = 40_000
_MEMO = 300_000


#: The tokenizer's pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def ranks_encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): how often each word occurs in all texts; summed before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Counts()
        for b in batches:
            for part in chunks(b.column(0)):
                seen.add(part.to_pylist())
                if len(seen.words) > _MEMO:
                    yield seen.flush()
        yield seen.flush()

    return docs.select(F.col(text).cast("string")).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class _Counts:
    def __init__(self) -> None:
        self.words: list[str] = []
        self.index, self.n = pd.Index([], dtype=np.uint64), np.zeros(0, np.int64)

    def add(self, texts: list[str | None]) -> None:
        joined, start, end, key, _ = pretokens(texts)
        code, unique = pd.factorize(key)
        n = np.bincount(code, minlength=len(unique))
        at = self.index.get_indexer(unique)
        np.add.at(self.n, at[at >= 0], n[at >= 0])
        if len(new := np.flatnonzero(at < 0)):
            place = np.zeros(len(unique), np.int64)
            place[code[::-1]] = np.arange(len(code))[::-1]
            self.words += [joined[start[p] : end[p]] for p in place[new].tolist()]
            self.index = self.index.append(pd.Index(unique[new]))
            self.n = np.concatenate([self.n, n[new]])

    def flush(self) -> pa.RecordBatch:
        word, n = self.words, self.n
        self.__init__()
        return pa.record_batch([pa.array([w.encode("utf-8", "replace") for w in word], pa.binary()), pa.array(n, pa.int64())], ["word", "n"])


def compile_lexicon(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, size: int = LEXICON_SIZE) -> str:
    """Write the transducer of the corpus's frequent words to the shared folder; its path."""
    spark = docs.sparkSession
    top = most_frequent(checkpoint(word_counts(docs, text).filter("n > 1")), "n", size)
    enc = ranks_encoding(tokenizer)
    path = fresh_path(spark, "lexicon")
    write_bytes(spark, path, lexicon.build({bytes(r[0]): enc._encode_single_piece(bytes(r[0])) for r in top}))
    # the ranks travel with the job; executors need no tokenizer of their own
    spark.sparkContext.addFile(tokenizer)
    if local_file(path) is None:
        spark.sparkContext.addFile(path)
    return path


class Encoder:
    """Encodes texts in chunks; each distinct word is resolved once for a worker's memory."""

    def __init__(self, path: str, tokenizer: str) -> None:
        self.map = lexicon.Transducer(local_file(path) or SparkFiles.get(path.rsplit("/", 1)[-1]))
        self.exact = ranks_encoding(SparkFiles.get(os.path.basename(tokenizer)))
        self.reset()

    def reset(self) -> None:
        self.index = pd.Index([], dtype=np.uint64)
        self.at, self.len, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _resolve(self, words: list[str]) -> list[np.ndarray]:
        raw = [w.encode("utf-8", "replace") for w in words]
        return [self.map.ids_of(i) if i >= 0 else np.array(self.exact._encode_single_piece(w), np.int32) for i, w in zip(self.map.numbers(raw).tolist(), raw)]

    def slots(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The slot of every word of the texts, and the bounds of each text's words."""
        if len(self.index) > _MEMO:
            self.reset()
        joined, start, end, key, bounds = pretokens(texts)
        code, unique = pd.factorize(key)
        at = self.index.get_indexer(unique)
        if len(new := np.flatnonzero(at < 0)):
            place = np.zeros(len(unique), np.int64)
            place[code[::-1]] = np.arange(len(code))[::-1]
            parts = self._resolve([joined[start[p] : end[p]] for p in place[new].tolist()])
            lens = np.fromiter(map(len, parts), np.int64, len(parts))
            at[new] = np.arange(len(self.index), len(self.index) + len(new))
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(lens) - lens])
            self.len = np.concatenate([self.len, lens])
            self.flat = np.concatenate([self.flat, *parts])
            self.index = self.index.append(pd.Index(unique[new]))
        return at[code], bounds

    def encode(self, texts: list[str | None]) -> pa.Array:
        slots, bounds = self.slots(texts)
        lens = self.len[slots]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.repeat(self.at[slots] - (ends - lens), lens) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[bounds]
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))

    def count(self, texts: list[str | None]) -> np.ndarray:
        slots, bounds = self.slots(texts)
        return np.diff(np.concatenate([[0], np.cumsum(self.len[slots])])[bounds])


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, size: int = LEXICON_SIZE) -> DataFrame:
    """(key, ids): the token ids of every text, without special tokens.

    Null and empty texts give ``[]``. Every row gives one row; other columns are ignored, so
    clashing names do no harm.
    """
    path = compile_lexicon(docs, text, tokenizer, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path, tokenizer)
        for b in batches:
            start = 0
            for part in chunks(b.column(1)):
                yield pa.record_batch([b.column(0).slice(start, len(part)), enc.encode(part.to_pylist())], [key, "ids"])
                start += len(part)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", tokenizer: str = TOKENIZER, size: int = LEXICON_SIZE) -> DataFrame:
    """The columns of keep and n_tokens, 0 for null and empty texts."""
    path = compile_lexicon(docs, text, tokenizer, size)
    src = docs.select(*keep, F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path, tokenizer)
        for b in batches:
            n = [enc.count(part.to_pylist()) for part in chunks(b.column(len(keep)))]
            yield pa.record_batch([*b.columns[: len(keep)], pa.array(np.concatenate(n) if n else [], pa.int64())], [*keep, "n_tokens"])

    from pyspark.sql.types import LongType, StructField, StructType

    return src.mapInArrow(run, StructType([*(src.schema[c] for c in keep), StructField("n_tokens", LongType())]))
