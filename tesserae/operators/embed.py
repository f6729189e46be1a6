"""Embedding providers and their contract. The default one is local and deterministic."""

from __future__ import annotations

import zlib
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Provider(ABC):
    """Turns texts into vectors. One that sends content elsewhere must be allowed by its caller."""

    name: str
    dimension: int
    external = False

    @abstractmethod
    def embed(self, texts: list[str]) -> np.ndarray: ...

    def query(self, text: str) -> list[float]:
        return self.embed([self.instruct(text)])[0].tolist()

    def instruct(self, text: str) -> str:
        """A question in the form the model wants it."""
        return f"query: {text}" if "e5" in self.name.lower() else text


class Hashing(Provider):
    """Words hashed to signed places, to unit length: texts that share words are close."""

    name = "hashing"

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % self.dimension] += 1 if h >> 31 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)


def normal_name(name: str) -> str:
    """A model's name without its maker, container and quantisation marks."""
    import re

    n = re.split(r"[/\\]", (name or "").lower())[-1]
    return re.sub(r"[^a-z0-9]+", "-", re.sub(r"(\.gguf|:latest|[-_.]q\d\w*|[-_.](?:fp?16|bf16|f32))", "", n)).strip("-")


def compatible(stored: str, served: str) -> bool:
    a, b = normal_name(stored), normal_name(served)
    return bool(a and b) and (a == b or a in b or b in a)


def contract(provider: Provider, manifest: dict) -> str | None:
    """Why an index must not be searched with a provider; None if it may."""
    if not compatible(manifest.get("model", ""), provider.name):
        return f"model {provider.name} is not {manifest.get('model')}"
    if manifest.get("dimension") != provider.dimension:
        return f"dimension {provider.dimension} is not {manifest.get('dimension')}"
    return None


def embed(chunks: DataFrame, provider: Provider, text: str = "text", allow_external: bool = False, batch: int = 32) -> DataFrame:
    """chunks with their vector, in batches."""
    if provider.external and not allow_external:
        raise PermissionError("this provider sends content elsewhere")
    names = chunks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(names.index(text)).to_pylist()
            v = [provider.embed(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            flat = np.concatenate(v).astype(np.float32) if v else np.zeros((0, provider.dimension), np.float32)
            yield pa.record_batch([*b.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * provider.dimension, pa.int32()), pa.array(flat.ravel()))], [*names, "vector"])

    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    return chunks.mapInArrow(run, StructType([*chunks.schema.fields, StructField("vector", ArrayType(FloatType()))]))


def reuse(chunks: DataFrame, split: DataFrame, vectors: DataFrame, provider: Provider) -> DataFrame:
    """chunks with vectors: known ones by join, the others embedded."""
    c = chunks.join(split, "chunk_id")
    old = c.filter("reused").join(vectors.select(F.col("chunk_id").alias("vector_id"), "vector"), "vector_id")
    new = embed(c.filter("not reused").select(*chunks.columns), provider)
    return old.select(*chunks.columns, "vector").unionByName(new)
