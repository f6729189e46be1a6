"""The queries over the driver's tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES = ("retrieval", "analytics", "corpus", "problems")


def _each():
    for name in _MODULES:
        yield import_module(f"tesserae.queries.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _each() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _each() for k, s in m.SQL.items()}
