"""Sinks: delimited files, reports, dumps and copies of tables with verified counts."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from tesserae.sources.versions import VersionedTable


def write_csv(rows: DataFrame, path: str, sep: str = ";") -> None:
    rows.write.mode("overwrite").option("sep", sep).option("header", "true").csv(path)


def markdown(rows: Iterable, columns: list[str], title: str) -> str:
    """A report of a bounded result."""
    cell = lambda x: str("" if x is None else x).replace("|", "\\|").replace("\n", " ")
    body = [f"| {' | '.join(cell(r[c]) for c in columns)} |" for r in rows]
    return "\n".join([f"# {title}", "", f"| {' | '.join(columns)} |", f"|{'---|' * len(columns)}", *body, "", f"Rows: {len(body)}"])


def backup(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Copies of tables; each is counted again after the write, a difference is an error."""
    out = {}
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")
        out[name] = spark.read.parquet(f"{path}/{name}").count()
        if out[name] != t.count():
            raise RuntimeError(f"{name}: the copy has {out[name]} rows")
    return out


def restore(spark: SparkSession, path: str, name: str, into: VersionedTable) -> int:
    """A copy as a new version of a table: its rows replace the present ones in one commit."""
    live, _ = into._state(into.version())
    at = f"{into.path}/data/restore-{into.version() + 1}"
    spark.read.parquet(f"{path}/{name}").select(*into.schema.names).write.mode("overwrite").parquet(at)
    return into.commit(into.version(), into._files(at), removed=live, properties={"restored": path})


def restore_rules(dump: DataFrame, files: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules of a dump whose file still has the same content and has no rules now."""
    keep = dump.join(files.select("source_path", "sha256").distinct(), ["source_path", "sha256"])
    return keep.join(rules.select("source_path").distinct(), "source_path", "left_anti")


def manifest(model: str, dimension: int, chunker: dict) -> bytes:
    """What an index was built with; to be compared before it is searched."""
    return json.dumps({"model": model, "dimension": dimension, "chunker": chunker}, sort_keys=True, ensure_ascii=False).encode()
