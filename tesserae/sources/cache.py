"""Parsed table rows kept beside their files: read by fingerprint, parsed only where missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tesserae.operators import tables
from tesserae.sources import files as readers
from tesserae.sources.versions import VersionedTable

#: Raised when rows are read differently, so that rows of an older reader don't count.
READER = 1
ROWS = "source_path string, fingerprint string, table_no int, line_no int, raw_row map<string,string>, " + ", ".join(f"{f} string" for f in tables.TEXTS) + ", " + ", ".join(f"{f} double" for f in tables.NUMBERS)


def fingerprint(scan: DataFrame) -> DataFrame:
    """(path, fingerprint) of a binary scan, from size and time only: no content is read."""
    f = F.concat_ws("-", F.lit(READER), F.col("length"), F.unix_micros("modificationTime"))
    return scan.select("path", f.alias("fingerprint"))


class TableCache:
    """Typed rows of the tables in files, one version for each fill.

    A file whose fingerprint is held is never opened. A file without tables leaves a row without
    cells, so that it isn't opened again. Files too large to parse in line are told, not parsed.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.table = spark, VersionedTable(spark, path, StructType.fromDDL(ROWS))

    def missing(self, scan: DataFrame) -> DataFrame:
        """(path, fingerprint) of files whose rows are not held."""
        have = self.table.read().select(F.col("source_path").alias("path"), "fingerprint").distinct()
        return fingerprint(scan).join(have, ["path", "fingerprint"], "left_anti")

    def fill(self, scan: DataFrame) -> int:
        """Parse what is missing (a backfill, or a first read); the version. Nothing missing makes none."""
        small = scan.filter(F.col("length") <= readers.LARGE)
        todo = self.missing(small)
        if todo.isEmpty():
            return self.table.version()
        files = small.join(todo.select("path"), "path", "left_semi")
        rows = tables.parse_grids(readers.grids(files), ["source_path", "table_no"])
        every = todo.select(F.col("path").alias("source_path"), "fingerprint").join(rows, "source_path", "left")
        return self.table.replace(self.table.version(), todo.select(F.col("path").alias("source_path")), "source_path", every)

    def rows(self, scan: DataFrame) -> DataFrame:
        """The rows of the files of a scan, from the cache, after what is missing was parsed."""
        self.fill(scan)
        now = fingerprint(scan).withColumnRenamed("path", "source_path")
        return self.table.read().join(now, ["source_path", "fingerprint"], "left_semi").filter("line_no is not null")

    def too_large(self, scan: DataFrame) -> DataFrame:
        return scan.filter(F.col("length") > readers.LARGE).select("path")
