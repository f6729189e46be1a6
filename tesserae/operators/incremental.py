"""Problem 2: processing only new or changed records.

Sightings of files arrive run by run in a versioned table, a version for each run. Each successful
run processes the difference of two manifests: from the version that its last committed output
names to its own. What a path holds and what each run put out are partitions of a second versioned
table; its commit adds the new rows, lays a deletion vector over the superseded ones and names the
processed version, all in one manifest. A run that dies before that commit therefore leaves nothing
behind, and the next one takes its records too, once. A run reads the new sightings and the
partitions of the state that their paths fall in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from tesserae.functions.text import content_key, instant
from tesserae.session import fresh_path
from tesserae.sources.versions import VersionedTable

SIGHTING = StructType([StructField("scan_id", LongType()), StructField("run_id", LongType()), StructField("source_path", StringType()), StructField("sha256", StringType()), StructField("scanned_at", TimestampType())])
STATE = StructType([StructField("source_path", StringType()), StructField("scanned_at", TimestampType()), StructField("scan_id", LongType()), StructField("held", StringType()), StructField("run_id", LongType())])
#: Paths that a partition of the state should hold, and versions after which it is compacted.
PART, COMPACT = 200_000, 12


def current_files(files: DataFrame) -> DataFrame:
    """The current row of each source_path: the one indexed last, as an instant; a null time is the oldest.

    Of rows with the same instant the greatest in all columns counts, so the choice is the same in
    every run. Rows without a path are no files.
    """
    rest = [c for c in files.columns if c != "source_path"]
    top = F.max(F.struct(instant(F.col("indexed_at")).alias("_at"), *rest)).alias("_r")
    return files.filter("source_path is not null").groupBy("source_path").agg(top).select("source_path", *(F.col(f"_r.{c}").alias(c) for c in rest))


def held_at_first(files: DataFrame) -> DataFrame:
    """(source_path, held): the content of the current rows whose status is indexed."""
    key = content_key(F.col("sha256"))
    return current_files(files).filter((F.col("status") == "indexed") & key.isNotNull()).select("source_path", key.alias("held"))


def usable(scans: DataFrame) -> DataFrame:
    """Sightings that tell a content: a path, a run and a non-empty sha256 (its first 16 digits, lower case)."""
    return scans.select("scan_id", "run_id", "source_path", content_key(F.col("sha256")).alias("sha256"), "scanned_at").filter("sha256 is not null and source_path is not null and run_id is not null")


def ingest(scans: DataFrame, runs: DataFrame, path: str | None = None) -> tuple[VersionedTable, dict[int, int], list[int]]:
    """Write the feed as a versioned table; the version of each run, and the successful runs in order.

    A run's sightings are read by the first successful run from it on; that is its version. An existing
    feed gains the sightings of later runs only. Runs come from the table of runs (a fixed table).
    """
    spark = scans.sparkSession
    good = sorted(r[0] for r in runs.filter("run_status = 'success' and run_id is not null").select("run_id").distinct().collect())
    table = VersionedTable(spark, path or fresh_path(spark, "sightings"), SIGHTING)
    known = {table.manifest(v)["properties"]["run_id"]: v for v in range(1, table.version() + 1)}
    have = max(known, default=None)
    steps = [r for r in good if have is None or r > have]
    if not steps:
        return table, known, good
    feed = usable(scans).filter(F.col("run_id") <= steps[-1])
    feed = feed if have is None else feed.filter(F.col("run_id") > have)
    return table, known | table.append_each(feed.withColumn("run_id", _next_of(steps)), "run_id", steps), good


def _next_of(runs: list[int]) -> Column:
    """The first of runs that is not before run_id."""
    return F.array_min(F.filter(F.array(*(F.lit(r).cast("bigint") for r in runs)), lambda r: r >= F.col("run_id")))


class Consumer:
    """Processes a feed run by run; state, outputs and progress are one versioned table."""

    def __init__(self, spark: SparkSession, feed: VersionedTable, held: DataFrame, path: str | None = None) -> None:
        self.spark, self.feed = spark, feed
        self.state = VersionedTable(spark, path or fresh_path(spark, "held"), STATE)
        if not self.state.version():
            none = {"scanned_at": F.lit(None).cast("timestamp"), "scan_id": F.lit(None).cast("bigint"), "run_id": F.lit(0).cast("bigint"), "_file": F.lit(None).cast("string"), "_row": F.lit(None).cast("bigint")}
            self.parts = max(1, held.count() // PART)
            self.state.append_parts(held.select("source_path", "held").withColumns(none), self._part(), 0, {"processed": 0, "parts": self.parts})
        self.parts = self.state.properties()["parts"]

    def _part(self) -> Column:
        return F.concat(F.lit("held-"), F.pmod(F.xxhash64("source_path"), F.lit(self.parts)).cast("string"))

    def processed(self) -> int:
        return self.state.properties().get("processed", 0)

    def step(self, run_id: int, upto: int, crash: str | None = None) -> int:
        """Process what the feed gained since the last commit, in one commit; the state's version.

        crash is for tests: where to die, after the "delta" or the "data" was written.
        """
        last, after = self.processed(), self.state.version()
        if upto <= last:
            return after
        new = self.feed.changes(last, upto).filter("_change = 'insert'")
        # folded before the shuffle: a path's last sighting is all that counts
        new = new.groupBy("source_path").agg(F.max(F.struct("scanned_at", "scan_id", F.col("sha256").alias("held"))).alias("n"))
        delta = self._staged(new.withColumn("_part", self._part()))
        if crash == "delta":
            raise RuntimeError("died before the data")
        touched = [r[0] for r in delta.select("_part").distinct().collect()]
        old = self.state._present(after, touched).select("source_path", F.struct("scanned_at", "scan_id", "held").alias("o"), "_file", "_row")
        both = delta.join(old, "source_path", "left")
        # what was held at first has no sighting; any sighting is later
        both = both.filter(F.col("o.scan_id").isNull() | (F.col("n") > F.col("o")))
        changed = ~F.col("n.held").eqNullSafe(F.col("o.held"))
        out = F.struct(F.lit("out").alias("part"), F.lit(None).cast("string").alias("_file"), F.lit(None).cast("bigint").alias("_row"))
        keep = F.struct(F.col("_part").alias("part"), F.col("_file"), F.col("_row"))
        each = both.select("source_path", "n.*", F.explode(F.when(changed, F.array(keep, out)).otherwise(F.array(keep))).alias("x"))
        rows = each.select("source_path", "scanned_at", "scan_id", "held", F.lit(run_id).cast("bigint").alias("run_id"), "x._file", "x._row", "x.part")
        data = self.state.write_parts(rows, F.col("part"))
        if crash == "data":
            raise RuntimeError("died before the commit")
        version = self.state.commit(after, self.state._files(data), vectors=[data], properties={"processed": upto, "run_id": run_id, "parts": self.parts})
        return self.state.compact() if version % COMPACT == 0 else version

    def outputs(self) -> DataFrame:
        """(run_id, source_path) of every new or changed path of the runs so far."""
        return self.state._present(self.state.version(), ["out"]).select("run_id", "source_path")

    def _staged(self, rows: DataFrame) -> DataFrame:
        at = fresh_path(self.spark, "stage")
        rows.write.parquet(at)
        return self.spark.read.parquet(at)


def process(scans: DataFrame, runs: DataFrame, files: DataFrame) -> DataFrame:
    """(run_id, source_path) of the paths that are new or changed at each successful run, each run processed on its own."""
    feed, version_of, good = ingest(scans, runs)
    consumer = Consumer(scans.sparkSession, feed, held_at_first(files))
    for run in good:
        consumer.step(run, version_of[run])
    return consumer.outputs()
