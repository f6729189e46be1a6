"""Streams of file events: coalescing, priorities and windows by event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Formats whose parsing waits for the bulk run; anything larger waits too.
DEFERRED = ("dwg", "ifc", "rvt")
LARGE = 10 * 1024 * 1024
IMMEDIATE, LATER = 0, 1


def ignored(path: Column) -> Column:
    """Events of lock, temporary and hidden files and of reserved folders say nothing."""
    name = F.regexp_extract(path, r"([^\\/]*)$", 1)
    return name.rlike(r"^[~.]") | F.lower(name).rlike(r"\.(tmp|bak|swp|part|crdownload)$") | path.rlike(r"[\\/](\.git|__pycache__|node_modules)[\\/]")


def priority(action: Column, path: Column, size: Column) -> Column:
    """0 at once, 1 in bulk; a deletion never waits."""
    form = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(action == "delete", IMMEDIATE).when(form.isin(*DEFERRED) | (F.coalesce(size, F.lit(0)) > LARGE), LATER).otherwise(IMMEDIATE)


def coalesced(events: DataFrame) -> DataFrame:
    """One task a path of (path, ts, seq, action, priority): the last action, the most urgent priority, how many events."""
    return events.groupBy("path").agg(F.max_by("action", F.struct("ts", "seq")).alias("action"), F.min("priority").alias("priority"), F.count("*").alias("events"), F.max("ts").alias("ts"))


def source(spark, folder: str, schema: str, most_files: int = 100, most_bytes: str | None = None) -> DataFrame:
    """File events of a folder as a bounded stream: no micro-batch takes more than that many files or bytes,
    what is over waits in the folder."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files)
    return (r.option("maxBytesPerTrigger", most_bytes) if most_bytes else r).parquet(folder)


def under_pressure(tasks: DataFrame, most: int) -> DataFrame:
    """tasks (path, priority, ts, ...) with run_now: urgent ones always, deferred ones only as far as more than
    most tasks wait, the oldest first. Counts come from classes, so no task holds the whole queue."""
    waiting = tasks.agg(F.greatest(F.count("*") - most, F.lit(0)).cast("double").alias("_over"), F.count(F.when(F.col("priority") == LATER, 1)).alias("_later"))
    share = waiting.select("_over", F.when(F.col("_later") > 0, F.least(F.lit(1.0), F.col("_over") / F.col("_later"))).otherwise(0.0).alias("_share")).first()
    if not share["_share"]:
        return tasks.withColumn("run_now", F.col("priority") == IMMEDIATE)
    # the time up to which deferred tasks are let through
    cut = tasks.filter(F.col("priority") == LATER).agg(F.percentile_approx(F.unix_micros("ts"), share["_share"], 100_000).alias("t")).first()["t"]
    return tasks.withColumn("run_now", (F.col("priority") == IMMEDIATE) | (F.unix_micros("ts") <= cut))


def run_queue(events: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, deferred: bool = False) -> StreamingQuery:
    """Each micro-batch's tasks of one class, coalesced, given to work one batch at a time; ends with what is there.

    work is called at least once a batch with its number; it commits the number with its output.
    """

    def step(batch: DataFrame, number: int) -> None:
        tasks = coalesced(batch).filter(F.col("priority") == (LATER if deferred else IMMEDIATE))
        work(tasks, number)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending(events: DataFrame, quiet: str = "10 minutes") -> DataFrame:
    """Keyed state: a path's task comes out when no event followed for some time; until then later ones replace it.

    Columns: path, ts, action, priority. State is one small row a path and is dropped when it came out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            action, level, n, last = state.get
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "action": [action], "priority": [level], "events": [n], "ts": [pd.Timestamp(last, unit="us")]})
            return
        action, level, n, last = state.get if state.exists else ("", LATER, 0, -1)
        for b in batches:
            for r in b.itertuples(index=False):
                at = int(pd.Timestamp(r.ts).value // 1000)
                level, n = min(level, int(r.priority)), n + 1
                if at >= last:
                    action, last = r.action, at
        state.update((action, level, n, last))
        wait = int(pd.Timedelta(quiet).total_seconds() * 1000)
        state.setTimeoutTimestamp(max(last // 1000 + wait, state.getCurrentWatermarkMs() + 1))

    return events.withWatermark("ts", quiet).groupBy("path").applyInPandasWithState(
        step, "path string, action string, priority int, events long, ts timestamp", "action string, priority int, events long, last long", "append", GroupStateTimeout.EventTimeTimeout
    )


def tumbling(events: DataFrame, key: str, size: str, late: str | None = None) -> DataFrame:
    """(window start, key, n, total) of events (ts, value)."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", size).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, key: str, gap: str, late: str | None = None) -> DataFrame:
    """(start, end, key, n): runs of events of a key without a pause longer than the gap."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
