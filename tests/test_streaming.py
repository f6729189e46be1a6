import json
import os

from tesserae.streaming import events as ev

SCHEMA = "path string, ts timestamp, seq bigint, action string, size bigint"


def feed(tmp_path, name, rows):
    (tmp_path / "in").mkdir(exist_ok=True)
    file = tmp_path / "in" / name
    file.write_text("\n".join(json.dumps(r) for r in rows))
    # a source takes older files first; files of one moment would come in any order
    os.utime(file, (1_700_000_000 + int(name[0]),) * 2)


def row(path, minute, seq, action, size=1):
    return {"path": path, "ts": f"2025-01-01T00:{minute:02d}:00Z", "seq": seq, "action": action, "size": size}


def stream(spark, tmp_path):
    from pyspark.sql import functions as F

    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    return s.filter(~ev.ignored(F.col("path"))).withColumn("priority", ev.priority(F.col("action"), F.col("path"), F.col("size")))


def test_queue_coalesces_and_defers(spark, tmp_path):
    feed(tmp_path, "1.json", [row("/a.pdf", 0, 1, "index"), row("/a.pdf", 1, 2, "reindex"), row("/~x.pdf", 1, 3, "index"), row("/m.dwg", 1, 4, "index")])
    feed(tmp_path, "2.json", [row("/m.dwg", 2, 5, "delete"), row("/b.pdf", 2, 6, "index", 99_000_000)])
    got = {}
    for late in (False, True):
        out = []
        ev.run_queue(stream(spark, tmp_path), lambda t, n: out.extend((n, r["path"], r["action"], r["events"]) for r in t.collect()), f"{tmp_path}/cp{late}", late).awaitTermination()
        got[late] = sorted(x[1:] for x in out)
    assert got[False] == [("/a.pdf", "reindex", 2), ("/m.dwg", "delete", 1)]
    assert got[True] == [("/b.pdf", "index", 1), ("/m.dwg", "index", 1)]


def test_pending_state(spark, tmp_path):
    feed(tmp_path, "1.json", [row("/a.pdf", 0, 1, "index")])
    feed(tmp_path, "2.json", [row("/a.pdf", 3, 2, "delete")])
    feed(tmp_path, "3.json", [row("/z.pdf", 50, 3, "index")])
    feed(tmp_path, "4.json", [row("/z.pdf", 51, 4, "index")])
    q = ev.pending(stream(spark, tmp_path)).writeStream.format("memory").queryName("pending").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["path"], r["action"], r["events"]) for r in spark.table("pending").collect()] == [("/a.pdf", "delete", 2)]


def test_windows(spark):
    df = spark.createDataFrame([(1, "2025-01-01 00:00:00", 1.0), (1, "2025-01-01 00:10:00", 2.0), (1, "2025-01-01 02:00:00", 4.0)], "k int, t string, value double").selectExpr("k", "cast(t as timestamp) ts", "value")
    assert sorted(r["total"] for r in ev.tumbling(df, "k", "1 hour").collect()) == [3.0, 4.0]
    assert sorted(r["n"] for r in ev.sessions(df, "k", "30 minutes").collect()) == [1, 2]
