import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import incremental as inc
from tesserae.session import fresh_path
from tesserae.sources.versions import CommitConflict, VersionedTable

SCANS = "scan_id bigint, run_id bigint, source_path string, sha256 string, scanned_at timestamp"
RUNS = "run_id bigint, run_status string"
FILES = "source_path string, sha256 string, status string, indexed_at string, modified_at string"


def brute(scans, runs, files):
    held = {}
    for p, s, st, at, _ in sorted(files, key=lambda f: f[3] or ""):
        held[p] = s[:16].lower() if st == "indexed" and s else None
    out = set()
    for r in sorted(r for r, s in runs if s == "success"):
        last = {}
        for i, run, p, s, at in scans:
            if run is not None and p is not None and run <= r and s:
                k = (at is not None, at or dt.datetime.min, i)
                if p not in last or k > last[p][0]:
                    last[p] = (k, s[:16].lower())
        for p, (_, s) in last.items():
            if held.get(p) != s:
                out.add((r, p))
                held[p] = s
    return out


def made(seed):
    rng = random.Random(seed)
    day = dt.datetime(2025, 1, 1)
    files = [(f"p{i}", rng.choice(["a" * 16, "B" * 16, "", None]), rng.choice(["indexed", "failed"]), "2025-01-01T00:00:00Z", None) for i in range(6)]
    scans = [(i, rng.randint(1, 6), f"p{rng.randint(0, 8)}", rng.choice(["a" * 64, "A" * 16, "b" * 16, "c" * 16, "", None]), day + dt.timedelta(hours=rng.randint(0, 40))) for i in range(60)]
    scans += [scans[0], (99, None, "p1", "a" * 16, day), (98, 2, None, "a" * 16, day), (97, 3, "p2", "d" * 16, None)]
    runs = [(r, rng.choice(["success", "success", "failed", "killed"])) for r in range(1, 6)]
    return scans, runs, files


@pytest.mark.parametrize("seed", range(2))
def test_steps_agree_with_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(inc, "COMPACT", 3)
    scans, runs, files = made(seed)
    s, r, f = spark.createDataFrame(scans, SCANS), spark.createDataFrame(runs, RUNS), spark.createDataFrame(files, FILES)
    want = brute(scans, runs, files)
    # the feed grows run by run: each time only later runs' sightings are written
    path, state = fresh_path(spark, "feed"), fresh_path(spark, "state")
    good = sorted(x for x, k in runs if k == "success")
    seen: set[str] = set()
    for n, run in enumerate(good):
        feed, version_of, _ = inc.ingest(s.filter(F.col("run_id") <= run), r.filter(F.col("run_id") <= run), path)
        fresh = set(feed.added(inc.Consumer(spark, feed, inc.held_at_first(f), state).processed(), version_of[run]))
        assert not fresh & seen
        seen |= fresh
        # dies at any point before its commit: nothing is kept, and a new process makes the run again
        for crash in ("delta", "data"):
            c = inc.Consumer(spark, feed, inc.held_at_first(f), state)
            before, out = c.state.version(), sorted(map(tuple, c.outputs().collect()))
            with pytest.raises(RuntimeError):
                c.step(run, version_of[run], crash=crash)
            assert c.state.version() == before and sorted(map(tuple, c.outputs().collect())) == out
        c = inc.Consumer(spark, feed, inc.held_at_first(f), state)
        c.step(run, version_of[run])
        now = c.state.version()
        assert c.step(run, version_of[run]) == now  # made twice, processed once
        assert {tuple(x) for x in c.outputs().collect()} == {x for x in want if x[0] <= run}
    assert sorted(map(tuple, c.outputs().collect())) == sorted(want) == sorted(map(tuple, inc.process(s, r, f).collect()))


def test_no_runs_and_no_rows(spark):
    s, r, f = spark.createDataFrame([], SCANS), spark.createDataFrame([(1, "success"), (2, "failed")], RUNS), spark.createDataFrame([], FILES)
    assert inc.process(s, r, f).count() == 0
    assert inc.process(s, r.filter("run_id > 1"), f).count() == 0


def test_checkpoints_compaction_and_garbage(spark):
    schema = spark.createDataFrame([], "k int, v string").schema
    t = VersionedTable(spark, fresh_path(spark, "t"), schema)
    for i in range(12):
        t.append(spark.createDataFrame([(i % 4, str(i))], schema), delete=F.col("k") == i % 4)
    want = [(i % 4, str(i)) for i in range(8, 12)]
    assert sorted(map(tuple, t.read().collect())) == want and t._files(f"{t.path}/checkpoints") == []
    assert t._exists(f"{t.path}/checkpoints/000000000010.json")
    version = t.compact()
    assert version == 13 and sorted(map(tuple, t.read().collect())) == want and sorted(map(tuple, t.read(11).collect())) == [(0, "8"), (1, "9"), (2, "10"), (3, "7")]
    assert t._state(13)[1] == [] and len(t._state(12)[1]) > 0
    with pytest.raises(ValueError):
        t.changes(12, 13)
    gone = t.collect_garbage(13)
    assert len(gone) > 12 and sorted(map(tuple, t.read().collect())) == want


def test_versions(spark):
    schema = spark.createDataFrame([], "k int, v string").schema
    t = VersionedTable(spark, fresh_path(spark, "t"), schema)
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    assert t.append(rows((1, "a"), (2, "b")), {"source": 7}) == 1
    assert t.append(rows((2, "c"), (3, "d")), delete=F.col("k") == 2) == 2
    assert sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, t.read(1).collect())) == [(1, "a"), (2, "b")]
    assert sorted(map(tuple, t.changes(1, 2).collect())) == [(2, "b", "delete"), (2, "c", "insert"), (3, "d", "insert")]
    assert sorted(map(tuple, t.changes(0, 2).collect())) == [(1, "a", "insert"), (2, "c", "insert"), (3, "d", "insert")]
    with pytest.raises(CommitConflict):
        t.commit(1)
    assert t.manifest(1)["properties"] == {"source": 7}
