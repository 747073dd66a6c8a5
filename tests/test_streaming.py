"""Stream forms of the folds, driven to completion over small files."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from parchment.operators import pages as P
from parchment.operators import records as R
from parchment.streaming import folds


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


@pytest.fixture(autouse=True)
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", folds.ROCKSDB)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def stream(spark, tmp_path, *frames, name="in"):
    """One file and one micro-batch a frame, in this order."""
    path = tmp_path / name
    for k, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(str(path))
        for f in path.glob("*.parquet"):
            if f.stat().st_mtime > 1e9 + len(frames):
                os.utime(f, (1e9 + k, 1e9 + k))
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(spark, tmp_path, out, name, mode="append"):
    q = out.writeStream.format("memory").outputMode(mode).queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-ck")).trigger(availableNow=True).start()
    finish(q)
    return spark.table(name).collect()


def finish(q):
    q.awaitTermination(240)
    assert not q.isActive and q.exception() is None


EVENT = "run_id long, event_id long, status string, at timestamp"


def test_run_state(spark, tmp_path):
    e = spark.createDataFrame([(1, 1, "complete", at(0)), (1, 2, "running", at(1)), (1, 3, "complete", at(2)), (2, 4, "queued", at(3))], EVENT)
    end = spark.createDataFrame([(9, 99, "queued", at(10**6))], EVENT)
    rows = run(spark, tmp_path, folds.run_state_stream(stream(spark, tmp_path, e, end), "0 seconds"), "run_states")
    assert sorted((r.run_id, r.status, r.before, r.reason or "", r.progress) for r in rows if r.run_id < 9) == [(1, "complete", "", "not allowed", None), (1, "complete", "running", "", 100), (1, "running", "", "", None), (2, "queued", "", "", None)]


def test_run_state_of_shuffled_batches(spark, tmp_path):
    """Events of a run are dealt over batches out of order; what the delay covers ends as in the batch form, a late one is rejected."""
    r = random.Random(4)
    rows = [(r.choice([1, 1, 2, 3]), k, r.choice([*R.TRANSITIONS, "running", "queued"]), at(r.randrange(500))) for k in range(120)]
    parts = [spark.createDataFrame(rows[k : k + 30], EVENT) for k in range(0, 120, 30)]
    late = spark.createDataFrame([(1, 777, "failed", at(3)), (4, 778, "queued", at(4))], EVENT)
    mark, end = (spark.createDataFrame([(9, 990 + k, "queued", at(t))], EVENT) for k, t in enumerate((5000, 10**6)))
    states = folds.run_state_stream(stream(spark, tmp_path, *parts, mark, late, end), "1000 seconds")
    finish(folds.run_state_sinks(states, str(tmp_path / "out"), str(tmp_path / "ck")))
    applied, rejects = (spark.read.parquet(str(tmp_path / "out" / n)) for n in ("applied", "rejects"))
    state, bad = R.run_state(spark.createDataFrame(rows, EVENT), ["at", "event_id"])
    last = applied.filter("run_id < 9").groupBy("run_id").agg(F.max_by("status", F.struct("at", "event_id")).alias("status"))
    assert sorted(map(tuple, last.collect())) == sorted((x.run_id, x.status) for x in state.collect() if x.status)
    found = rejects.filter("reason = 'not allowed'").select("run_id", "status", "before", "at").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, map(tuple, bad.collect())))
    assert sorted((x.run_id, x.event_id) for x in rejects.filter("reason = 'late'").collect()) == [(1, 777), (4, 778)]
    assert applied.filter("run_id < 9").count() + len(found) == len(rows)


def test_stale_runs(spark, tmp_path):
    """A run without a heartbeat for the timeout comes out once; one that goes on, or that ended, doesn't."""
    beat = "run_id long, status string, at timestamp"
    first = spark.createDataFrame([(1, "running", at(0)), (2, "running", at(0)), (3, "running", at(0))], beat)
    second = spark.createDataFrame([(2, "running", at(800)), (3, "complete", at(10))], beat)
    third, end = spark.createDataFrame([(9, "queued", at(1000))], beat), spark.createDataFrame([(9, "queued", at(1200))], beat)
    rows = run(spark, tmp_path, folds.stale_runs_stream(stream(spark, tmp_path, first, second, third, end), 900, "0 seconds"), "stale")
    assert [(r.run_id, r.heartbeat_ms) for r in rows] == [(1, int(at(0).replace(tzinfo=dt.timezone.utc).timestamp() * 1000))]


def test_section_edits(spark, tmp_path):
    e = spark.createDataFrame([(1, "a", 0, "x", 1), (1, "a", 0, "y", 2), (1, "a", 1, "z", 3)], "run_id long, section_key string, revision long, html string, ord long")
    rows = run(spark, tmp_path, folds.section_edit_stream(stream(spark, tmp_path, e)), "section_edits")
    assert sorted((r.html, r.revision, r.accepted) for r in rows) == [("x", 1, True), ("y", 1, False), ("z", 2, True)]


def test_checkpoints(spark, tmp_path):
    """Replayed and shuffled batches end where the batch form does; a replay puts nothing out."""
    stages = ["ingest", "outline", "build"]
    rows = [(1, "outline", "late one", 9), (1, "ingest", "a", 1), (2, "ingest", "x", 2), (1, "outline", "old", 3), (2, "build", "y", 4), (1, "ingest", "b", 5), (3, None, "none", 6)]
    frame = lambda part: spark.createDataFrame(part, "run_id long, stage string, output string, place long")
    out = run(spark, tmp_path, folds.checkpoint_stream(stream(spark, tmp_path, frame(rows[:4]), frame(rows[4:]), frame(rows[:4]), frame(rows)), stages), "checkpoints", "update")
    assert len(out) == 4  # two runs in the first batch, both in the second, none in the replays
    last = {r.run_id: (r.done, r.resume_at) for r in out}
    names = spark.createDataFrame([(s, k) for k, s in enumerate(stages)], "stage string, ord int")
    batch = R.resume_points(frame(rows).filter("stage is not null"), names, ["place"]).collect()
    assert last == {r.run_id: (r.done, r.resume_at) for r in batch}


def test_upserts(spark, tmp_path):
    e = spark.createDataFrame([(1, "ingest", "a", 1), (1, "ingest", "b", 2), (1, "outline", "c", 3)], "run_id long, stage string, output string, t long")
    finish(folds.upsert_stream(stream(spark, tmp_path, e), str(tmp_path / "ckpt"), ["run_id", "stage"], ["t"], str(tmp_path / "ck1")))
    last = folds.latest(spark.read.parquet(str(tmp_path / "ckpt")), ["run_id", "stage"], ["t"])
    assert sorted((r.stage, r.output) for r in last.collect()) == [("ingest", "b"), ("outline", "c")]


GOOD = "{} Scope of the requirement\nThe requirement of this standard shall be provided in the annex for each device.\nIt shall be tested."
PAGE = "doc_id string, page_idx int, n_pages int, text string, at timestamp"


def test_documents_split_over_batches(spark, tmp_path):
    """Verdicts and outlines are those of whole documents, however their pages are dealt; repeats change nothing; what stays incomplete comes out as such."""
    pages = [(d, k, 9, GOOD.format(k + 1) if d != "b" else "q%x#7& z@k" * 9, at(10 * k)) for d in "abc" for k in range(9)]
    short = [("d", 0, 3, GOOD.format(1), at(5)), ("d", 2, 3, None, at(6))]
    mixed = pages + pages[:5]
    random.Random(2).shuffle(mixed)
    parts = [spark.createDataFrame(mixed[k::4], PAGE) for k in range(4)]
    again, end = spark.createDataFrame(pages[:12] + short, PAGE), [spark.createDataFrame([("z", 0, 2, "x", at(t))], PAGE) for t in (10**6, 2 * 10**6)]
    out = str(tmp_path / "out")
    finish(folds.incremental_documents(stream(spark, tmp_path, *parts, again, *end), out, str(tmp_path / "ck"), wait_s=3600, delay="0 seconds"))
    batch = spark.createDataFrame([p[:2] + p[3:4] for p in pages], "doc_id string, page_idx int, text string")
    expected = folds.verdicts_and_outlines(batch)
    for name in ("verdicts", "outline"):
        got = spark.read.parquet(f"{out}/{name}").drop("batch")
        assert sorted(map(str, got.select(expected[name].columns).collect())) == sorted(map(str, expected[name].collect()))
    assert {r.doc_id: r.garbled for r in expected["verdicts"].collect()} == {"a": False, "b": True, "c": False}
    left = spark.read.parquet(f"{out}/incomplete").filter("doc_id <> 'z'")
    assert sorted((r.doc_id, r.page_idx) for r in left.collect()) == [("d", 0), ("d", 2)]


def test_a_batch_operator_over_whole_documents(spark, tmp_path):
    pages = spark.createDataFrame([("d", 0, 1, GOOD.format(1), at(0))], PAGE)
    finish(folds.incremental_documents(stream(spark, tmp_path, pages), str(tmp_path / "v"), str(tmp_path / "ck"), lambda p: {"verdicts": P.doc_garble(p)}))
    assert [r.garbled for r in spark.read.parquet(str(tmp_path / "v" / "verdicts")).collect()] == [False]


def test_stale_runs_in_batch(spark):
    latest = spark.createDataFrame([(1, "running"), (2, "running"), (3, "complete")], "run_id long, status string")
    beats = spark.createDataFrame([(1, at(0)), (2, at(800))], "run_id long, at timestamp")
    assert [r.run_id for r in R.stale_runs(latest, beats, F.lit(at(1000))).collect()] == [1]
