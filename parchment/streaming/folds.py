"""Structured Streaming folds of run events, heartbeats, checkpoints, section edits and pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from parchment.operators.outline import heading_candidates
from parchment.operators.pages import doc_garble
from parchment.operators.records import TRANSITIONS

RUN_OUT = "run_id long, event_id long, status string, at timestamp, before string, progress int, reason string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """The column as a UTC timestamp with a watermark: later events go to no window and no state."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


class RunState(StatefulProcessor):
    """Status of a run, whose events wait until the watermark has passed them and then apply in order of time.

    What comes out has a reason where it is rejected: ``late`` (behind the watermark when it came, so others were
    applied already) or ``not allowed`` (may not follow the state).  Neither changes the state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "status string")
        self.waiting = handle.getListState("waiting", "us long, event_id long, status string")

    def _wait_for(self, waiting: list[tuple]) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if waiting:
            self.waiting.put(waiting)
            self.handle.registerTimer(min(w[0] for w in waiting) // 1000 + 1)
        else:
            self.waiting.clear()

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        passed, waiting, late = timerValues.getCurrentWatermarkInMs() * 1000, list(self.waiting.get()) if self.waiting.exists() else [], []
        for pdf in rows:
            for e in zip(pdf["us"].tolist(), pdf["event_id"].tolist(), pdf["status"].tolist()):
                (late if e[0] < passed else waiting).append(e)
        self._wait_for([tuple(w) for w in waiting])
        now = self.status.get()[0] if self.status.exists() else ""
        yield _events([(key[0], i, s, us, now, None, "late") for us, i, s in sorted(late, key=lambda e: e[:2])])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        passed, now, out = timerValues.getCurrentWatermarkInMs() * 1000, self.status.get()[0] if self.status.exists() else "", []
        waiting = sorted((tuple(w) for w in self.waiting.get()), key=lambda e: e[:2])
        for us, i, s in waiting:
            if us >= passed:
                break
            ok = s in (("queued", "running") if not now else TRANSITIONS.get(now, ()))
            out.append((key[0], i, s, us, now, 100 if ok and s == "complete" else None, None if ok else "not allowed"))
            now = s if ok else now
        if now:
            self.status.update((now,))
        self._wait_for([e for e in waiting if e[0] >= passed])
        yield _events(out)

    def close(self) -> None:
        pass


def _events(rows: list[tuple]):
    import pandas as pd

    out = pd.DataFrame(rows, columns=[c.split()[0] for c in RUN_OUT.split(", ")])
    return out.assign(at=pd.to_datetime(out["at"].astype("int64"), unit="us"), progress=out["progress"].astype("Int32"), run_id=out["run_id"].astype("int64"), event_id=out["event_id"].astype("int64"))


def run_state_stream(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """J1. Status events (run_id, status, at, event_id) in order of time, each with the state it met, or the reason for its rejection.

    An event comes out once the watermark (the latest time seen, less ``delay``) has passed it, in whichever batch it
    came; the state of a run and what still waits are all that is kept.  Needs the RocksDB state store.
    """
    # the time goes on as a number: a column with a watermark would lose its late rows before they are counted
    own = with_event_time(events, "at", delay).select("run_id", F.unix_micros("at").alias("us"), F.col("event_id").cast("long").alias("event_id"), "status")
    return own.filter("us is not null").groupBy("run_id").transformWithStateInPandas(RunState(), RUN_OUT, "Append", "EventTime")


def run_state_sinks(states: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """J1. Writes the applied events to ``path``/applied and the others to ``path``/rejects; a batch that is run again overwrites its own folders."""

    def put(batch: DataFrame, no: int) -> None:
        batch.persist()
        batch.filter("reason is null").drop("reason").write.mode("overwrite").parquet(f"{path}/applied/batch={no}")
        batch.filter("reason is not null").write.mode("overwrite").parquet(f"{path}/rejects/batch={no}")
        batch.unpersist()

    return states.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class StaleRuns(StatefulProcessor):
    """A timer for every running run: without a heartbeat until it fires, the run is to be queued again."""

    def __init__(self, timeout_s: int):
        self.timeout_ms = 1000 * timeout_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        import pandas as pd

        pdf = pd.concat(list(rows)).sort_values("at")
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if pdf["status"].iloc[-1] == "running":
            at = int(pdf["at"].iloc[-1].timestamp() * 1000)
            self.last.update((at,))
            self.handle.registerTimer(at + self.timeout_ms)
        elif self.last.exists():
            self.last.clear()
        yield pd.DataFrame({"run_id": pd.Series(dtype="int64"), "heartbeat_ms": pd.Series(dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        import pandas as pd

        last = self.last.get()[0] if self.last.exists() else None
        self.last.clear()
        yield pd.DataFrame({"run_id": [key[0]], "heartbeat_ms": [last]})

    def close(self) -> None:
        pass


def stale_runs_stream(events: DataFrame, timeout_s: int = 900, delay: str = "1 minute") -> DataFrame:
    """J2. Runs whose last status or heartbeat (run_id, status, at) says running and is older than the timeout in event time."""
    own = with_event_time(events, "at", delay).select("run_id", "status", "at")
    return own.groupBy("run_id").transformWithStateInPandas(StaleRuns(timeout_s), "run_id long, heartbeat_ms long", "Append", "EventTime")


class Checkpoints(StatefulProcessor):
    """Latest output of each stage of a run; what is older than the one kept, or the same again, changes nothing."""

    def __init__(self, stages: list[str]):
        self.stages = stages

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("kept", "stage string", "place long, output string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        import pandas as pd

        changed = False
        for pdf in rows:
            for stage, place, output in zip(pdf["stage"].tolist(), pdf["place"].tolist(), pdf["output"].tolist()):
                old = self.kept.getValue((stage,)) if self.kept.containsKey((stage,)) else None
                if old is None or (place, output or "") > (old[0], old[1] or ""):
                    self.kept.updateValue((stage,), (place, output))
                    changed = True
        out = []
        if changed:
            done = sorted(k[0] for k in self.kept.keys())  # noqa: SIM118
            out = [(key[0], done, next((s for s in self.stages if s not in done), None))]
        yield pd.DataFrame(out, columns=["run_id", "done", "resume_at"]).astype({"run_id": "int64"})

    def close(self) -> None:
        pass


def checkpoint_stream(events: DataFrame, stages: list[str]) -> DataFrame:
    """J3. (run_id, done, resume_at) of each run whose checkpoints (run_id, stage, output, place) changed: its stages done and the first of ``stages`` that isn't.

    A run keeps one row a stage.  Of two outputs of a stage the one of the larger ``place`` counts, so replays, repeats
    and shuffled batches end in the same state.  Needs the RocksDB state store.
    """
    own = events.filter("stage is not null and place is not null").select("run_id", "stage", F.col("place").cast("long").alias("place"), F.col("output").cast("string").alias("output"))
    return own.groupBy("run_id").transformWithStateInPandas(Checkpoints(stages), "run_id long, done array<string>, resume_at string", "Update", "None")


def upsert_stream(events: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """J3. Keeps the last row of each key: a batch's last rows are appended with their order, and ``latest`` reads them back.

    Appending is idempotent by batch: a batch that is run again overwrites its own folder.
    """
    columns = [c for c in events.columns if c not in keys]

    def put(batch: DataFrame, no: int) -> None:
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("v")).select(*keys, "v.*")
        last.write.mode("overwrite").parquet(f"{path}/batch={no}")

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row of each key of an append-only table."""
    columns = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("v")).select(*keys, "v.*")


class SectionEdits(StatefulProcessor):
    """Revision of a section: an edit that names it is accepted and raises it; others come out as rejected."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.revision = handle.getValueState("revision", "revision long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        import pandas as pd

        pdf = pd.concat(list(rows)).sort_values("ord")
        now = self.revision.get()[0] if self.revision.exists() else 0
        out = []
        for e in pdf.itertuples():
            ok = e.revision == now
            now += ok
            out.append((key[0], key[1], e.html, int(now), bool(ok)))
        self.revision.update((int(now),))
        yield pd.DataFrame(out, columns=["run_id", "section_key", "html", "revision", "accepted"])

    def close(self) -> None:
        pass


def section_edit_stream(edits: DataFrame) -> DataFrame:
    """J4. Edits (run_id, section_key, revision, html, ord) with the revision after them and whether they were accepted."""
    return edits.groupBy("run_id", "section_key").transformWithStateInPandas(SectionEdits(), "run_id long, section_key string, html string, revision long, accepted boolean", "Append", "None")


class WholeDocuments(StatefulProcessor):
    """Pages of a document wait for each other; all of them come out once, when the last one is there."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page_idx int", "text string")
        self.done = handle.getValueState("done", "n_pages int")

    def _until(self, ms: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(ms + self.wait_ms)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        import pandas as pd

        pdf = pd.concat(list(rows))
        self._until(int(pdf["ms"].max()))
        out = []
        if not self.done.exists():
            for page, text in zip(pdf["page_idx"].tolist(), pdf["text"].tolist()):
                if not self.pages.containsKey((page,)):  # the first of repeated pages
                    self.pages.updateValue((page,), (text,))
            n = int(pdf["n_pages"].max())
            found = {k[0]: v[0] for k, v in self.pages.iterator()}
            if all(page in found for page in range(n)):
                out = [(key[0], page, found[page], True) for page in range(n)]
                self.pages.clear()
                self.done.update((n,))
        yield _pages(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        out = [(key[0], k[0], v[0], False) for k, v in self.pages.iterator()]
        self.pages.clear()
        self.done.clear()
        yield _pages(sorted(out, key=lambda x: x[1]))

    def close(self) -> None:
        pass


def _pages(rows: list[tuple]):
    import pandas as pd

    return pd.DataFrame(rows, columns=["doc_id", "page_idx", "text", "whole"]).astype({"page_idx": "int32", "whole": "bool"})


def whole_documents(pages: DataFrame, wait_s: int = 86_400, delay: str = "1 hour") -> DataFrame:
    """J5. Pages (doc_id string, page_idx, text, n_pages, at) of documents all of whose pages have come, each once: doc_id, page_idx, text, whole.

    However pages are dealt over batches, a document comes out in one.  Repeated pages are dropped, also after it came
    out; a document that lacks pages ``wait_s`` after its last one comes out with whole = false; then it is forgotten.
    """
    own = with_event_time(pages, "at", delay).select("doc_id", F.col("page_idx").cast("int").alias("page_idx"), F.col("n_pages").cast("int").alias("n_pages"), "text", F.unix_millis("at").alias("ms"))
    own = own.filter("page_idx is not null and n_pages is not null and ms is not null")
    return own.groupBy("doc_id").transformWithStateInPandas(WholeDocuments(1000 * wait_s), "doc_id string, page_idx int, text string, whole boolean", "Append", "EventTime")


def verdicts_and_outlines(pages: DataFrame) -> dict[str, DataFrame]:
    """Garble verdicts of documents, and the outline entries of those that aren't garbled."""
    verdicts = doc_garble(pages)
    good = pages.join(verdicts.filter("not garbled").select("doc_id"), "doc_id", "left_semi")
    lines = good.select("doc_id", "page_idx", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return {"verdicts": verdicts, "outline": heading_candidates(lines)}


def incremental_documents(pages: DataFrame, path: str, checkpoint: str, work: Callable[[DataFrame], dict[str, DataFrame]] = verdicts_and_outlines, wait_s: int = 86_400, delay: str = "1 hour") -> StreamingQuery:
    """J5. New pages through ``work`` (verdicts, then outlines), a whole document at a time and exactly once.

    Each batch writes its own folder below ``path``/name; pages of documents that stayed incomplete go to ``path``/incomplete.
    """

    def put(batch: DataFrame, no: int) -> None:
        batch.persist()
        whole = batch.filter("whole").drop("whole")
        for name, df in {**work(whole), "incomplete": batch.filter("not whole").drop("whole")}.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}/batch={no}")
        batch.unpersist()

    return whole_documents(pages, wait_s, delay).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
