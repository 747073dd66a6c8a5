"""Run history, section versions, checkpoints and forks: append-only tables and their latest views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions import ids

from .helpers import keep_first, nulls_last
from .scans import PLACES, SECONDS, fold_counter, fold_states, time_slice

#: Which status may follow which.
TRANSITIONS = {"queued": ("running", "failed"), "running": ("awaiting_user", "complete", "failed", "queued"), "awaiting_user": ("queued", "running", "complete", "failed"), "complete": (), "failed": ("queued",)}
PAGE = 25
SORTS = {"date": "started_at", "name": "title", "user": "username"}


def history_filter(runs: DataFrame, username: str | None = None, silo: str | None = None, status: str | None = None, title: str | None = None) -> DataFrame:
    """B7. Optional conjuncts; the name is compared trimmed and lower-cased, the title contains the text in any case (``%`` and ``_`` keep their LIKE meaning)."""
    if username and username.strip():
        runs = runs.filter(F.lower(F.trim("username")) == username.strip().lower())
    if silo:
        runs = runs.filter(F.col("silo_id") == silo)
    if status:
        runs = runs.filter(F.col("status") == status)
    if title and title.strip():
        runs = runs.filter(F.ilike("title", F.lit(f"%{title.strip()}%")))
    return runs


def search_all_terms(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    """B8. Every blank-separated term occurs in the columns' text; an empty query keeps all."""
    hay = F.lower(F.concat_ws(" ", *columns))
    for term in query.lower().split():
        df = df.filter(F.contains(hay, F.lit(term)))
    return df


def preview_file(files: DataFrame) -> DataFrame:
    """B18. Of each run the first output ``.pdf`` whose name lacks ``_edited``."""
    ok = (F.col("kind") == "output") & F.lower("filename").endswith(".pdf") & ~F.contains("filename", F.lit("_edited"))
    return files.filter(ok).groupBy("run_id").agg(F.min_by(F.struct("file_id", "filename"), "ord").alias("f")).select("run_id", "f.*")


def history(runs: DataFrame, users: DataFrame, sort: str = "date", descending: bool = True, page: int = 1, size: int = PAGE, **filters) -> DataFrame:
    """C11, F7, E22. One page of runs with their owner, sorted by date, name or user (unknown: date), ties by start descending."""
    own = history_filter(runs.join(users.select("user_id", "username"), "user_id"), **filters)
    column = F.col(SORTS.get(sort, "started_at"))
    order = [column.desc_nulls_last() if descending else column.asc_nulls_last(), F.col("started_at").desc_nulls_last(), F.col("run_id")]
    return own.orderBy(*order).offset((page - 1) * size).limit(size)


def history_total(runs: DataFrame, users: DataFrame, **filters) -> DataFrame:
    """D36. Number of runs under the same filters."""
    return history_filter(runs.join(users.select("user_id", "username"), "user_id"), **filters).agg(F.count("*").alias("total"))


def attach_files(runs: DataFrame, files: DataFrame) -> DataFrame:
    """A10. Rows to append for new files of known runs: key, size and kind."""
    return files.join(runs.select("run_id"), "run_id", "left_semi").select("run_id", "filename", "kind", F.col("size").cast("long").alias("size"), ids.object_key(F.lit(""), F.col("run_id"), F.col("kind"), F.col("filename")).alias("key"))


def numbered_versions(existing: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """E3. Rows to append with version_num: the next numbers of each run and section."""
    top = existing.groupBy("run_id", "section_key").agg(F.max("version_num").alias("_top"))
    w = Window.partitionBy("run_id", "section_key").orderBy(*nulls_last(*order))
    return new.withColumn("_k", F.row_number().over(w)).join(top, ["run_id", "section_key"], "left").withColumn("version_num", F.coalesce("_top", F.lit(0)) + F.col("_k")).drop("_k", "_top")


def current_sections(versions: DataFrame) -> DataFrame:
    """E4. Latest version of each section; its revision is the number of writes."""
    one = versions.groupBy("run_id", "section_key").agg(F.max_by(F.struct("html", "version_num"), "version_num").alias("v"), F.count("*").alias("revision"))
    return one.select("run_id", "section_key", "v.html", "v.version_num", "revision")


def apply_edits(current: DataFrame, edits: DataFrame, width: float = PLACES) -> tuple[DataFrame, DataFrame]:
    """E5. (accepted, rejected) edits: an edit must name the section's revision; a section never seen starts at 1.

    Several edits of a section are taken in order: one that names the next revision is accepted after another,
    so the accepted ones are those that continue a chain from the current revision.  A slice of a section's edits
    spans ``width`` of ``ord``.
    """
    keys = ["run_id", "section_key"]
    own = edits.select(*keys, F.col("ord").cast("int").alias("ord"), F.col("revision").cast("long").alias("revision"), "html")
    done = fold_counter(own, keys, "ord", "revision", current, "revision", width)
    after = F.col("actual") + 1
    accepted = done.filter("ok").select(*keys, "html", after.alias("version_num"), F.concat(F.lit("Edited (v"), after.cast("string"), F.lit(")")).alias("label"))
    rejected = done.filter("not ok").select(*keys, "ord", F.col("revision").alias("expected"), "actual")
    return accepted, rejected


def restore_versions(versions: DataFrame, wanted: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """E6. (rows to append, rejects): copies of version n, labelled ``Restored vn``; a missing version is rejected.

    Several restores of a section are appended one after another, by ``order`` or else by the version they name.
    """
    keys = ["run_id", "section_key"]
    own = wanted.select(*keys, "version_num", F.col(order or "version_num").alias("_order"))
    found = own.join(versions.select(*keys, "version_num", "html"), [*keys, "version_num"], "left")
    copies = found.filter("html is not null").select(*keys, "html", "_order", F.concat(F.lit("Restored v"), F.col("version_num").cast("string")).alias("label"))
    out = numbered_versions(versions, copies, ["_order", "label"]).select(*keys, "html", "version_num", "label")
    return out, found.filter("html is null").select(*keys, "version_num")


def versions_newest_first(versions: DataFrame) -> DataFrame:
    """F8."""
    return versions.orderBy("run_id", "section_key", F.desc("version_num"))


def fork_runs(runs: DataFrame, files: DataFrame, checkpoints: DataFrame, sections: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """C30. Rows to append for forks (requests: run_id, new_id): the run with its input files, checkpoints and sections.

    The title becomes ``Copy of ...``, a complete run waits for its user, sections start at revision 1 with one
    version labelled ``Forked from ...``, and the new run keeps the old one as its lineage.
    """
    of = requests.select("run_id", "new_id")
    new = lambda df: df.join(of, "run_id")
    moved = lambda df: new(df).select(F.col("new_id").alias("run_id"), *[c for c in df.columns if c != "run_id"])
    own = new(runs)
    rest = [c for c in runs.columns if c not in ("run_id", "title", "status")]
    forked = own.select(F.col("new_id").alias("run_id"), F.concat(F.lit("Copy of "), "title").alias("title"), F.when(F.col("status") == "complete", "awaiting_user").otherwise(F.col("status")).alias("status"), *rest, F.col("run_id").alias("forked_from"))
    latest = new(sections)
    return {
        "runs": forked,
        "files": moved(files.filter("kind = 'input'")),
        "checkpoints": moved(checkpoints),
        "sections": latest.select(F.col("new_id").alias("run_id"), "section_key", "html", F.lit(1).cast("long").alias("revision")),
        "versions": latest.select(F.col("new_id").alias("run_id"), "section_key", "html", F.lit(1).cast("long").alias("version_num"), F.concat(F.lit("Forked from "), F.col("run_id").cast("string")).alias("label")),
    }


def prompt_override(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """C31. An override that isn't blank wins."""
    out = defaults.join(overrides.select("prompt_key", F.col("text").alias("_own")), "prompt_key", "left")
    return out.select("prompt_key", F.coalesce(F.when(ids.text_of("_own") != "", F.col("_own")), F.col("text")).alias("text"), (ids.text_of("_own") != "").alias("overridden"))


def section_tree(sections: DataFrame) -> DataFrame:
    """D38. Dotted keys grouped by their first segment, with leaf labels and whether they were edited."""
    parts = F.split("section_key", r"\.")
    leaf = ids.humanize_key(F.element_at(parts, -1))
    rows = sections.select("run_id", parts[0].alias("top"), F.struct("section_key", leaf.alias("label"), (F.col("revision") > 1).alias("edited")).alias("leaf"))
    return rows.groupBy("run_id", "top").agg(F.array_sort(F.collect_list("leaf")).alias("leaves"))


def stage_progress(runs: DataFrame, stages: DataFrame) -> DataFrame:
    """E25. State of each stage of a run: complete before the current one (all of a complete run), invalid at a failed run's, else incomplete.

    ``stages``: stage, ord; ``runs``: run_id, status, stage.
    """
    at = stages.select("stage", F.col("ord").alias("at"))
    spine = runs.join(F.broadcast(at), "stage", "left").select("run_id", "status", "at", F.explode(F.lit([r["stage"] for r in stages.orderBy("ord").collect()])).alias("stage"))
    both = spine.join(F.broadcast(stages.select("stage", "ord")), "stage")
    state = F.when((F.col("status") == "complete") | (F.col("ord") < F.col("at")), "complete").when((F.col("status") == "failed") & (F.col("ord") == F.col("at")), "invalid").otherwise("incomplete")
    return both.select("run_id", "stage", "ord", state.alias("state"))


def run_state(events: DataFrame, order: list[str], seconds: float = SECONDS) -> tuple[DataFrame, DataFrame]:
    """J1 in batch form: (current state of each run, events that no transition allows).

    Events of a run are folded in order (the first column is a time, of which a slice spans ``seconds``); an event
    that may not follow the state is rejected and changes nothing.
    """
    own = events.select("run_id", *dict.fromkeys(["status", "at", *order]))
    marked = fold_states(own, ["run_id"], order, "status", ["", *TRANSITIONS], {"": ("queued", "running"), **TRANSITIONS}, time_slice(F.col(order[0]), seconds))
    place = F.struct(*[x for c in order for x in (F.col(c).isNull().alias(f"{c}_none"), F.col(c))])
    started = F.min(F.when(F.col("ok") & (F.col("status") == "running"), F.col("at")))
    ended = F.max(F.when(F.col("ok") & F.col("status").isin("complete", "failed"), F.col("at")))
    state = marked.groupBy("run_id").agg(F.max_by("state", place).alias("status"), started.alias("started_at"), ended.alias("ended_at"))
    state = state.withColumn("progress", F.when(F.col("status") == "complete", 100)).withColumn("duration_ms", ids.elapsed_ms(F.col("started_at"), F.col("ended_at")))
    return state, marked.filter("not ok").select("run_id", "status", "before", "at")


def latest_status(events: DataFrame, order: list[str]) -> DataFrame:
    """Last status of each run, whatever came before."""
    return events.groupBy("run_id").agg(F.max_by(F.struct("status", "at"), F.struct(*order)).alias("v")).select("run_id", "v.status", "v.at")


def stale_runs(latest: DataFrame, heartbeats: DataFrame, now: Column, timeout_s: int = 900) -> DataFrame:
    """J2 in batch form: running runs without a heartbeat for the timeout, to be queued again."""
    hb = heartbeats.groupBy("run_id").agg(F.max("at").alias("heartbeat"))
    return latest.filter("status = 'running'").join(hb, "run_id", "left").filter(F.col("heartbeat").isNull() | (F.col("heartbeat") < now - F.make_dt_interval(secs=F.lit(timeout_s)))).select("run_id", "heartbeat")


def resume_points(events: DataFrame, stages: DataFrame, order: list[str]) -> DataFrame:
    """J3 in batch form: per run the stages done and the first stage in order that isn't."""
    done = events.groupBy("run_id", "stage").agg(F.max_by("output", F.struct(*order)).alias("output"))
    names = F.lit([r["stage"] for r in stages.orderBy("ord").collect()])
    out = done.groupBy("run_id").agg(F.collect_set("stage").alias("s"))
    left = F.filter(names, lambda x: ~F.array_contains("s", x))
    return out.select("run_id", F.array_sort("s").alias("done"), F.get(left, F.lit(0)).alias("resume_at"))


def picked_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key."""
    return keep_first(df, keys, nulls_last(*order))
