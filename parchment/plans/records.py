"""Queries of records, replies, edits and calibration texts, and SQL of the folds in ``texts``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.functions import text as T
from parchment.functions import ids
from parchment.operators import compare as C
from parchment.operators import jobs as J
from parchment.operators import layout as L
from parchment.operators import records as R

from . import layouts
from . import views as V

STAGES = ["ingest", "outline", "build"]


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return V.t(spark, sf, "orders").withColumn("k", F.col("o_orderkey")).withColumn("c", F.col("o_custkey"))


def _stages(spark: SparkSession) -> DataFrame:
    return spark.range(3).select(F.element_at(F.lit(STAGES), (F.col("id") + 1).cast("int")).alias("stage"), F.col("id").cast("int").alias("ord"))


def version_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """The last two of each section's versions, appended again after the others."""
    v = V.versions(spark, sf)
    old, new = v.filter("version_num <= 2"), v.filter("version_num > 2")
    return R.numbered_versions(old, new.select("run_id", "section_key", F.col("version_num").alias("t")), ["t"]).select("run_id", "section_key", "t", "version_num")


def restored_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Version 2 of every section again; a section without one is rejected."""
    v = V.versions(spark, sf)
    ok, bad = R.restore_versions(v, v.select("run_id", "section_key", F.lit(2).cast("long").alias("version_num")).distinct())
    return R.versions_newest_first(ok.select("run_id", "section_key", "version_num", "label").unionByName(bad.select("run_id", "section_key", "version_num", F.lit("rejected").alias("label"))))


def stage_progress(spark: SparkSession, sf: str) -> DataFrame:
    """E25."""
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "failed").otherwise("complete")
    runs = _orders(spark, sf).select(F.col("k").alias("run_id"), status.alias("status"), F.element_at(F.lit(STAGES), (F.col("c") % 3 + 1).cast("int")).alias("stage"))
    return R.stage_progress(runs, _stages(spark))


def resume_points(spark: SparkSession, sf: str) -> DataFrame:
    """J3 in batch form: three kinds of events are checkpoints of the stages."""
    kind = F.col("event_type")
    stage = F.when(kind == "signup", STAGES[0]).when(kind == "click", STAGES[1]).when(kind == "purchase", STAGES[2])
    e = V.t(spark, sf, "events").select(F.col("user_id").alias("run_id"), stage.alias("stage"), F.col("props").alias("output"), "event_id")
    return R.resume_points(e.filter("stage is not null"), _stages(spark), ["event_id"])


def attached_files(spark: SparkSession, sf: str) -> DataFrame:
    """A10, A8."""
    files = V.t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.concat(F.lit("up/"), F.col("l_partkey").cast("string"), F.lit(".pdf")).alias("filename"), F.when(F.col("l_suppkey") % 2 == 0, "input").otherwise("output").alias("kind"), F.col("l_quantity").alias("size"))
    return R.attach_files(_orders(spark, sf).filter("o_orderstatus <> 'P'").select(F.col("k").alias("run_id")), files)


def previews(spark: SparkSession, sf: str) -> DataFrame:
    """B18."""
    o = _orders(spark, sf)
    name = F.concat(F.lit("r"), F.col("k").cast("string"), F.when(F.col("k") % 3 == 0, "_edited.pdf").when(F.col("k") % 5 == 0, ".docx").otherwise(".PDF"))
    return R.preview_file(o.select(F.col("c").alias("run_id"), F.col("k").alias("file_id"), name.alias("filename"), F.when(F.col("k") % 2 == 0, "output").otherwise("input").alias("kind"), F.col("k").alias("ord")))


def searched_runs(spark: SparkSession, sf: str) -> DataFrame:
    """B8."""
    o = _orders(spark, sf).select("k", F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("label"), F.concat(F.lit("Run "), F.col("k").cast("string")).alias("id"))
    return R.search_all_terms(o, ["label", "id"], " run 7 HIGH").select("k", "id")


def prompt_texts(spark: SparkSession, sf: str) -> DataFrame:
    """C31."""
    p = V.t(spark, sf, "part")
    return R.prompt_override(p.select(F.col("p_name").alias("text"), F.col("p_partkey").alias("prompt_key")), p.filter("p_size > 20").select(F.col("p_partkey").alias("prompt_key"), F.when(F.col("p_size") % 2 == 0, " ").otherwise(F.col("p_brand")).alias("text")))


def gold_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The first cell whose heading and label begin with a section's, and all cells of a heading."""
    cells = V.t(spark, sf, "part").select(F.col("p_type").alias("heading"), F.col("p_brand").alias("label"), F.col("p_name").alias("text"), F.col("p_partkey").alias("ord"))
    made = "stack(4, 'a', 'econ', 'BRAND#1', 'b', 'promo', 'brand#2', 'c', 'Standard', cast(null as string), 'd', 'none', '')"
    return J.gold_lookup(cells, spark.range(1).selectExpr(f"{made} as (section, heading, label)"))


def _answers(prompts: list[str]) -> list[str]:
    """Stands for a model: the length of a prompt and its end; it fails on prompts of one word."""
    for p in prompts:
        if " " not in p:
            raise ValueError("one word")
    return [f"{len(p)}: {p[-20:]}" for p in prompts]


def model_replies(spark: SparkSession, sf: str) -> DataFrame:
    """A reply or an error to every document, asked for in batches."""
    prompts = V.t(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("prompt"))
    return J.model_map(prompts, _answers, retries=1, batch=16).select("doc_id", "reply", "error")


def section_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Rules from the size of a source's first text, else the static ones."""
    d = V.t(spark, sf, "documents")
    first = d.groupBy(F.col("source").alias("section")).agg(F.min_by("text", "doc_id").alias("text")).withColumn("text", F.when(F.col("section").endswith("1"), "").otherwise(F.regexp_replace("text", "[.!?|]", "")))
    static = d.select(F.col("source").alias("section")).distinct().withColumn("bound", F.when(~F.col("section").endswith("2"), "at most 5"))
    return J.section_bounds(first, static)[0]


def section_examples(spark: SparkSession, sf: str) -> DataFrame:
    """D35."""
    b = layouts.blocks(spark, sf)
    rows = b.select("doc_id", F.col("kind").alias("heading"), "text", F.when(F.col("what") < 3, 2).when(F.col("what") < 5, 3).alias("level"), F.when(F.col("what") > 7, 1).alias("indent"), F.col("block_no").alias("ord"))
    return J.section_examples(rows)


def cell_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Texts under the header pieces of a cell."""
    o = _orders(spark, sf)
    cell = F.concat(F.lit("Who:|"), F.col("o_orderpriority"), F.when(F.col("c") % 2 == 0, F.concat(F.lit("|"), F.col("k").cast("string"))).otherwise(""), F.lit("|why | |"), F.col("o_orderstatus"))
    cell = F.when(F.col("c") % 3 == 0, F.replace(cell, F.lit("|"), F.lit("\n"))).otherwise(cell)
    return o.select("k", F.posexplode(T.cell_subblocks(cell, ["Who", "Why"])).alias("no", "p")).select("k", "no", "p.header", "p.text")


def flat_sections(spark: SparkSession, sf: str) -> DataFrame:
    """H41."""
    section = F.struct(F.col("o_orderpriority").alias("heading"), F.when(F.col("c") % 2 == 0, F.array(F.lit("line"), F.col("k").cast("string"))).alias("content"), F.when(F.col("c") % 3 == 0, F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.col("o_orderstatus"), F.lit("d")))).alias("table"))
    return J.flatten_sections(_orders(spark, sf).select("k", F.array(section, section).alias("sections"))).select("k", "text")


def phase_lists(spark: SparkSession, sf: str) -> DataFrame:
    """K4."""
    item = F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('"'))
    value = F.when(F.col("c") % 5 == 0, F.concat(F.lit('{"equipment": ['), item, F.lit(', ""], "software": '), item, F.lit("}"))).when(F.col("c") % 5 == 1, F.concat(F.lit("["), item, F.lit("]"))).when(F.col("c") % 5 == 2, item).when(F.col("c") % 5 == 3, "null")
    return J.normalize_phases(_orders(spark, sf).select("k", value.alias("value"))).select("k", F.array_join("equipment", "|").alias("equipment"), F.array_join("software", "|").alias("software"))


def _leaves(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.concat(F.lit('{"a": {"b": ["'), F.col("o_orderpriority"), F.lit('", "x"]}, "c": "'), F.col("o_orderstatus"), F.lit('"'), F.when(F.col("c") % 2 == 0, ', "d": "t"').otherwise(""), F.lit("}"))
    return J.flatten_leaves(_orders(spark, sf).select(F.col("k").alias("run_id"), doc.alias("doc")), ["a.b", "c", "d"])


def document_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """K5, K6, K7: leaves with edited sections laid over; lists are read back into items."""
    edits = _orders(spark, sf).select(F.col("k").alias("run_id"), F.when(F.col("c") % 3 == 0, "a.b").otherwise("c").alias("section_key"), F.concat(F.lit("<ul><li>"), F.col("o_orderstatus"), F.lit("</li></ul>")).alias("html"), (F.col("c") % 4).alias("revision"))
    return J.overlay_edits(_leaves(spark, sf), edits).select("run_id", "key_path", "kind", "value", F.array_join("items", "|").alias("items"))


def review_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """K9."""
    reply = F.when(F.col("c") % 4 == 0, '{"status": "issues", "issues": ["x", "y"]}').when(F.col("c") % 4 == 1, '{"issues": ["x"]}').when(F.col("c") % 4 == 2, 'Here: {"status": "ok"}').otherwise("junk")
    return J.review_outcome(_orders(spark, sf).select("k", reply.alias("reply"))).select("k", "status", F.size("issues").alias("n"), "message")


def page_replies(spark: SparkSession, sf: str) -> DataFrame:
    """K10."""
    reply = F.when(F.col("c") % 3 == 0, F.concat(F.lit('```json\n{"text": "'), F.col("o_orderstatus"), F.lit('", "tables": [{"caption": "t", "bbox_norm": [0.1], "data": [["a"]]}], "page_w_pts": 300.5}\n```'))).otherwise("failed")
    p = J.page_results(_orders(spark, sf).select(F.col("k").alias("doc_id"), F.lit(0).alias("page_idx"), reply.alias("reply")))
    return p.select("doc_id", "page_idx", "text", F.size("images").alias("n_images"), F.size("tables").alias("n_tables"), "page_w_pts", "page_h_pts")


def accepted_formulas(spark: SparkSession, sf: str) -> DataFrame:
    """Formulas with an anchor or a section, and how many were turned down for what."""
    b = layouts.blocks(spark, sf)
    verdicts = b.select("doc_id", "page_idx", "id", (F.col("number") > 2).alias("is_equation"), F.when(F.col("italic"), "text").alias("reason"))
    anchors = b.filter("what < 5").select("doc_id", "page_idx", "id", F.col("text").alias("anchor"))
    sections = b.filter("what in (5, 6)").select("doc_id", "page_idx", "id", F.lit("s").alias("section"))
    ok, bad = J.accepted_formulas(verdicts, anchors, sections)
    return ok.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit("accepted").alias("what"), "n").unionByName(bad.select("doc_id", F.col("reason").alias("what"), "n"))


def manual_fields(spark: SparkSession, sf: str) -> DataFrame:
    """K13."""
    o = _orders(spark, sf)
    reports_ = o.select(F.col("k").alias("run_id"), F.col("o_orderpriority").alias("title"), F.lit(False).alias("done"))
    one = lambda field, value, keep: o.filter(keep).select(F.col("k").alias("run_id"), F.lit(field).alias("field"), value.alias("value"))
    fields = one("t", F.concat(F.lit("T"), F.col("k").cast("string")), "c % 2 = 0").unionByName(one("d", F.when(F.col("c") % 6 < 3, " Yes").otherwise("no"), "c % 3 = 0")).unionByName(one("zz", F.lit("x"), "c % 5 = 0"))
    return J.apply_manual_fields(reports_, fields, {"t": "title", "d": "done"}, flags=("done",))


def paired_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Objects by their keys, arrays of two by place; others are dropped."""
    s = F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit('"'))
    doc = F.concat(F.lit('{"t": [{"problem": '), s, F.lit(', "fix": "f"}, ["a", '), s, F.lit('], ["x"], 3'), F.when(F.col("c") % 2 == 0, ', {"fix": "g"}').otherwise(""), F.lit("]}"))
    return J.pair_lists(_orders(spark, sf).select(F.col("k").alias("run_id"), doc.alias("doc")), "$.t", "problem", "fix")


def audit_records(spark: SparkSession, sf: str) -> DataFrame:
    """Ids, rows and flags of each request in one record; content hashes as in ``content_hash``."""
    o = _orders(spark, sf)
    r = ids.request_id(F.concat(F.lit("no "), F.lpad(F.col("k").cast("string"), 6, "0")), query_prefix="Q-", display_prefix="D-")
    known = o.select(F.col("k").alias("request_id"), r["display"].alias("display"), r["query"].alias("query"))
    counts = V.t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("request_id")).agg(F.count("*").alias("n"))
    hashes = o.select(F.col("k").alias("request_id"), F.sha2(F.col("k").cast("string"), 256).alias("content_hash"))
    flags = V.t(spark, sf, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("request_id"))
    return C.audit_record(known, counts, hashes, flags).select("request_id", "record.*")


def stitched_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Uncaptioned tables take the caption of one stitched up to two pages back, whichever of its tables covers them."""
    b = layouts.blocks(spark, sf)
    tables = b.select("doc_id", F.col("block_no").alias("page_idx"), "id", F.when(F.col("what") < 3, F.col("number").cast("string")).alias("ref"), "x0", "x1", F.col("italic").alias("near_figure"))
    return L.stitch_table_pages(tables, every=True).select("doc_id", "id", "stitched_ref")


_NAMES = (
    version_numbers, restored_versions, stage_progress, resume_points, attached_files, previews, searched_runs, prompt_texts, gold_texts, model_replies, section_bounds, section_examples, cell_headers, flat_sections, phase_lists, document_leaves,
    review_outcomes, page_replies, accepted_formulas, manual_fields, paired_entries, audit_records, stitched_tables,
)
QUERIES = {f.__name__: f for f in _NAMES}

_O = "o AS (SELECT *, o_orderkey AS k, o_custkey AS c FROM orders)"
_STAGE = "CASE {} WHEN 0 THEN 'ingest' WHEN 1 THEN 'outline' ELSE 'build' END"
_B = layouts._B
_STRIP = "' ' || chr(10) || chr(13) || chr(9)"
_LINE_COLUMNS = sorted(["request_id", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"])
_AS_JSON = {"request_id": "l_orderkey", "l_returnflag": "'\"' || l_returnflag || '\"'", "l_linestatus": "'\"' || l_linestatus || '\"'", "l_shipdate": "'\"' || strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%g') || '\"'"}
_ROW_JSON = " || ',' || ".join(f"'\"{c}\":' || {_AS_JSON.get(c, c)}" for c in _LINE_COLUMNS)
_ALLOWED = "'queued', 'running'"
ORACLE_SQL = {
    "version_numbers": f"WITH {V.SQL['versions']} SELECT run_id, section_key, version_num AS t, version_num FROM versions WHERE version_num > 2",
    "restored_versions": f"""WITH {V.SQL['versions']}, s AS (SELECT run_id, section_key, max(version_num) AS n FROM versions GROUP BY 1, 2) SELECT run_id, section_key, CASE WHEN n >= 2 THEN n + 1 ELSE 2 END AS version_num, CASE WHEN n >= 2 THEN 'Restored v2' ELSE 'rejected' END AS label FROM s""",
    "stage_progress": f"""WITH {_O}, s AS (SELECT unnest(range(3))::INTEGER AS ord) SELECT k AS run_id, {_STAGE.format('ord')} AS stage, ord, CASE WHEN o_orderstatus NOT IN ('O', 'F') OR ord < c % 3 THEN 'complete' WHEN o_orderstatus = 'F' AND ord = c % 3 THEN 'invalid' ELSE 'incomplete' END AS state FROM o, s""",
    "resume_points": f"""WITH e AS (SELECT DISTINCT user_id AS run_id, CASE event_type WHEN 'signup' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END AS s FROM events WHERE event_type IN ('signup', 'click', 'purchase')), d AS (SELECT run_id, list({_STAGE.format('s')} ORDER BY {_STAGE.format('s')}) AS done, list(s) AS n FROM e GROUP BY 1)
SELECT run_id, done, CASE WHEN NOT list_contains(n, 0) THEN 'ingest' WHEN NOT list_contains(n, 1) THEN 'outline' WHEN NOT list_contains(n, 2) THEN 'build' END AS resume_at FROM d""",
    "attached_files": "SELECT l_orderkey AS run_id, 'up/' || l_partkey || '.pdf' AS filename, CASE WHEN l_suppkey % 2 = 0 THEN 'input' ELSE 'output' END AS kind, CAST(l_quantity AS BIGINT) AS size, l_orderkey || CASE WHEN l_suppkey % 2 = 0 THEN '/input/' ELSE '/output/' END || l_partkey || '.pdf' AS key FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')",
    "previews": f"WITH {_O} SELECT c AS run_id, min(k) AS file_id, 'r' || min(k) || '.PDF' AS filename FROM o WHERE k % 2 = 0 AND k % 3 <> 0 AND k % 5 <> 0 GROUP BY 1",
    "searched_runs": f"WITH {_O} SELECT k, 'Run ' || k AS id FROM o WHERE contains(lower(o_orderpriority || ' ' || o_orderstatus || ' Run ' || k), '7') AND contains(lower(o_orderpriority), 'high')",
    "prompt_texts": "SELECT p_partkey AS prompt_key, CASE WHEN p_size > 20 AND p_size % 2 <> 0 THEN p_brand ELSE p_name END AS text, p_size > 20 AND p_size % 2 <> 0 AS overridden FROM part",
    "gold_texts": """SELECT 'a' AS section, arg_min(p_name, p_partkey) AS text FROM part WHERE starts_with(lower(p_type), 'econ') AND starts_with(lower(p_brand), 'brand#1') HAVING count(*) > 0 UNION ALL SELECT 'b', arg_min(p_name, p_partkey) FROM part WHERE starts_with(lower(p_type), 'promo') AND starts_with(lower(p_brand), 'brand#2') HAVING count(*) > 0
UNION ALL SELECT 'c', string_agg(p_name, chr(10) ORDER BY p_partkey) FROM part WHERE starts_with(lower(p_type), 'standard') HAVING count(*) > 0""",
    "model_replies": "SELECT doc_id, CASE WHEN contains(coalesce(text, ''), ' ') THEN length(text) || ': ' || right(text, 20) END AS reply, CASE WHEN NOT contains(coalesce(text, ''), ' ') THEN 'ValueError: one word' END AS error FROM documents",
    "section_bounds": f"""WITH f AS (SELECT source AS section, regexp_replace(arg_min(text, doc_id), '[.!?|]', '', 'g') AS t FROM documents GROUP BY 1), g AS (SELECT section, CASE WHEN section LIKE '%1' THEN '' ELSE trim(t, {_STRIP}) END AS s FROM f),
n AS (SELECT *, CASE WHEN s <> '' THEN 'about 1 sentences and ' || greatest(1, len(list_filter(string_split(s, chr(10)), lambda x: trim(x, {_STRIP}) <> ''))) || ' items, at most ' || CAST(ceil(length(s)::DOUBLE * 1.2::DOUBLE) AS BIGINT) || ' characters' END AS derived FROM g)
SELECT section, coalesce(derived, CASE WHEN section NOT LIKE '%2' THEN 'at most 5' END) AS bound FROM n WHERE derived IS NOT NULL OR section NOT LIKE '%2'""",
    "section_examples": f"WITH {_B} SELECT doc_id, kind AS heading, string_agg(CASE WHEN what < 3 THEN '## ' WHEN what < 5 THEN '### ' ELSE '' END || CASE WHEN what > 7 THEN '  ' ELSE '' END || text, chr(10) ORDER BY block_no) AS example FROM b GROUP BY 1, 2",
    "cell_headers": f"WITH {_O} SELECT k, 0 AS no, 'Who' AS header, o_orderpriority || CASE WHEN c % 2 = 0 THEN chr(10) || k ELSE '' END AS text FROM o UNION ALL SELECT k, 1, 'why', o_orderstatus FROM o",
    "flat_sections": f"WITH {_O}, s AS (SELECT k, '# ' || o_orderpriority || CASE WHEN c % 2 = 0 THEN chr(10) || 'line' || chr(10) || k ELSE '' END || CASE WHEN c % 3 = 0 THEN chr(10) || 'a | b' || chr(10) || o_orderstatus || ' | d' ELSE '' END AS t FROM o) SELECT k, t || chr(10) || t AS text FROM s",
    "phase_lists": f"WITH {_O} SELECT k, CASE WHEN c % 5 < 3 THEN o_orderpriority ELSE '' END AS equipment, CASE WHEN c % 5 = 0 THEN o_orderpriority ELSE '' END AS software FROM o",
    "document_leaves": f"""WITH {_O}, l AS (SELECT k, c, o_orderstatus AS s, 'a.b' AS key_path, 'list' AS kind, '<ul><li>' || o_orderpriority || '</li><li>x</li></ul>' AS value, o_orderpriority || '|x' AS items FROM o UNION ALL SELECT k, c, o_orderstatus, 'c', 'text', o_orderstatus, NULL FROM o UNION ALL SELECT k, c, o_orderstatus, 'd', 'text', 't', NULL FROM o WHERE c % 2 = 0),
e AS (SELECT *, c % 4 > 1 AND key_path = CASE WHEN c % 3 = 0 THEN 'a.b' ELSE 'c' END AS edited FROM l) SELECT k AS run_id, key_path, kind, CASE WHEN edited THEN '<ul><li>' || s || '</li></ul>' ELSE value END AS value, CASE WHEN edited AND kind = 'list' THEN s ELSE items END AS items FROM e""",
    "review_outcomes": f"WITH {_O} SELECT k, CASE WHEN c % 4 = 0 THEN 'issues' ELSE 'ok' END AS status, CASE WHEN c % 4 = 0 THEN 2 ELSE 0 END AS n, CASE WHEN c % 4 = 0 THEN '2 issue(s)' ELSE 'no issues' END AS message FROM o",
    "page_replies": f"WITH {_O} SELECT k AS doc_id, 0 AS page_idx, CASE WHEN c % 3 = 0 THEN o_orderstatus ELSE '' END AS text, 0 AS n_images, CASE WHEN c % 3 = 0 THEN 1 ELSE 0 END AS n_tables, CASE WHEN c % 3 = 0 THEN 300.5 ELSE 595.0 END::DOUBLE AS page_w_pts, 842.0::DOUBLE AS page_h_pts FROM o",
    "accepted_formulas": f"WITH {_B} SELECT doc_id, 'accepted' AS what, count(*) AS n FROM b WHERE number > 2 AND what < 7 GROUP BY 1 UNION ALL SELECT doc_id, CASE WHEN italic THEN 'text' ELSE 'none' END, count(*) FROM b WHERE number <= 2 GROUP BY 1, 2",
    "manual_fields": f"WITH {_O} SELECT k AS run_id, CASE WHEN c % 2 = 0 THEN 'T' || k ELSE o_orderpriority END AS title, c % 3 = 0 AND c % 6 < 3 AS done FROM o",
    "paired_entries": f"WITH {_O} SELECT k AS run_id, 0 AS ord, o_orderstatus AS problem, 'f' AS fix FROM o UNION ALL SELECT k, 1, 'a', o_orderstatus FROM o UNION ALL SELECT k, 4, NULL, 'g' FROM o WHERE c % 2 = 0",
    "audit_records": f"""WITH {_O}, n AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_quantity > 40) AS f FROM lineitem GROUP BY 1) SELECT k AS request_id, 'D-' || lpad(CAST(k AS VARCHAR), 6, '0') AS display, 'Q-' || lpad(CAST(k AS VARCHAR), 6, '0') AS query, coalesce(n, 0) AS rows, sha256(CAST(k AS VARCHAR)) AS content_hash, coalesce(f, 0) AS flags FROM o LEFT JOIN n ON l_orderkey = k""",
    "stitched_tables": f"""WITH RECURSIVE {_B}, t AS (SELECT doc_id, block_no AS p, id, CASE WHEN what < 3 THEN CAST(number AS VARCHAR) END AS ref, x0, x1, italic FROM b),
s AS (SELECT doc_id, p, id, ref, x0, x1, NULL::VARCHAR AS r1, NULL::DOUBLE AS a1, NULL::DOUBLE AS z1 FROM t WHERE p = 1 UNION ALL
 SELECT t.doc_id, t.p, t.id, coalesce(t.ref, CASE WHEN NOT t.italic THEN CASE WHEN s.ref IS NOT NULL AND (least(s.x1, t.x1) - greatest(s.x0, t.x0)) / (t.x1 - t.x0) >= 0.5 THEN s.ref WHEN s.r1 IS NOT NULL AND (least(s.z1, t.x1) - greatest(s.a1, t.x0)) / (t.x1 - t.x0) >= 0.5 THEN s.r1 END END), t.x0, t.x1, s.ref, s.x0, s.x1 FROM s JOIN t ON t.doc_id = s.doc_id AND t.p = s.p + 1)
SELECT doc_id, id, ref AS stitched_ref FROM s""",
    "content_hash": f"""WITH h AS (SELECT l_orderkey AS request_id, sha256('{{' || {_ROW_JSON} || '}}') AS h FROM lineitem) SELECT request_id, sha256(concat_ws(',', count(*), {', '.join(f"sum(CAST('0x' || substring(h, {1 + 15 * k}, 15) AS BIGINT))" for k in range(4))})) AS content_hash, count(*) AS n_rows FROM h GROUP BY 1""",
    "section_edits": f"""WITH RECURSIVE {V.SQL['versions']}, e AS (SELECT run_id, section_key, version_num AS n, version_num - CASE WHEN version_num % 4 = 3 THEN 1 ELSE 0 END AS rev FROM versions),
s AS (SELECT run_id, section_key, n, rev, 1 AS met, CASE WHEN rev = 1 THEN 2 ELSE 1 END AS now_at FROM e WHERE n = 1 UNION ALL SELECT e.run_id, e.section_key, e.n, e.rev, s.now_at, CASE WHEN e.rev = s.now_at THEN s.now_at + 1 ELSE s.now_at END FROM s JOIN e ON e.run_id = s.run_id AND e.section_key = s.section_key AND e.n = s.n + 1)
SELECT run_id, section_key, CAST(now_at AS BIGINT) AS version_num, 'Edited (v' || now_at || ')' AS label FROM s WHERE rev = met""",
    "run_state": f"""WITH RECURSIVE {V.SQL['events']}, e AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ev_at, event_id) AS n FROM run_events),
s AS (SELECT run_id, n, status, ev_at, status IN ({_ALLOWED}) AS ok, CASE WHEN status IN ({_ALLOWED}) THEN status ELSE '' END AS state FROM e WHERE n = 1 UNION ALL
 SELECT e.run_id, e.n, e.status, e.ev_at, f.ok, CASE WHEN f.ok THEN e.status ELSE s.state END FROM s JOIN e ON e.run_id = s.run_id AND e.n = s.n + 1, LATERAL (SELECT CASE s.state WHEN '' THEN e.status IN ({_ALLOWED}) WHEN 'queued' THEN e.status IN ('running', 'failed') WHEN 'running' THEN e.status IN ('awaiting_user', 'complete', 'failed', 'queued') WHEN 'awaiting_user' THEN e.status IN ('queued', 'running', 'complete', 'failed') WHEN 'failed' THEN e.status = 'queued' ELSE false END AS ok) f),
g AS (SELECT run_id, arg_max(state, n) AS status, min(ev_at) FILTER (WHERE ok AND status = 'running') AS started_at, max(ev_at) FILTER (WHERE ok AND status IN ('complete', 'failed')) AS ended_at FROM s GROUP BY 1)
SELECT run_id, status, started_at, ended_at, CASE WHEN status = 'complete' THEN 100 END AS progress, epoch_us(ended_at) // 1000 - epoch_us(started_at) // 1000 AS duration_ms FROM g""",
    "sub_item_path": f"""WITH {V.SQL['lines']}, m AS (SELECT doc_id, page_idx, block_no, CASE WHEN block_no % 5 = 0 THEN 'a) ' || text WHEN block_no % 5 = 2 THEN '1) ' || text ELSE text END AS text FROM page_lines),
l AS (SELECT *, CASE WHEN regexp_matches(text, '^[a-z]\\)\\s+') THEN 0 WHEN regexp_matches(text, '^[0-9]+\\)\\s+') THEN 1 WHEN regexp_matches(text, '(?i)^[ivxlcdm]+\\)\\s+') THEN 2 END AS level, regexp_extract(text, '^([^)]*)\\)', 1) AS mark FROM m),
p AS (SELECT *, max(CASE WHEN level = 0 THEN block_no END) OVER w AS b0, max(CASE WHEN level = 1 THEN block_no END) OVER w AS b1, max(CASE WHEN level = 2 THEN block_no END) OVER w AS b2 FROM l WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY block_no ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, CASE WHEN b1 > b0 THEN b1 END AS c1, CASE WHEN b2 > greatest(b0, coalesce(b1, -1)) THEN b2 END AS c2 FROM p)
SELECT q.doc_id, q.page_idx::INTEGER AS page_idx, q.block_no::INTEGER AS block_no, CASE WHEN b0 IS NULL THEN '' WHEN c1 IS NULL THEN m0.mark WHEN c2 IS NULL THEN m0.mark || '.' || m1.mark ELSE m0.mark || '.' || m1.mark || '.' || m2.mark END AS path FROM q LEFT JOIN l m0 ON m0.doc_id = q.doc_id AND m0.page_idx = q.page_idx AND m0.block_no = b0
LEFT JOIN l m1 ON m1.doc_id = q.doc_id AND m1.page_idx = q.page_idx AND m1.block_no = c1 LEFT JOIN l m2 ON m2.doc_id = q.doc_id AND m2.page_idx = q.page_idx AND m2.block_no = c2""",
    "outline_candidates": f"""WITH {V.SQL['outline']}, s AS (SELECT doc_id, ord, page, trim(title) AS t, regexp_extract(trim(title), '^(\\d+(?:\\.\\d+)*)\\s+(\\S.*)$', 1) AS num, trim(regexp_extract(trim(title), '^(\\d+(?:\\.\\d+)*)\\s+(\\S.*)$', 2)) AS tail, title FROM outline),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, num ORDER BY page, ord) AS k FROM s WHERE length(t) BETWEEN 3 AND 120 AND num <> '' AND NOT regexp_matches(tail, '^[\\d\\s.,;%()+-]+$') AND CAST(split_part(num, '.', 1) AS INTEGER) <= 30 AND (contains(num, '.') OR (regexp_matches(tail, '^\\p{{Lu}}') AND length(t) <= 80)) AND NOT regexp_matches(substring(title, 1, 120), '(?i)Copyrighted material|licensed to|Techstreet'))
SELECT doc_id, len(string_split(num, '.'))::INTEGER AS level, t AS title, page::INTEGER AS page FROM f WHERE k = 1""",
    "box_clusters": f"""WITH RECURSIVE {V.SQL['boxes']}, b AS (SELECT page_idx, id, x0 * 4000 AS x0, y0 * 4000 AS y0, x1 * 4000 AS x1, y1 * 4000 AS y1 FROM boxes), w AS (SELECT * FROM b WHERE x1 - x0 > 3 AND y1 - y0 > 3),
l AS (SELECT a.page_idx, a.id AS x, c.id AS y FROM w a JOIN w c ON a.page_idx = c.page_idx AND a.x0 - 1 <= c.x1 AND c.x0 - 1 <= a.x1 AND a.y0 - 1 <= c.y1 AND c.y0 - 1 <= a.y1), r AS (SELECT page_idx, id AS x, id AS y FROM w UNION SELECT r.page_idx, r.x, l.y FROM r JOIN l ON l.page_idx = r.page_idx AND l.x = r.y)
SELECT page_idx, x AS id, min(y) AS cluster FROM r GROUP BY 1, 2""",
    "sanitize_html": """WITH p AS (SELECT page_id, regexp_extract_all(html, '(?s)<!--.*?-->|</?[a-zA-Z](?:[^>"'']|"[^"]*"|''[^'']*'')*>|<[!?/][^>]*>|[^<]+|<') AS l FROM pages),
t AS (SELECT page_id, list_transform(l, lambda x: struct_pack(x := x, n := lower(regexp_extract(x, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)))) AS l FROM p)
SELECT page_id, array_to_string(list_transform(l, lambda s: CASE WHEN s.x = '<' THEN '&lt;' WHEN s.n <> '' THEN CASE WHEN s.n NOT IN ('p', 'br', 'div', 'ul', 'ol', 'li', 'b', 'strong', 'i', 'em', 'u') OR (starts_with(s.x, '</') AND s.n = 'br') THEN '' WHEN starts_with(s.x, '</') THEN '</' || s.n || '>'
 ELSE '<' || s.n || CASE WHEN s.n = 'li' AND regexp_matches(s.x, '(?i)\\sdata-list\\s*=') THEN ' data-list="' || regexp_extract(s.x, '(?i)\\sdata-list\\s*=\\s*["'']?([^"''>\\s]*)', 1) || '"' ELSE '' END || '>' END WHEN starts_with(s.x, '<') THEN ''
 ELSE replace(replace(replace(regexp_replace(s.x, '&([a-zA-Z0-9#]+;)', chr(1) || '\\1', 'g'), '&', '&amp;'), chr(1), '&'), '>', '&gt;') END), '') AS clean_html FROM t""",
}
