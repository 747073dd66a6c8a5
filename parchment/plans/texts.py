"""Queries of records, page texts, outlines, layout and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchment.functions import text as T
from parchment.operators import compare as C
from parchment.operators import jobs as J
from parchment.operators import layout as L
from parchment.operators import outline as O
from parchment.operators import pages as P
from parchment.operators import records as R
from parchment.operators.helpers import gap_groups

from . import views as V

SECTIONS = ["purpose", "scope", "equipment", "safety", "procedure", "troubleshooting"]
BOX_KEYS = ["page_idx"]


def history_page(spark: SparkSession, sf: str) -> DataFrame:
    return R.history(V.runs(spark, sf), V.users(spark, sf), sort="name", descending=False, page=2, status="O", title="high").select("run_id", "username", "title", "status")


def history_total(spark: SparkSession, sf: str) -> DataFrame:
    return R.history_total(V.runs(spark, sf), V.users(spark, sf), status="O", title="high")


def section_latest(spark: SparkSession, sf: str) -> DataFrame:
    return R.current_sections(V.versions(spark, sf))


def fork_sections(spark: SparkSession, sf: str) -> DataFrame:
    runs = V.runs(spark, sf)
    sections = R.current_sections(V.versions(spark, sf)).select("run_id", "section_key", "html")
    none = spark.range(0)
    wanted = runs.select("run_id", (F.col("run_id") + 1_000_000).alias("new_id"))
    return R.fork_runs(runs, none.selectExpr("id as run_id", "'x' as filename", "'input' as kind"), none.selectExpr("id as run_id", "'x' as stage"), sections, wanted)["versions"]


def section_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Edits of every section: each version is offered again under revision turn % 3."""
    v = V.versions(spark, sf)
    current = R.current_sections(v.filter("version_num <= 1"))
    edits = v.select("run_id", "section_key", F.col("version_num").alias("ord"), (F.col("version_num") - F.when(F.col("version_num") % 4 == 3, 1).otherwise(0)).alias("revision"), "html")
    return R.apply_edits(current, edits)[0].select("run_id", "section_key", "version_num", "label")


def section_tree(spark: SparkSession, sf: str) -> DataFrame:
    tree = R.section_tree(R.current_sections(V.versions(spark, sf)).withColumn("section_key", F.concat(F.lit("body."), "section_key")))
    return tree.select("run_id", "top", F.transform("leaves", lambda x: F.concat_ws(":", x["section_key"], x["label"], x["edited"].cast("string"))).alias("leaves"))


def latest_status(spark: SparkSession, sf: str) -> DataFrame:
    return R.latest_status(V.events(spark, sf), ["at", "event_id"]).select("run_id", "status")


def run_state(spark: SparkSession, sf: str) -> DataFrame:
    return R.run_state(V.events(spark, sf), ["at", "event_id"])[0]


def stale_runs(spark: SparkSession, sf: str) -> DataFrame:
    e = V.events(spark, sf)
    now = F.to_timestamp(F.lit("2030-01-01"))
    return R.stale_runs(R.latest_status(e, ["at", "event_id"]), e, now).select("run_id")


def garble_pages(spark: SparkSession, sf: str) -> DataFrame:
    return P.page_verdicts(V.pages(spark, sf)).select("doc_id", "page_idx", "checked", "garble_check", F.round(F.col("cipher_ratio"), 6).alias("cipher_ratio"))


def garble_docs(spark: SparkSession, sf: str) -> DataFrame:
    return P.doc_garble(V.pages(spark, sf))


def verdict_vote(spark: SparkSession, sf: str) -> DataFrame:
    v = V.t(spark, sf, "labels").select((F.col("doc_id") % 20).alias("doc_id"), (F.col("quality") == 0).alias("garbled"), F.when(F.col("toxic") == 1, 0.5).otherwise(0.9).alias("confidence"))
    return P.verdict_vote(v)


def caption_mentions(spark: SparkSession, sf: str) -> DataFrame:
    lines = V.page_lines(spark, sf)
    found = lines.select("doc_id", "page_idx", "block_no", T.figure_number(F.col("text")).alias("figure"), T.table_ref(F.col("text")).alias("table_ref"), F.size(T.mentions(F.col("text"))).alias("n_mentions"))
    return found.filter("n_mentions > 0")


def block_filter(spark: SparkSession, sf: str) -> DataFrame:
    return P.block_filter(V.page_lines(spark, sf)).groupBy("doc_id", F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def footnote_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    lines = V.page_lines(spark, sf).withColumn("section", F.floor(F.col("page_idx") / 10))
    return P.footnote_dedupe(lines).filter("text rlike '^a  '").select("doc_id", "section", "text")


def place_media(spark: SparkSession, sf: str) -> DataFrame:
    lines = V.page_lines(spark, sf).withColumn("ord", F.col("page_idx").cast("long") * 100_000 + F.col("block_no"))
    media = V.pages(spark, sf).select("doc_id", F.lit("figure").alias("kind"), F.col("page_idx").cast("string").alias("ref"))
    return P.place_media(lines, media)


def sub_item_path(spark: SparkSession, sf: str) -> DataFrame:
    lines = V.page_lines(spark, sf)
    b = F.col("block_no")
    marked = lines.withColumn("text", F.when(b % 5 == 0, F.concat(F.lit("a) "), "text")).when(b % 5 == 2, F.concat(F.lit("1) "), "text")).otherwise(F.col("text"))).withColumn("section", F.lit("1"))
    return P.sub_item_path(marked).select("doc_id", "page_idx", "block_no", "path")


def text_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = T.text_metrics(F.col("text"))
    return V.t(spark, sf, "documents").select("doc_id", m["chars"].alias("chars"), m["items"].alias("items"))


def outline_candidates(spark: SparkSession, sf: str) -> DataFrame:
    lines = V.outline(spark, sf).select("doc_id", (F.col("page") - 1).alias("page_idx"), F.col("ord").alias("line_no"), F.col("title").alias("text"))
    return O.heading_candidates(lines).select("doc_id", "level", "title", "page")


def outline_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return O.dedupe_outline(V.outline(spark, sf))


def outline_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    return O.hierarchy_valid(V.outline(spark, sf))


def section_ranges(spark: SparkSession, sf: str) -> DataFrame:
    n = V.pages(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    return O.section_ranges(V.outline(spark, sf), n).select("doc_id", "ord", "first_page", "end_page")


def section_of_page(spark: SparkSession, sf: str) -> DataFrame:
    items = V.pages(spark, sf).select("doc_id", "page_idx", (F.col("page_idx") + 1).alias("page"))
    return O.section_of(items, V.outline(spark, sf)).select("doc_id", "page_idx", "title")


def title_to_page(spark: SparkSession, sf: str) -> DataFrame:
    pages = V.pages(spark, sf)
    items = V.t(spark, sf, "benchmark").select(F.col("item_id").alias("ord"), F.substring_index("text", "\n", 1).alias("title"))
    return O.title_to_page(items, pages).select("doc_id", "ord", "page_idx")


def box_overlap(spark: SparkSession, sf: str) -> DataFrame:
    b = V.boxes(spark, sf).drop("doc_id")
    return L.overlap_pairs(b.filter("id % 2 = 0"), b.filter("id % 2 = 1"), 0.5, BOX_KEYS).select("page_idx", "a_id", "b_id", F.round("share", 6).alias("share"))


def best_box_match(spark: SparkSession, sf: str) -> DataFrame:
    b = V.boxes(spark, sf).drop("doc_id")
    return L.best_box_match(b.filter("id % 2 = 0"), b.filter("id % 2 = 1"), keys=BOX_KEYS).select("page_idx", "id", "match")


def box_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return gap_groups(V.boxes(spark, sf), ["page_idx"], "y0", "y1", 0.001).select("page_idx", "id", "group_no")


def box_clusters(spark: SparkSession, sf: str) -> DataFrame:
    b = V.boxes(spark, sf)
    scaled = b.select("doc_id", "page_idx", "id", *[(F.col(c) * 4000).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return L.cluster_boxes(scaled, gap=1.0).select("page_idx", "id", "cluster")


def html_items(spark: SparkSession, sf: str) -> DataFrame:
    return V.t(spark, sf, "pages").select("page_id", J.html_items(F.col("html")).alias("items"))


def sanitize_html(spark: SparkSession, sf: str) -> DataFrame:
    return J.sanitize_html(V.t(spark, sf, "pages")).select("page_id", "clean_html")


def fan_out(spark: SparkSession, sf: str) -> DataFrame:
    tasks = J.fan_out(V.t(spark, sf, "documents").select("doc_id", "source"), SECTIONS)
    return J.assemble_prompt(tasks.withColumn("bound", F.lit("at most 5")), ["section", "bound", "source"]).select("doc_id", "section_no", "section", "prompt")


def parse_responses(spark: SparkSession, sf: str) -> DataFrame:
    """K3 over a fenced reply, one with words around it and, every third, a broken one."""
    e = V.t(spark, sf, "events")
    reply = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here it is: "), "props")).otherwise(F.translate("props", "{}", "()"))
    return J.parse_replies(e.select("event_id", reply.alias("reply"))).select("event_id", "reason", "truncated")


def dataset_diff(spark: SparkSession, sf: str) -> DataFrame:
    d = V.t(spark, sf, "documents").select("doc_id", "lang", "source")
    changed = d.filter("doc_id % 10 <> 3").withColumn("lang", F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang")))
    return C.dataset_diff(d, changed, ["doc_id"], soft=("lang",))


def _two_versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A source's documents as headings; then some left out, some moved to the front and some put in."""
    d = V.t(spark, sf, "documents").select("source", F.col("doc_id").alias("ord"), F.concat(F.lit("H"), F.col("doc_id").cast("string")).alias("title"))
    changed = d.filter("ord % 11 <> 0").withColumn("ord", F.when(F.col("ord") % 13 == 5, F.col("ord") - 10_000_000_000).otherwise(F.col("ord")))
    return d, changed.unionByName(d.filter("ord % 17 = 0").withColumn("title", F.concat(F.lit("new "), "title")))


def heading_changes(spark: SparkSession, sf: str) -> DataFrame:
    """G3."""
    return C.heading_changes(*_two_versions(spark, sf), "source").groupBy("source", "change").agg(F.count("*").alias("n"))


def ordered_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """The share of cells in their order."""
    out = C.ordered_similarity(*_two_versions(spark, sf), "source", "title", ["ord"])
    return out.select("source", F.round("similarity", 9).alias("similarity"), "equal")


def multiset_diff(spark: SparkSession, sf: str) -> DataFrame:
    d = V.t(spark, sf, "documents")
    return C.multiset_diff(d.select("source", "lang"), d.filter("doc_id % 10 <> 3").select("source", "lang")).groupBy("source", "lang", "side").agg(F.count("*").alias("n"))


def cell_similarity(spark: SparkSession, sf: str) -> DataFrame:
    p = V.pages(spark, sf)
    words = p.select("doc_id", "page_idx", F.explode(F.split("text", " ")).alias("word"))
    out = C.cell_similarity(words.filter("page_idx % 2 = 0"), words.filter("page_idx % 2 = 1"), "doc_id", "word")
    return out.select("doc_id", F.round("similarity", 9).alias("similarity"), "equal")


def reply_stream_order(spark: SparkSession, sf: str) -> DataFrame:
    """First and last event of each run by one window pass."""
    e = V.events(spark, sf)
    w = Window.partitionBy("run_id").orderBy("at", "event_id")
    return e.withColumn("k", F.row_number().over(w)).groupBy("run_id").agg(F.min_by("event_id", "k").alias("first_event"), F.max_by("event_id", "k").alias("last_event"))


_NAMES = (
    history_page, history_total, section_latest, fork_sections, section_edits, section_tree, latest_status, run_state, stale_runs, garble_pages, garble_docs, verdict_vote, caption_mentions, block_filter, footnote_dedupe,
    place_media, sub_item_path, text_metrics, outline_candidates, outline_dedupe, outline_hierarchy, section_ranges, section_of_page, title_to_page, box_overlap, best_box_match, box_gaps, box_clusters, html_items,
    sanitize_html, fan_out, parse_responses, dataset_diff, heading_changes, ordered_similarity, multiset_diff, cell_similarity, reply_stream_order,
)
QUERIES = {f.__name__: f for f in _NAMES}

_RUNS = "runs AS (SELECT o_orderkey AS run_id, c_name AS username, o_orderpriority || o_orderkey AS title, o_orderstatus AS status, o_orderdate AS started_at FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' AND o_orderpriority || o_orderkey ILIKE '%high%')"
_BOX = f"WITH {V.SQL['boxes']}, a AS (SELECT * FROM boxes WHERE id % 2 = 0), b AS (SELECT * FROM boxes WHERE id % 2 = 1), j AS (SELECT a.page_idx, a.id AS a_id, b.id AS b_id, (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ab, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS o FROM a JOIN b USING (page_idx))"
_WORDS = ", ".join(f"'{w}'" for w in T.COMMON_WORDS)
_GARBLE = f"""{V.SQL['pages']}, tk AS (SELECT doc_id, page_idx, text, list_filter(regexp_split_to_array(trim(text), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '') AS raw FROM page_text),
tok AS (SELECT *, list_filter(list_transform(raw, lambda w: lower(regexp_replace(w, '^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$', '', 'g'))), lambda w: w <> '') AS tokens FROM tk),
al AS (SELECT *, list_filter(tokens, lambda w: regexp_full_match(w, '\\pL{{2,}}')) AS alpha, list_filter(raw, lambda w: NOT regexp_matches(w, '(?i)https?://|www\\.|@|\\.com|\\.org|\\.iso\\.|techstreet')) AS plain FROM tok),
v AS (SELECT doc_id, page_idx, length(trim(text)) >= 10 AS checked, CASE WHEN length(trim(text)) < 10 THEN NULL WHEN length(trim(text)) < 20 THEN 'short'
 WHEN length(regexp_replace(text, '[^\\pC\\p{{Zl}}\\p{{Zp}}]|[\\n\\r\\t]', '', 'g')) / length(text) > 0.4 THEN 'unprintable' WHEN len(tokens) = 0 OR len(alpha) / len(tokens) < 0.30 THEN 'letters'
 WHEN len(alpha) > 10 AND len(list_filter(alpha, lambda w: w IN ({_WORDS}))) / len(alpha) < 0.03 THEN 'words'
 WHEN len(list_filter(raw, lambda w: regexp_matches(w, '[A-Z][>:<^@=\\\\]{{1,2}}[A-Z]'))) / len(raw) > 0.08 THEN 'pattern' END AS garble_check,
 CASE WHEN length(trim(text)) >= 10 THEN CASE WHEN len(plain) <= 10 THEN 0.0 ELSE len(list_filter(plain, lambda w: regexp_matches(w, '[A-Za-z][<>=?^~|\\\\]|[<>=?^~|\\\\][A-Za-z]'))) / len(plain) END END AS ratio FROM al)"""
_KEPT = """d AS (SELECT source, doc_id, doc_id % 13 = 5 AS moved FROM documents WHERE doc_id % 11 <> 0), r AS (SELECT source, count(*) FILTER (WHERE moved) OVER w + count(*) FILTER (WHERE NOT moved) OVER (PARTITION BY source) - count(*) FILTER (WHERE NOT moved) OVER w AS up_to, count(*) FILTER (WHERE NOT moved) OVER (PARTITION BY source) AS without FROM d WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)),
k AS (SELECT source, max(greatest(up_to, without)) AS n, count(*) AS total FROM r GROUP BY 1)"""
ORACLE_SQL = {
    "history_page": f"WITH {_RUNS} SELECT run_id, username, title, status FROM runs ORDER BY title, started_at DESC, run_id LIMIT 25 OFFSET 25",
    "history_total": f"WITH {_RUNS} SELECT count(*) AS total FROM runs",
    "section_latest": f"WITH {V.SQL['versions']} SELECT run_id, section_key, arg_max(html, version_num) AS html, max(version_num) AS version_num, count(*) AS revision FROM versions GROUP BY 1, 2",
    "fork_sections": f"WITH {V.SQL['versions']} SELECT run_id + 1000000 AS run_id, section_key, arg_max(html, version_num) AS html, CAST(1 AS BIGINT) AS version_num, 'Forked from ' || run_id AS label FROM versions WHERE run_id IN (SELECT o_orderkey FROM orders) GROUP BY run_id, section_key",
    "latest_status": f"WITH {V.SQL['events']} SELECT run_id, arg_max(status, (ev_at, event_id)) AS status FROM run_events GROUP BY 1",
    "stale_runs": f"WITH {V.SQL['events']} SELECT run_id FROM (SELECT run_id, arg_max(status, (ev_at, event_id)) AS status, max(ev_at) AS hb FROM run_events GROUP BY 1) WHERE status = 'running' AND hb < TIMESTAMP '2030-01-01' - INTERVAL 900 SECOND",
    "garble_pages": f"WITH {_GARBLE} SELECT doc_id, page_idx, checked, garble_check, round(ratio, 6) AS cipher_ratio FROM v",
    "garble_docs": f"""WITH {_GARBLE}, c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM v), s AS (SELECT * FROM c WHERE n = 1 OR (page_idx >= 1 AND (page_idx - 1) % greatest(1, (n - 1) // 6) = 0 AND (page_idx - 1) / greatest(1, (n - 1) // 6) < 6)),
g AS (SELECT doc_id, CAST(sum(CASE WHEN checked THEN 1 ELSE 0 END) AS BIGINT) AS n_checked, avg(CASE WHEN checked THEN CASE WHEN garble_check IS NOT NULL THEN 1.0 ELSE 0.0 END END) AS share, avg(ratio) AS m, max(ratio) AS x FROM s GROUP BY 1),
r AS (SELECT doc_id, n_checked, CASE WHEN n_checked = 0 OR share >= 0.5 THEN 'text' WHEN m > 0.05 OR x > 0.2 THEN 'cipher' ELSE 'none' END AS signal FROM g) SELECT doc_id, n_checked, signal <> 'none' AS garbled, signal FROM r""",
    "verdict_vote": "WITH v AS (SELECT doc_id % 20 AS doc_id, CAST(sum(CASE WHEN quality = 0 AND toxic <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_garbled, count(*) AS n_judged FROM labels GROUP BY 1) SELECT doc_id, n_garbled, n_judged, n_garbled >= 2 OR n_garbled / n_judged >= 0.34 AS garbled FROM v",
    "caption_mentions": f"""WITH {V.SQL['lines']}, m AS (SELECT *, len(list_distinct(regexp_extract_all(text, '(?i)\\bFigure\\s+(\\d+)\\b', 1))) + len(list_distinct(list_transform(regexp_extract_all(text, '(?i)\\bTable\\s+([a-z](?:\\.\\d+)+|\\d+(?:\\.\\d+)*)\\b', 1), lambda x: upper(x)))) + len(list_distinct(regexp_extract_all(text, '(?i)\\bFormula\\s+\\((\\d+)\\)', 1))) AS n FROM page_lines)
SELECT doc_id, page_idx, block_no, nullif(regexp_extract(text, '^(?:Figure|FIGURE)\\s+(\\d+)\\s*[—–\\-]', 1), '') AS figure, nullif(regexp_extract(text, '^(?:Table|TABLE)\\s+(\\d+)[ ]*[—–\\-(]', 1), '') AS table_ref, n AS n_mentions FROM m WHERE n > 0""",
    "footnote_dedupe": f"WITH {V.SQL['lines']} SELECT DISTINCT doc_id, page_idx // 10 AS section, text FROM page_lines WHERE regexp_matches(text, '^a  ') AND regexp_matches(text, '(?i)^[a-z]\\s{{1,4}}\\S') UNION ALL SELECT doc_id, page_idx // 10, text FROM page_lines WHERE regexp_matches(text, '^a  ') AND NOT regexp_matches(text, '(?i)^[a-z]\\s{{1,4}}\\S')",
    "place_media": f"""WITH {V.SQL['lines']}, l AS (SELECT doc_id, page_idx * 100000 + block_no AS ord, text FROM page_lines), c AS (SELECT doc_id, ord, regexp_extract(text, '^(?:Figure|FIGURE)\\s+(\\d+)\\s*[—–\\-]', 1) AS ref, 0 AS k FROM l),
r AS (SELECT doc_id, ord, unnest(regexp_extract_all(text, '(?i)\\bFigure\\s+(\\d+)\\b', 1)) AS ref, 1 AS k FROM l), a AS (SELECT * FROM c WHERE ref <> '' UNION ALL SELECT * FROM r), p AS (SELECT doc_id, CAST(page_idx AS VARCHAR) AS ref FROM page_text)
SELECT doc_id, 'figure' AS kind, ref, arg_min(ord, (k, ord)) AS ord, CASE arg_min(k, (k, ord)) WHEN 0 THEN 'caption' ELSE 'reference' END AS how FROM a JOIN p USING (doc_id, ref) GROUP BY doc_id, ref""",
    "text_metrics": "WITH d AS (SELECT doc_id, trim(text, ' ' || chr(10) || chr(13) || chr(9)) AS s FROM documents) SELECT doc_id, CAST(length(s) AS INTEGER) AS chars, CAST(CASE WHEN s = '' THEN 0 ELSE greatest(1, len(list_filter(string_split(s, CASE WHEN contains(s, '|') THEN '|' ELSE chr(10) END), lambda p: trim(p, ' ' || chr(10) || chr(13) || chr(9)) <> ''))) END AS INTEGER) AS items FROM d",
    "outline_hierarchy": f"""WITH {V.SQL['outline']}, e AS (SELECT doc_id, regexp_extract(title, '^(\\d+(?:\\.\\d+)*)', 1) AS num FROM outline), n AS (SELECT DISTINCT doc_id, num FROM e), k AS (SELECT e.doc_id, e.num, CASE WHEN contains(e.num, '.') AND p.num IS NULL THEN 1 ELSE 0 END AS orphan FROM e LEFT JOIN n p ON p.doc_id = e.doc_id AND p.num = regexp_replace(e.num, '\\.\\d+$', '')),
c AS (SELECT doc_id, count(*) AS n, count(num) AS numbered, CAST(sum(orphan) AS BIGINT) AS orphans FROM k GROUP BY 1), t AS (SELECT DISTINCT doc_id, CAST(split_part(num, '.', 1) AS BIGINT) AS top FROM e), g AS (SELECT doc_id, max(d) AS gap FROM (SELECT doc_id, lead(top) OVER (PARTITION BY doc_id ORDER BY top) - top AS d FROM t) GROUP BY 1)
SELECT doc_id, n, numbered, orphans, gap, n >= 3 AND orphans / numbered <= CASE WHEN n < 15 THEN 0.5 ELSE 0.3 END AND coalesce(gap, 0) <= 10 AS valid FROM c JOIN g USING (doc_id)""",
    "section_ranges": f"WITH {V.SQL['outline']}, n AS (SELECT doc_id, count(*) AS n FROM page_text GROUP BY 1) SELECT o.doc_id, ord, page - 1 AS first_page, coalesce((SELECT min(page) FROM outline x WHERE x.doc_id = o.doc_id AND x.page > o.page) - 1, n - 1) AS end_page FROM outline o JOIN n ON n.doc_id = o.doc_id",
    "section_of_page": f"WITH {V.SQL['outline']} SELECT p.doc_id, p.page_idx, (SELECT arg_max(title, (page, ord)) FROM outline o WHERE o.doc_id = p.doc_id AND o.page <= p.page_idx + 1) AS title FROM page_text p",
    "title_to_page": f"""WITH {V.SQL['pages']}, b AS (SELECT item_id AS ord, lower(trim(string_split(text, chr(10))[1])) AS t FROM benchmark), j AS (SELECT doc_id, ord, page_idx, t, array_to_string(string_split(lower(text), chr(10))[1:60], chr(10)) AS h, lower(text) AS f FROM b, page_text WHERE t <> ''),
r AS (SELECT doc_id, ord, page_idx, strpos(chr(10) || h || chr(10), chr(10) || t || chr(10)) AS l, strpos(h, t) AS a, strpos(f, t) AS d FROM j)
SELECT doc_id, ord, arg_min(page_idx, (CASE WHEN l > 0 THEN 0 WHEN a > 0 THEN 1 ELSE 2 END, CASE WHEN l > 0 THEN l WHEN a > 0 THEN a ELSE 0 END, page_idx)) AS page_idx FROM r WHERE l > 0 OR a > 0 OR d > 0 GROUP BY 1, 2""",
    "box_overlap": f"{_BOX} SELECT page_idx, a_id, b_id, round(o / aa, 6) AS share FROM j WHERE aa > 0 AND o / aa > 0.5",
    "best_box_match": f"{_BOX}, m AS (SELECT page_idx, a_id, arg_max(b_id, (o / (aa + ab - o), -b_id)) AS match FROM j WHERE o / (aa + ab - o) >= 0.1 GROUP BY 1, 2) SELECT a.page_idx, a.id, match FROM a LEFT JOIN m ON m.page_idx = a.page_idx AND m.a_id = a.id",
    "box_gaps": f"WITH {V.SQL['boxes']}, g AS (SELECT *, max(y1) OVER (PARTITION BY page_idx ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM boxes) SELECT page_idx, id, CAST(sum(CASE WHEN reach IS NULL OR y0 - reach > 0.001 THEN 1 ELSE 0 END) OVER (PARTITION BY page_idx ORDER BY y0, y1 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS group_no FROM g",
    "html_items": "WITH f AS (SELECT page_id, regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1) AS l FROM pages) SELECT page_id, list_filter(list_transform(l, lambda s: trim(regexp_replace(s, '(?s)<[^>]*>', '', 'g'), ' ' || chr(10) || chr(13) || chr(9))), lambda s: s <> '') AS items FROM f",
    "fan_out": "WITH s AS (SELECT unnest(range(6)) AS section_no, unnest(['" + "', '".join(SECTIONS) + "']) AS section) SELECT doc_id, CAST(section_no AS INTEGER) AS section_no, section, section || chr(10) || chr(10) || CASE WHEN section = 'troubleshooting' THEN '' ELSE 'at most 5' || chr(10) || chr(10) END || source AS prompt FROM documents, s",
    "parse_responses": "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'unparsable' END AS reason, event_id % 3 = 2 AS truncated FROM events",
    "heading_changes": f"""WITH {_KEPT}, u AS (SELECT source, 'kept' AS change, n FROM k UNION ALL SELECT source, 'moved', total - n FROM k UNION ALL SELECT source, 'deleted', count(*) FILTER (WHERE doc_id % 11 = 0) FROM documents GROUP BY 1 UNION ALL SELECT source, 'inserted', count(*) FILTER (WHERE doc_id % 17 = 0) FROM documents GROUP BY 1)
SELECT source, change, CAST(n AS BIGINT) AS n FROM u WHERE n > 0""",
    "ordered_similarity": f"""WITH {_KEPT}, c AS (SELECT source, count(*) + count(*) FILTER (WHERE doc_id % 11 <> 0) + count(*) FILTER (WHERE doc_id % 17 = 0) AS cells FROM documents GROUP BY 1)
SELECT source, round(2.0::DOUBLE * coalesce(n, 0) / cells, 9) AS similarity, 2.0::DOUBLE * coalesce(n, 0) / cells >= 0.98 AS equal FROM c LEFT JOIN k USING (source)""",
    "dataset_diff": """SELECT doc_id, '(row)' AS "column", 'present' AS expected, 'missing' AS actual, 'hard' AS severity FROM documents WHERE doc_id % 10 = 3 UNION ALL SELECT doc_id, 'lang', lang, 'xx', 'soft' FROM documents WHERE doc_id % 10 <> 3 AND doc_id % 7 = 0""",
    "multiset_diff": "SELECT source, lang, 'expected' AS side, count(*) AS n FROM (SELECT source, lang FROM documents EXCEPT ALL SELECT source, lang FROM documents WHERE doc_id % 10 <> 3) GROUP BY 1, 2",
    "cell_similarity": f"""WITH {V.SQL['pages']}, w AS (SELECT doc_id, page_idx % 2 AS side, unnest(string_split(text, ' ')) AS word FROM page_text), c AS (SELECT doc_id, word, sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS e, sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS a FROM w GROUP BY 1, 2)
SELECT doc_id, round(2 * sum(least(e, a)) / sum(e + a), 9) AS similarity, 2 * sum(least(e, a)) / sum(e + a) >= 0.98 AS equal FROM c GROUP BY 1""",
    "reply_stream_order": f"WITH {V.SQL['events']} SELECT run_id, arg_min(event_id, (ev_at, event_id)) AS first_event, arg_max(event_id, (ev_at, event_id)) AS last_event FROM run_events GROUP BY 1",
    "section_tree": f"WITH {V.SQL['versions']}, c AS (SELECT run_id, section_key, count(*) AS n FROM versions GROUP BY 1, 2) SELECT run_id, 'body' AS top, list('body.' || section_key || ':' || upper(section_key[1]) || section_key[2:] || ':' || CASE WHEN n > 1 THEN 'true' ELSE 'false' END ORDER BY section_key) AS leaves FROM c GROUP BY 1",
    "outline_dedupe": f"""WITH {V.SQL['outline']}, t AS (SELECT *, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS n, regexp_extract(title, '^(\\d+(?:\\.\\d+)*)', 1) AS sec FROM outline),
a AS (SELECT *, max(page) OVER (PARTITION BY doc_id, n) AS last, row_number() OVER (PARTITION BY doc_id, n ORDER BY page, ord) AS k FROM t), b AS (SELECT doc_id, ord, level, title, last AS page, sec FROM a WHERE k = 1),
c AS (SELECT *, max(page) OVER (PARTITION BY doc_id, sec) AS last, row_number() OVER (PARTITION BY doc_id, sec ORDER BY page, ord) AS k FROM b), d AS (SELECT doc_id, ord, level, title, last AS page FROM c WHERE k = 1),
e AS (SELECT *, lead(page) OVER (PARTITION BY doc_id ORDER BY page, ord) AS next FROM d) SELECT doc_id, ord, level, title, page FROM e WHERE next IS NULL OR next - page <= 70""",
    "block_filter": f"""WITH {V.SQL['lines']}, w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY page_idx, block_no) AS k, max(CASE WHEN regexp_matches(text, '(?i)^(?:Bibliography|NO COPYING WITHOUT BSI|British Standards Institution|This page deliberately left blank|BSI Group Headquarters|ICS\\s+\\d+\\.\\d+)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_idx, block_no) AS stop FROM page_lines),
r AS (SELECT doc_id, CASE WHEN length(trim(text)) < 3 THEN 'short' WHEN regexp_matches(substring(text, 1, 120), '(?i)Copyrighted material|licensed to|Techstreet') THEN 'watermark' WHEN regexp_matches(trim(text), '^\\d{{1,4}}\\s*$') THEN 'page number'
 WHEN regexp_matches(trim(text), '(?i)^\\d{{0,4}}\\s*All rights reserved\\s*$|^©\\s*(?:ISO|IEC|BSI|EN)\\b.*All rights reserved.*$') THEN 'rights footer' WHEN stop = 1 THEN 'back matter' WHEN regexp_matches(text, '(?i)^(?:[a-z]\\s{{1,4}}\\S|\\d+\\)\\s|\\*\\s)') AND k > 1 THEN 'repeated footnote' ELSE 'kept' END AS reason FROM w)
SELECT doc_id, reason, count(*) AS n FROM r GROUP BY 1, 2""",
}
