"""Queries of page layout and outlines: every order is a document, its lines are blocks of two pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.functions import text as T
from parchment.operators import layout as L
from parchment.operators import outline as O
from parchment.operators import pages as P

from . import views as V
from .batches import lines

PAGE = ["doc_id", "page_idx"]


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Positioned blocks: captions, formulas, headings, references, watermarks, page numbers and plain text."""
    k, kind = (F.col("l_suppkey") % 5 + 1).cast("string"), F.col("l_partkey") % 10
    before = F.lit(["Figure ", "Table ", "Table ", "a + b = c (", "licensed to ", "", "", "A sentence of the body, number ", "see Figure ", ""])
    after = F.lit([" — view", " — list", " (continued)", ")", "", "", ".2 Heading", ".", " and a table", ""])
    made = F.concat(F.get(before, kind.cast("int")), k, F.get(after, kind.cast("int")))
    text = F.when(kind == 5, "12").when(kind == 9, "ab").otherwise(made)
    x0, y0 = (F.col("l_partkey") % 300).cast("double"), (F.col("l_suppkey") * 37 % 600).cast("double")
    return lines(spark, sf).select(
        F.col("root").alias("doc_id"), (F.col("l_linenumber") % 2).alias("page_idx"), F.col("ord").alias("block_no"), F.col("ord").alias("id"), text.alias("text"), kind.alias("what"), (F.col("l_suppkey") % 5 + 1).alias("number"),
        x0.alias("x0"), y0.alias("y0"), (x0 + 20 + F.col("l_partkey") % 200).alias("x1"), (y0 + 10 + F.col("l_linenumber") * 9).alias("y1"), F.lit(600.0).alias("page_w"), F.lit(700.0).alias("page_h"),
        (F.col("l_partkey") % 5 + 6).cast("double").alias("size"), (F.col("l_suppkey") % 2 == 0).alias("bold"), (F.col("l_suppkey") % 3 == 0).alias("italic"), F.when(F.col("l_suppkey") % 2 == 0, "figure").otherwise("table").alias("kind"),
    )


def _some(spark: SparkSession, sf: str, *what: int) -> DataFrame:
    return blocks(spark, sf).filter(F.col("what").isin(*what))


def band_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """B12."""
    return P.band_filter(blocks(spark, sf)).select(*PAGE, "block_no")


def layout_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """B13."""
    return P.drop_layout_artifacts(blocks(spark, sf)).select(*PAGE, "block_no")


def tiny_media(spark: SparkSession, sf: str) -> DataFrame:
    """B15."""
    media = V.t(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, "table").otherwise("figure").alias("kind"), (F.col("p_partkey") * 97 % 4000).alias("n_bytes"), F.col("p_size").alias("page"), F.lit(5).alias("first_page"), F.lit(40).alias("last_page"))
    return P.tiny_media_filter(media).select("p_partkey")


def extraction_routes(spark: SparkSession, sf: str) -> DataFrame:
    """B17."""
    docs = V.t(spark, sf, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 5 == 0, "Manual.DOCX").otherwise("manual.pdf").alias("filename"))
    return P.route_extraction(docs).select("doc_id", "route")


def text_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of whole texts in which every line but the first starts with a caption."""
    docs = V.t(spark, sf, "documents").select("doc_id", F.lit(0).alias("page_idx"), F.replace("text", F.lit("\n"), F.lit("\n Figure 1 — ")).alias("text"))
    return P.blocks_of(docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("text")).cast("long").alias("longest"))


def suppressed_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """C19."""
    b = blocks(spark, sf)
    return L.suppress_inside(b.filter("id % 2 = 0"), b.filter("id % 2 = 1")).select(*PAGE, "block_no")


def kept_formulas(spark: SparkSession, sf: str) -> DataFrame:
    """C20."""
    b = blocks(spark, sf)
    return L.filter_formulas(b.filter("id % 2 = 0"), b.filter("id % 2 = 1")).select(*PAGE, "id")


def kept_tables(spark: SparkSession, sf: str) -> DataFrame:
    """C21."""
    b = blocks(spark, sf)
    return L.drop_tables_in_figures(b.filter("kind = 'table'"), b.filter("kind = 'figure'")).select(*PAGE, "id")


def claimed_captions(spark: SparkSession, sf: str) -> DataFrame:
    """C23."""
    return L.claim_caption_above(_some(spark, sf, 0, 7, 8, 9), _some(spark, sf, 1, 2), gap=150.0)


def nearby_captions(spark: SparkSession, sf: str) -> DataFrame:
    """The last caption among the first blocks down to a region."""
    b = blocks(spark, sf)
    texts = b.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("block_no", "text"))).alias("b")).select(*PAGE, F.col("b.text").alias("blocks"))
    return L.caption_near(b.select(*PAGE, "id", (F.col("y0") / 700).alias("y0"), (F.col("y1") / 700).alias("y1")), texts, "^(Figure|Table) ")


def figure_captions(spark: SparkSession, sf: str) -> DataFrame:
    """C26, E21."""
    b = blocks(spark, sf)
    figures = b.filter("id % 2 = 0").select(*PAGE, "id", "x0", "y0", "x1", "y1")
    boxed = b.filter("id % 4 = 1").select(*PAGE, F.col("number").cast("string").alias("ref"), "x0", "y0", "x1", "y1")
    loose = b.filter("id = 3 and number < 3").select(*PAGE, F.concat(F.lit("loose "), F.col("number").cast("string")).alias("ref"), *[F.lit(None).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    near = b.filter("id % 2 = 0 and number = 4").select(*PAGE, "id", F.lit("near").alias("ref"))
    return L.figure_caption_by_overlap(figures, boxed.unionByName(loose), near).select(*PAGE, "id", "ref")


def filled_media(spark: SparkSession, sf: str) -> DataFrame:
    """C33."""
    m = blocks(spark, sf).select("doc_id", "kind", F.col("number").cast("string").alias("ref"), F.when(F.col("what") < 5, F.array("x0", "y0", "x1", "y1")).otherwise(F.array("x0")).alias("bbox"), "id")
    captured = m.filter("id <= 2").select("doc_id", "kind", "ref").distinct()
    return L.fill_missing_media(captured, m.filter("id > 2")).groupBy("doc_id", "kind", "ref").agg(F.count("*").alias("n"))


def expanded_figures(spark: SparkSession, sf: str) -> DataFrame:
    """C34."""
    b = blocks(spark, sf)
    return L.expand_figure_box(b.filter("id % 2 = 0"), b.filter("id % 2 = 1").withColumn("ord", F.col("id")).withColumn("ref", F.when(F.col("number") < 5, F.col("number").cast("string"))))


def block_styles(spark: SparkSession, sf: str) -> DataFrame:
    """D26."""
    return L.dominant_style(blocks(spark, sf).withColumn("block_no", F.col("block_no") % 2))


def table_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """D28."""
    b = blocks(spark, sf).withColumn("table_id", F.col("number"))
    return L.table_envelope(b.filter("what < 4"), b.filter("what > 7"))


def real_figures(spark: SparkSession, sf: str) -> DataFrame:
    """D30."""
    b = blocks(spark, sf)
    clusters = b.filter("id % 2 = 0")
    paths = b.filter("id % 2 = 1").select(*PAGE, (F.col("id") + 1).alias("cluster"), F.col("bold").alias("curve"), F.when(F.col("italic"), "white").when(F.col("what") > 4, "red").alias("fill"))
    return L.real_figures(paths, clusters.select(*PAGE, "id", "x0", "y0", "x1", "y1"), _some(spark, sf, 7), 300.0)


def captured_pages(spark: SparkSession, sf: str) -> DataFrame:
    """D32."""
    return L.first_capture(blocks(spark, sf).select("doc_id", "kind", F.col("number").alias("ref"), "page_idx"))


def line_groups(spark: SparkSession, sf: str) -> DataFrame:
    """E13."""
    b = blocks(spark, sf).groupBy(*PAGE, "y0").agg(F.max("y1").alias("y1"))
    return L.text_lines(b).select(*PAGE, "y0", "group_no")


def emitted_media(spark: SparkSession, sf: str) -> DataFrame:
    """Captions and the first of each medium."""
    rows = blocks(spark, sf).withColumn("c", P.caption_of(F.col("text"))).filter("c is not null").select("doc_id", "page_idx", "block_no", "c.*")
    return P.emit_once(rows, ["kind", "ref"], ["page_idx", "block_no"])


def table_extents(spark: SparkSession, sf: str) -> DataFrame:
    """E20."""
    t = blocks(spark, sf).groupBy("doc_id", F.col("kind").alias("ref"), F.col("block_no").alias("page_idx")).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    return L.running_extent(t.withColumn("x0", F.col("x0") / 600).withColumn("x1", F.col("x1") / 600))


def clipped_figures(spark: SparkSession, sf: str) -> DataFrame:
    """E23."""
    return L.clip_below_next(blocks(spark, sf).select(*PAGE, "id", "number", "y0", "y1"))


def numbered_formulas(spark: SparkSession, sf: str) -> DataFrame:
    """E24."""
    return L.numbered_formulas(blocks(spark, sf))


def expanded_clips(spark: SparkSession, sf: str) -> DataFrame:
    """H45."""
    b = blocks(spark, sf)
    shares = b.select(*PAGE, "id", "page_w", "page_h", "bold", *[(F.col(c) / F.lit(1024.0)).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return L.expand_clip(shares.withColumnRenamed("bold", "is_continuation"))


def heading_above(spark: SparkSession, sf: str) -> DataFrame:
    """C15."""
    heads = _some(spark, sf, 6).withColumnRenamed("block_no", "ord").withColumnRenamed("text", "title")
    return L.asof_heading_y(_some(spark, sf, 7, 8, 9).select(*PAGE, "id", "y0"), heads)


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    """C16."""
    return L.preceding_anchor(_some(spark, sf, 3), blocks(spark, sf).filter("what <> 3"))


def formula_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that look like formulas by their fonts or on their own."""
    b = blocks(spark, sf).withColumn("n_fonts", F.col("number"))
    by_line = b.filter(T.math_signal(F.col("text"), F.col("number") / 20, F.when(F.col("italic"), 0.8).otherwise(0.2)))
    return L.detected_formulas(by_line.select(*PAGE, "x0", "y0", "x1", "y1"), L.formula_bands(b).select(*PAGE, "x0", "y0", "x1", "y1"))


def outline(spark: SparkSession, sf: str) -> DataFrame:
    """Outline of headings, numbered from 0 in a document."""
    heads = _some(spark, sf, 6, 0, 1).select("doc_id", (F.col("block_no") - 1).alias("ord"), F.lit(1).alias("level"), F.col("text").alias("title"), (F.col("page_idx") + 1).alias("page"))
    return heads


def sectioned_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The blocks on each section's pages."""
    n = blocks(spark, sf).select("doc_id").distinct().withColumn("n_pages", F.lit(2))
    ranges = O.section_ranges(outline(spark, sf), n)
    return O.section_pages(ranges, blocks(spark, sf).select(*PAGE, "block_no")).groupBy("doc_id", "ord").agg(F.count("*").alias("n_blocks"), F.max("page_idx").alias("last_page"))


def chosen_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of the chosen range; a range outside the outline is rejected."""
    full = blocks(spark, sf).select("doc_id", (F.col("block_no") - 1).alias("ord"))
    wanted = V.t(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 3).cast("int").alias("start_idx"), (F.col("o_custkey") % 5).cast("int").alias("end_idx"))
    ok, bad = O.select_ranges(full, wanted)
    return ok.select("doc_id", "ord", F.lit("chosen").alias("how")).unionByName(bad.select("doc_id", F.col("end_idx").alias("ord"), F.lit("rejected").alias("how")))


def resolved_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages from the printed ones by the median offset, never falling."""
    e = blocks(spark, sf).select("doc_id", F.col("block_no").alias("ord"), F.when(F.col("what") < 6, F.col("block_no") + F.col("number")).cast("int").alias("page_idx"), F.when(F.col("what") != 9, F.col("block_no")).otherwise(0).alias("printed_page"))
    n = e.select("doc_id").distinct().withColumn("n_pages", F.lit(9))
    return O.monotone_pages(e, O.median_offset(e), n).select("doc_id", "ord", "page")


def contents_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of contents pages; an entry may run over two lines; a page without entries ends the contents."""
    k, n = F.col("o_orderkey").cast("string"), (F.col("o_custkey") % 90 + 1).cast("string")
    page = lambda i, *parts: F.struct(F.lit(i).alias("page_idx"), F.concat(*parts).alias("text"))
    made = F.array(
        page(0, F.lit("Cover of "), k), page(1, F.lit("Contents\n1 Scope of no. "), k, F.lit(" in full\n............ "), n, F.lit("\n2 Terms ........ 4")),
        page(2, F.lit("3 Long\ntitle ......... 6\nAnnex B Notes ........ xi")), page(3, F.lit("Body text")), page(4, F.lit("9 Late ........ 9")),
    )
    pages = V.t(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(made).alias("p")).select("doc_id", "p.*")
    return O.contents_entries(pages)


def contents_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    """E11, E12, H31 over the texts: a source's contents pages list its documents' first words, every fourth entry over two lines."""
    p = V.pages(spark, sf)
    words = F.array_join(F.slice(F.split(F.trim(F.regexp_replace("text", "[^A-Za-z]+", " ")), " "), 1, 3), " ")
    line = F.concat((F.col("page_idx") + 1).cast("string"), F.lit(" "), F.coalesce(F.nullif(words, F.lit("")), F.lit("Untitled")), F.when(F.col("page_idx") % 4 == 1, "\n").otherwise(" "), F.lit("........ "), (F.col("page_idx") + 1).cast("string"))
    listed = p.select("doc_id", F.floor(F.col("page_idx") / 30).cast("int").alias("page"), F.struct("page_idx", line.alias("line")).alias("e")).groupBy("doc_id", "page").agg(F.sort_array(F.collect_list("e")).alias("e"))
    return O.contents_entries(listed.select("doc_id", F.col("page").alias("page_idx"), F.concat(F.lit("Contents\n"), F.array_join("e.line", "\n")).alias("text")))


def font_headings(spark: SparkSession, sf: str) -> DataFrame:
    """Bold numbered spans, else spans above the median size."""
    s = blocks(spark, sf).withColumn("page_idx", F.col("block_no") + 2).withColumn("span_no", F.col("block_no")).withColumn("n_pages", F.lit(20))
    return O.heading_by_font(s.withColumn("size", F.when(F.col("what") > 6, F.col("size") + 4).otherwise(F.col("size"))))


def picked_outline(spark: SparkSession, sf: str) -> DataFrame:
    """Of each document the first method with entries (three for the first)."""
    o = outline(spark, sf)
    return O.pick_outline([o.filter("title like '%Heading'"), o.filter("title like 'Figure%'"), o]).select("doc_id", "ord", "title", "method")


def flushed_media(spark: SparkSession, sf: str) -> DataFrame:
    """Media at captions and references, the others after the last row of the section that owns their page."""
    rows = blocks(spark, sf).select("doc_id", F.col("block_no").alias("ord"), "text", F.concat(F.lit("s"), F.col("page_idx").cast("string")).alias("section"), F.col("page_idx").alias("page"))
    media = blocks(spark, sf).select("doc_id", F.lit("figure").alias("kind"), F.when(F.col("what") == 9, F.lit("-1")).otherwise(F.col("number").cast("string")).alias("ref"), F.when(F.col("what") % 4 != 1, F.col("page_idx")).alias("page"))
    media = media.groupBy("doc_id", "kind", "ref").agg(F.min("page").alias("page"))
    placed = P.place_media(rows, media)
    return placed.select("doc_id", "ref", F.col("ord").cast("double").alias("ord")).unionByName(P.flush_media(rows, media, placed).select("doc_id", "ref", F.col("ord").cast("double").alias("ord")))


def inline_headers(spark: SparkSession, sf: str) -> DataFrame:
    """E15."""
    b = blocks(spark, sf).withColumn("section", F.when(F.col("page_idx") == 0, "2").otherwise("3"))
    return P.inline_subsections(b).select("doc_id", "section", "page_idx", "block_no", "is_header", F.col("number"))


def section_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks after a section's own heading up to the next one."""
    b = blocks(spark, sf).withColumn("section", F.lit("1"))
    return P.section_blocks(b, F.col("text") == "2.2 Heading", F.col("text").endswith("Heading") | F.col("text").startswith("Figure")).select("doc_id", "page_idx", "block_no")


_NAMES = (
    band_filtered, layout_artifacts, tiny_media, extraction_routes, text_blocks, suppressed_blocks, kept_formulas, kept_tables, claimed_captions, nearby_captions, figure_captions, filled_media, expanded_figures, block_styles, table_boxes,
    real_figures, captured_pages, line_groups, emitted_media, table_extents, clipped_figures, numbered_formulas, expanded_clips, heading_above, anchors, formula_lines, sectioned_blocks, chosen_ranges, resolved_pages, contents_entries, contents_of_documents,
    font_headings, picked_outline, flushed_media, inline_headers, section_bodies,
)
QUERIES = {f.__name__: f for f in _NAMES}

_B = """bl AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 AS page_idx, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus)::INTEGER AS block_no,
 l_partkey % 10 AS what, l_suppkey % 5 + 1 AS number, CASE l_partkey % 10 WHEN 0 THEN 'Figure ' || (l_suppkey % 5 + 1) || ' — view' WHEN 1 THEN 'Table ' || (l_suppkey % 5 + 1) || ' — list' WHEN 2 THEN 'Table ' || (l_suppkey % 5 + 1) || ' (continued)' WHEN 3 THEN 'a + b = c (' || (l_suppkey % 5 + 1) || ')'
 WHEN 4 THEN 'licensed to ' || (l_suppkey % 5 + 1) WHEN 5 THEN '12' WHEN 6 THEN (l_suppkey % 5 + 1) || '.2 Heading' WHEN 7 THEN 'A sentence of the body, number ' || (l_suppkey % 5 + 1) || '.' WHEN 8 THEN 'see Figure ' || (l_suppkey % 5 + 1) || ' and a table' ELSE 'ab' END AS text,
 (l_partkey % 300)::DOUBLE AS x0, (l_suppkey * 37 % 600)::DOUBLE AS y0, (l_partkey % 300 + 20 + l_partkey % 200)::DOUBLE AS x1, (l_suppkey * 37 % 600 + 10 + l_linenumber * 9)::DOUBLE AS y1, (l_partkey % 5 + 6)::DOUBLE AS size, l_suppkey % 2 = 0 AS bold, l_suppkey % 3 = 0 AS italic,
 CASE WHEN l_suppkey % 2 = 0 THEN 'figure' ELSE 'table' END AS kind FROM lineitem), b AS (SELECT *, block_no AS id FROM bl)"""
_OVER = "greatest(0, least(a.x1, r.x1) - greatest(a.x0, r.x0)) * greatest(0, least(a.y1, r.y1) - greatest(a.y0, r.y0)) / ((a.x1 - a.x0) * (a.y1 - a.y0))"
_OVER_R = _OVER.replace("((a.x1 - a.x0) * (a.y1 - a.y0))", "((r.x1 - r.x0) * (r.y1 - r.y0))")
_OUT = "o AS (SELECT doc_id, block_no - 1 AS ord, text AS title, page_idx + 1 AS page FROM b WHERE what IN (0, 1, 6))"
ORACLE_SQL = {
    "band_filtered": f"WITH {_B} SELECT doc_id, page_idx, block_no FROM b WHERE y1 >= 65 AND y0 <= 635",
    "layout_artifacts": f"WITH {_B}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, CASE WHEN what IN (1, 2) THEN number END ORDER BY page_idx, block_no) AS k FROM b) SELECT doc_id, page_idx, block_no FROM n WHERE what NOT IN (1, 2) OR what = 1 AND k = 1",
    "tiny_media": "SELECT p_partkey FROM part WHERE (p_size % 3 = 0 OR p_partkey * 97 % 4000 >= 2000) AND p_size BETWEEN 5 AND 40",
    "extraction_routes": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'native' WHEN length(trim(coalesce(text, ''))) < 500 THEN 'ocr' ELSE 'text' END AS route FROM documents",
    "text_blocks": """WITH s AS (SELECT doc_id, unnest(list_transform(string_split(replace(text, chr(10), chr(10) || ' Figure 1 — '), chr(10)), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13)))) AS x FROM documents)
SELECT doc_id, count(*) AS n, max(length(x)) AS longest FROM s WHERE x <> '' GROUP BY 1""",
    "suppressed_blocks": f"WITH {_B} SELECT a.doc_id, a.page_idx, a.block_no FROM b a WHERE a.id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM b r WHERE r.doc_id = a.doc_id AND r.page_idx = a.page_idx AND r.id % 2 = 1 AND {_OVER} > 0.5 AND NOT (r.kind = 'figure' AND a.what = 0))",
    "kept_formulas": f"WITH {_B} SELECT a.doc_id, a.page_idx, a.id FROM b a WHERE a.id % 2 = 0 AND a.x1 - a.x0 >= 20 AND a.y1 - a.y0 >= 8 AND NOT EXISTS (SELECT 1 FROM b r WHERE r.doc_id = a.doc_id AND r.page_idx = a.page_idx AND r.id % 2 = 1 AND {_OVER} > 0.2)",
    "kept_tables": f"WITH {_B} SELECT a.doc_id, a.page_idx, a.id FROM b a WHERE a.kind = 'table' AND NOT EXISTS (SELECT 1 FROM b r WHERE r.doc_id = a.doc_id AND r.page_idx = a.page_idx AND r.kind = 'figure' AND {_OVER} > 0.6)",
    "claimed_captions": f"""WITH RECURSIVE {_B}, p AS (SELECT a.doc_id, a.page_idx, a.id, a.y0 AS top0, r.block_no, r.text, r.y0 AS c0, r.y1 AS c1, row_number() OVER (PARTITION BY a.doc_id, a.page_idx ORDER BY a.id, r.block_no) AS n
 FROM b a JOIN b r ON r.doc_id = a.doc_id AND r.page_idx = a.page_idx AND r.what IN (1, 2) WHERE a.what IN (0, 7, 8, 9)),
s AS (SELECT doc_id, page_idx, CAST(0 AS BIGINT) AS n, CAST(-1 AS INTEGER) AS id, CAST(0 AS DOUBLE) AS top, CAST([] AS INTEGER[]) AS used, CAST(NULL AS INTEGER) AS got FROM p WHERE n = 1 UNION ALL
 SELECT s.doc_id, s.page_idx, p.n, p.id, CASE WHEN f.ok THEN least(f.top, p.c0) ELSE f.top END, CASE WHEN f.ok THEN list_append(s.used, p.block_no) ELSE s.used END, CASE WHEN f.ok THEN p.block_no END
 FROM s JOIN p ON p.doc_id = s.doc_id AND p.page_idx = s.page_idx AND p.n = s.n + 1, LATERAL (SELECT t AS top, p.c1 <= t + 5 AND t - p.c1 <= 150 AND NOT list_contains(s.used, p.block_no) AS ok FROM (SELECT CASE WHEN s.id = p.id THEN s.top ELSE p.top0 END AS t)) f),
g AS (SELECT doc_id, page_idx, id, min(got) AS block_no, min(top) AS y0, CAST(count(got) AS INTEGER) AS n_claimed FROM s WHERE n > 0 GROUP BY 1, 2, 3 HAVING count(got) > 0) SELECT doc_id, page_idx, CAST(g.id AS BIGINT) AS id, CAST(g.block_no AS BIGINT) AS block_no, b.text, g.y0, n_claimed FROM g JOIN b USING (doc_id, page_idx, block_no)""",
    "nearby_captions": f"""WITH {_B}, t AS (SELECT doc_id, page_idx, list(text ORDER BY block_no) AS l FROM b GROUP BY 1, 2), h AS (SELECT doc_id, page_idx, id, list_filter(l[1:greatest(1, CAST(floor(y0 / 700 * len(l)) AS INTEGER) + 2)], lambda x: regexp_matches(x, '^(Figure|Table) ')) AS hit FROM b JOIN t USING (doc_id, page_idx))
SELECT doc_id, page_idx, id, CASE WHEN len(hit) > 0 THEN hit[len(hit)] END AS caption FROM h""",
    "figure_captions": f"""WITH {_B}, j AS (SELECT a.doc_id, a.page_idx, a.id, CAST(r.number AS VARCHAR) AS ref, {_OVER_R} AS share FROM b a JOIN b r ON r.doc_id = a.doc_id AND r.page_idx = a.page_idx AND r.id % 4 = 1 WHERE a.id % 2 = 0), r1 AS (SELECT doc_id, page_idx, id, arg_max(ref, (share, ref)) AS r1 FROM j WHERE share > 0 GROUP BY 1, 2, 3),
r2 AS (SELECT doc_id, page_idx, min('loose ' || number) AS r2 FROM b WHERE id = 3 AND number < 3 GROUP BY 1, 2), c AS (SELECT doc_id, page_idx, id, coalesce(r1, r2, CASE WHEN number = 4 THEN 'near' END) AS ref FROM b LEFT JOIN r1 USING (doc_id, page_idx, id) LEFT JOIN r2 USING (doc_id, page_idx) WHERE id % 2 = 0)
SELECT doc_id, page_idx, id, coalesce(ref, CAST(-sum(CASE WHEN ref IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_idx, id ROWS UNBOUNDED PRECEDING) AS VARCHAR)) AS ref FROM c""",
    "filled_media": f"WITH {_B}, c AS (SELECT DISTINCT doc_id, kind, number FROM b WHERE id <= 2), u AS (SELECT * FROM c UNION ALL SELECT doc_id, kind, number FROM b WHERE id > 2 AND what < 5 AND (doc_id, kind, number) NOT IN (SELECT doc_id, kind, number FROM c)) SELECT doc_id, kind, CAST(number AS VARCHAR) AS ref, count(*) AS n FROM u GROUP BY ALL",
    "expanded_figures": f"""WITH {_B}, j AS (SELECT a.doc_id, a.page_idx, a.id, arg_min(r.x0, r.id) AS mx0, arg_min(r.y0, r.id) AS my0, arg_min(r.x1, r.id) AS mx1, arg_min(r.y1, r.id) AS my1 FROM b a JOIN b r ON r.doc_id = a.doc_id AND r.page_idx = a.page_idx AND r.id % 2 = 1 AND r.number < 5
 AND (least(a.x1, r.x1) - greatest(a.x0, r.x0)) / (a.x1 - a.x0) >= 0.3 AND (least(a.y1, r.y1) - greatest(a.y0, r.y0)) / (a.y1 - a.y0) >= 0.2 WHERE a.id % 2 = 0 GROUP BY 1, 2, 3)
SELECT doc_id, page_idx, id, least(x0, coalesce(mx0, x0)) AS x0, least(y0, coalesce(my0, y0)) AS y0, greatest(x1, coalesce(mx1, x1)) AS x1, greatest(y1, coalesce(my1, y1)) AS y1 FROM b LEFT JOIN j USING (doc_id, page_idx, id) WHERE id % 2 = 0""",
    "block_styles": f"""WITH {_B}, n AS (SELECT doc_id, page_idx, block_no % 2 AS block_no, size, italic, bold, sum(length(text)) AS n FROM b GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_idx, block_no ORDER BY n DESC, size DESC, italic DESC, bold DESC) AS k FROM n),
p AS (SELECT doc_id, page_idx, size, sum(n) AS n FROM n GROUP BY ALL), z AS (SELECT doc_id, page_idx, arg_max(size, (n, size)) AS body_size FROM p GROUP BY 1, 2) SELECT doc_id, page_idx, block_no, size, italic, bold, body_size FROM s JOIN z USING (doc_id, page_idx) WHERE k = 1""",
    "table_boxes": f"""WITH {_B}, own AS (SELECT doc_id, page_idx, number AS table_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b WHERE what < 4 GROUP BY 1, 2, 3)
SELECT * FROM own UNION ALL SELECT doc_id, page_idx, number, x0, y0, x1, y1 FROM b WHERE what > 7 AND (doc_id, page_idx) NOT IN (SELECT doc_id, page_idx FROM own)""",
    "real_figures": f"""WITH {_B}, p AS (SELECT doc_id, page_idx, id + 1 AS id, count(*) AS n, bool_or(bold) AS curve, bool_or(NOT italic AND what > 4) AS fill FROM b WHERE id % 2 = 1 GROUP BY 1, 2, 3), t AS (SELECT a.doc_id, a.page_idx, a.id, sum({_OVER}) AS covered FROM b a JOIN b r ON r.doc_id = a.doc_id AND r.page_idx = a.page_idx AND r.what = 7 WHERE a.id % 2 = 0 GROUP BY 1, 2, 3)
SELECT doc_id, page_idx, id, x0, y0, x1, y1 FROM b JOIN p USING (doc_id, page_idx, id) LEFT JOIN t USING (doc_id, page_idx, id) WHERE (n >= 6 OR coalesce(covered, 0) <= 0.1 AND (curve OR fill)) AND x0 <= 0.82::DOUBLE * 300.0::DOUBLE""",
    "captured_pages": f"WITH {_B} SELECT doc_id, kind, number AS ref, min(page_idx) AS first_page, list(DISTINCT page_idx ORDER BY page_idx) AS pages FROM b GROUP BY 1, 2, 3",
    "line_groups": f"""WITH {_B}, s AS (SELECT doc_id, page_idx, y0, max(y1) AS y1 FROM b GROUP BY 1, 2, 3), g AS (SELECT *, max(y1) OVER (PARTITION BY doc_id, page_idx ORDER BY y0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
SELECT doc_id, page_idx, y0, CAST(sum(CASE WHEN reach IS NULL OR y0 - reach > 26 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_idx ORDER BY y0 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS group_no FROM g""",
    "emitted_media": f"""WITH {_B}, c AS (SELECT doc_id, page_idx, block_no, CASE what WHEN 0 THEN 'figure' WHEN 3 THEN 'formula' ELSE 'table' END AS kind, CAST(number AS VARCHAR) AS ref FROM b WHERE what < 4), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, ref ORDER BY page_idx, block_no) AS k FROM c) SELECT doc_id, page_idx, block_no, kind, ref FROM n WHERE k = 1""",
    "table_extents": f"""WITH {_B}, t AS (SELECT doc_id, kind AS ref, block_no AS page_idx, x0 / 600 AS x0, x1 / 600 AS x1 FROM b), s AS (SELECT doc_id, ref, page_idx, CASE WHEN x0 < 0.3 AND x1 < 0.85 THEN 0.05::DOUBLE ELSE x0 END AS a, CASE WHEN x0 < 0.3 AND x1 < 0.85 THEN 0.88::DOUBLE ELSE x1 END AS z FROM t)
SELECT doc_id, ref, page_idx, min(a) OVER w AS x0, max(z) OVER w AS x1 FROM s WINDOW w AS (PARTITION BY doc_id, ref ORDER BY page_idx ROWS UNBOUNDED PRECEDING)""",
    "clipped_figures": f"WITH {_B} SELECT a.doc_id, a.page_idx, a.id, a.number, a.y0, least(a.y1, coalesce((SELECT min(r.y0) FROM b r WHERE r.doc_id = a.doc_id AND r.page_idx = a.page_idx AND r.number > a.number), a.y1)) AS y1 FROM b a",
    "numbered_formulas": f"WITH {_B}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, number ORDER BY page_idx, block_no) AS k FROM b WHERE what = 3) SELECT doc_id, CAST(number AS VARCHAR) AS number, page_idx, x0 - 20 AS x0, y0 - 5 AS y0, x1 + 20 AS x1, y1 + 5 AS y1 FROM f WHERE k = 1",
    "expanded_clips": f"WITH {_B}, c AS (SELECT doc_id, page_idx, id, x0 / 1024.0::DOUBLE * 600.0::DOUBLE AS x0, greatest(0.0::DOUBLE, y0 / 1024.0::DOUBLE * 700.0::DOUBLE - CASE WHEN bold THEN 55 ELSE 20 END) AS y0, x1 / 1024.0::DOUBLE * 600.0::DOUBLE AS x1, least(690.0::DOUBLE, y1 / 1024.0::DOUBLE * 700.0::DOUBLE + 90) AS y1 FROM b) SELECT * FROM c WHERE y1 - y0 > 5 AND x1 - x0 > 5",
    "heading_above": f"""WITH {_B}, h AS (SELECT doc_id, page_idx, block_no AS ord, text AS title, y0 AS hy FROM b WHERE what = 6), i AS (SELECT doc_id, page_idx, id, y0 FROM b WHERE what > 6),
j AS (SELECT i.doc_id, i.page_idx, i.id, arg_max(h.title, (h.hy, h.ord)) FILTER (WHERE h.hy <= i.y0) AS above, min(h.ord) AS first FROM i LEFT JOIN h ON h.doc_id = i.doc_id AND h.page_idx = i.page_idx GROUP BY 1, 2, 3)
SELECT j.doc_id, j.page_idx, j.id, coalesce(above, (SELECT min(title) FROM h WHERE h.doc_id = j.doc_id AND h.ord = j.first - 1)) AS title FROM j""",
    "anchors": f"""WITH {_B}, p AS (SELECT a.doc_id, a.page_idx, a.id, r.text, r.y1 FROM b a JOIN b r ON r.doc_id = a.doc_id AND r.page_idx = a.page_idx AND r.what NOT IN (3, 4, 5) AND r.y1 <= a.y0 + 2 WHERE a.what = 3)
SELECT doc_id, page_idx, id, arg_max(text, (CASE WHEN length(text) >= 10 THEN 1 ELSE 0 END, y1, text)) AS anchor FROM p GROUP BY 1, 2, 3""",
    "formula_lines": f"WITH {_B} SELECT DISTINCT doc_id, page_idx, x0, y0, x1, y1 FROM b WHERE number / 20 > 0.3 OR what = 3 AND italic OR length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) <= 40 AND x1 - x0 BETWEEN 12 AND 480 AND y1 - y0 >= 6 AND number >= 2",
    "sectioned_blocks": f"""WITH {_B}, {_OUT}, r AS (SELECT o.doc_id, o.ord, o.page - 1 AS a, coalesce((SELECT min(x.page) FROM o x WHERE x.doc_id = o.doc_id AND x.page > o.page) - 1, 1) AS z FROM o)
SELECT r.doc_id, r.ord, count(*) AS n_blocks, max(page_idx) AS last_page FROM r JOIN b ON b.doc_id = r.doc_id AND page_idx BETWEEN a AND greatest(a, z) GROUP BY 1, 2""",
    "chosen_ranges": f"""WITH {_B}, n AS (SELECT doc_id, max(block_no) AS n FROM b GROUP BY 1), r AS (SELECT o_orderkey AS doc_id, o_custkey % 3 AS s, CAST(o_custkey % 5 AS INTEGER) AS e, coalesce(o_custkey % 3 <= o_custkey % 5 AND o_custkey % 5 < n, false) AS ok FROM orders LEFT JOIN n ON n.doc_id = o_orderkey)
SELECT b.doc_id, block_no - 1 AS ord, 'chosen' AS how FROM b JOIN r ON r.doc_id = b.doc_id AND ok AND block_no - 1 BETWEEN s AND e UNION ALL SELECT doc_id, e, 'rejected' FROM r WHERE NOT ok""",
    "resolved_pages": f"""WITH {_B}, e AS (SELECT doc_id, block_no AS ord, CASE WHEN what < 6 THEN block_no + number END AS seen, CASE WHEN what <> 9 THEN block_no ELSE 0 END AS printed FROM b),
m AS (SELECT doc_id, list(seen - printed + 1 ORDER BY seen - printed + 1) AS l FROM e WHERE seen IS NOT NULL AND printed > 0 GROUP BY 1), o AS (SELECT doc_id, l[len(l) // 2 + 1] AS off FROM m),
g AS (SELECT e.doc_id, ord, coalesce(seen, CASE WHEN printed > 0 THEN greatest(0, least(8, printed - 1 + coalesce(off, 0))) END, 0) AS p FROM e LEFT JOIN o ON o.doc_id = e.doc_id) SELECT doc_id, ord, max(p) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING)::INTEGER + 1::INTEGER AS page FROM g""",
    "contents_of_documents": f"""WITH {V.SQL['pages']}, t AS (SELECT doc_id, page_idx, coalesce(nullif(array_to_string(string_split(trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' ')[1:3], ' '), ''), 'Untitled') AS w FROM page_text WHERE doc_id IS NOT NULL)
SELECT doc_id, CAST(page_idx // 30 AS INTEGER) AS page_idx, CAST(page_idx % 30 AS INTEGER) AS line_no, CAST(page_idx + 1 AS VARCHAR) AS number, 1 AS level, (page_idx + 1) || ' ' || w AS title, CAST(page_idx + 1 AS INTEGER) AS printed_page FROM t""",
    "contents_entries": """WITH t(page_idx, line_no, number, level, tail, printed) AS (VALUES (1, 0, '1', 1, NULL, NULL), (1, 1, '2', 1, '2 Terms', 4), (2, 0, '3', 1, '3 Long title', 6), (2, 1, 'B', 1, 'Annex B Notes', 0))
SELECT o_orderkey AS doc_id, page_idx, line_no, number, level, coalesce(tail, '1 Scope of no. ' || o_orderkey || ' in full') AS title, CAST(coalesce(printed, o_custkey % 90 + 1) AS INTEGER) AS printed_page FROM orders, t""",
    "font_headings": f"""WITH {_B}, s AS (SELECT doc_id, block_no + 2 AS page_idx, block_no AS span_no, text, CASE WHEN what > 6 THEN size + 4 ELSE size END AS size, bold, what FROM b WHERE y1 >= 65 AND y0 <= 635 AND length(text) >= 3),
bo AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY page_idx, span_no) AS k FROM s WHERE bold AND size >= 8 AND what = 6), m AS (SELECT doc_id, list(size ORDER BY size) AS l FROM s WHERE size >= 6 GROUP BY 1),
la AS (SELECT s.*, row_number() OVER (PARTITION BY s.doc_id, text ORDER BY page_idx, span_no) AS k FROM s JOIN m ON m.doc_id = s.doc_id WHERE s.doc_id NOT IN (SELECT doc_id FROM bo) AND size >= l[len(l) // 2 + 1] + 1.5 AND what IN (0, 1, 2, 6, 7) AND page_idx >= 3 AND page_idx < 19),
u AS (SELECT *, 'bold' AS how FROM bo WHERE k = 1 UNION ALL SELECT *, 'size' FROM la WHERE k = 1) SELECT doc_id, page_idx, span_no, CASE WHEN what = 6 THEN 2 ELSE 1 END AS level, text AS title, page_idx + 1 AS page, how FROM u""",
    "picked_outline": f"""WITH {_B}, {_OUT}, m AS (SELECT *, 0 AS method FROM o WHERE title LIKE '%Heading' AND doc_id IN (SELECT doc_id FROM o WHERE title LIKE '%Heading' GROUP BY 1 HAVING count(*) >= 3) UNION ALL SELECT *, 1 FROM o WHERE title LIKE 'Figure%' UNION ALL SELECT *, 2 FROM o),
f AS (SELECT *, min(method) OVER (PARTITION BY doc_id) AS first FROM m) SELECT doc_id, ord, title, method FROM f WHERE method = first""",
    "flushed_media": f"""WITH {_B}, m AS (SELECT doc_id, CASE WHEN what = 9 THEN '-1' ELSE CAST(number AS VARCHAR) END AS ref, min(CASE WHEN what % 4 <> 1 THEN page_idx END) AS page FROM b GROUP BY 1, 2),
p AS (SELECT doc_id, CAST(number AS VARCHAR) AS ref, arg_min(block_no, (CASE what WHEN 0 THEN 0 ELSE 1 END, block_no)) AS ord FROM b WHERE what IN (0, 8) AND (doc_id, CAST(number AS VARCHAR)) IN (SELECT doc_id, ref FROM m) GROUP BY 1, 2),
l AS (SELECT * FROM m WHERE (doc_id, ref) NOT IN (SELECT doc_id, ref FROM p) AND NOT (page IS NULL AND ref = '-1')), z AS (SELECT doc_id, page_idx, max(block_no) AS last FROM b GROUP BY 1, 2), e AS (SELECT doc_id, max(block_no) AS last FROM b GROUP BY 1)
SELECT doc_id, ref, ord::DOUBLE AS ord FROM p UNION ALL SELECT l.doc_id, l.ref, coalesce((SELECT arg_max(z.last, z.page_idx) FROM z WHERE z.doc_id = l.doc_id AND z.page_idx <= l.page), e.last) + 0.5::DOUBLE FROM l JOIN e ON e.doc_id = l.doc_id""",
    "inline_headers": f"""WITH {_B}, s AS (SELECT *, CASE WHEN page_idx = 0 THEN '2' ELSE '3' END AS section FROM b), h AS (SELECT *, what = 6 AND CAST(number AS VARCHAR) = section AS head FROM s)
SELECT doc_id, section, page_idx, block_no, head AS is_header, CASE WHEN max(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, section ORDER BY page_idx, block_no ROWS UNBOUNDED PRECEDING) = 1 THEN section || '.2' ELSE section END AS number FROM h""",
    "section_bodies": f"""WITH {_B}, f AS (SELECT *, max(CASE WHEN text = '2.2 Heading' THEN 1 ELSE 0 END) OVER w AS begun, max(CASE WHEN text <> '2.2 Heading' AND what IN (0, 6) THEN 1 ELSE 0 END) OVER w AS ended FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY page_idx, block_no ROWS UNBOUNDED PRECEDING))
SELECT doc_id, page_idx, block_no FROM f WHERE begun = 1 AND ended = 0 AND text <> '2.2 Heading'""",
}
