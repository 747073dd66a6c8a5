"""Positioned blocks, boxes, captions and formulas of pages; the page is the hash key of every join."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions import text as T
from parchment.tables import saved

from .graph import components
from .helpers import area, asof_last, gap_groups, hanging, iou, keep_first, meeting, rect_join
from .scans import PLACES, next_greater, running

PAGE = ["doc_id", "page_idx"]


def boxes_area() -> Column:
    return area(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))


def suppress_inside(blocks: DataFrame, regions: DataFrame, share: float = 0.5) -> DataFrame:
    """C19. Blocks not covered by a region; figure captions pass through figure regions."""
    covered = rect_join(blocks.select(*PAGE, "block_no", "text", "x0", "y0", "x1", "y1"), regions.select(*PAGE, "kind", "x0", "y0", "x1", "y1"), PAGE, share)
    gone = covered.filter(~((F.col("b_kind") == "figure") & T.figure_number(F.col("a_text")).isNotNull())).select(*PAGE, F.col("a_block_no").alias("block_no")).distinct()
    return blocks.join(gone, [*PAGE, "block_no"], "left_anti")


def filter_formulas(candidates: DataFrame, regions: DataFrame, most: float = 0.20) -> DataFrame:
    """C20. Formula boxes of some size that no region covers by more than a fifth. ``candidates``: id and box."""
    sized = candidates.filter((F.col("x1") - F.col("x0") >= 20) & (F.col("y1") - F.col("y0") >= 8))
    hit = rect_join(sized.select(*PAGE, "id", "x0", "y0", "x1", "y1"), regions.select(*PAGE, "x0", "y0", "x1", "y1"), PAGE, most).select(*PAGE, F.col("a_id").alias("id")).distinct()
    return sized.join(hit, [*PAGE, "id"], "left_anti")


def drop_tables_in_figures(tables: DataFrame, figures: DataFrame, share: float = 0.60) -> DataFrame:
    """C21."""
    hit = rect_join(tables.select(*PAGE, "id", "x0", "y0", "x1", "y1"), figures.select(*PAGE, "x0", "y0", "x1", "y1"), PAGE, share).select(*PAGE, F.col("a_id").alias("id")).distinct()
    return tables.join(hit, [*PAGE, "id"], "left_anti")


def best_box_match(a: DataFrame, b: DataFrame, least: float = 0.10, keys: list[str] = PAGE) -> DataFrame:
    """C22. Every box of ``a`` (id) with the box of ``b`` of the highest intersection over union, null under the floor."""
    box = [*keys, "id", "x0", "y0", "x1", "y1"]
    pairs = rect_join(a.select(*box), b.select(*box), keys).withColumn("iou", iou()).filter(F.col("iou") >= least)
    best = pairs.groupBy(*keys, "a_id").agg(F.max_by(F.struct("b_id", "iou"), F.struct("iou", -F.col("b_id"))).alias("m"))
    return a.select(*keys, "id").join(best.select(*keys, F.col("a_id").alias("id"), F.col("m.b_id").alias("match"), F.col("m.iou").alias("iou")), [*keys, "id"], "left")


def claim_caption_above(tables: DataFrame, blocks: DataFrame, gap: float = 40.0) -> DataFrame:
    """C23. Tables (by id) with the ``Table`` blocks (by block_no) that end at most ``gap`` above them, or 5 into them.

    A table grows up to the top of each block that it claims, so it may reach further ones; a block goes to one
    table.  Returned: the first block claimed and its text, the grown top, and how many were claimed.  Only what lies
    within reach is folded together: parts of a page that no claim can bridge are rows of their own.
    """
    caps = blocks.filter(F.col("text").rlike("(?i)^table ")).select(*PAGE, F.col("block_no").cast("long").alias("ord"), F.col("y0").alias("top"), F.col("y1").alias("bottom"), "text", F.lit(False).alias("is_table"))
    both = tables.select(*PAGE, F.col("id").cast("long").alias("ord"), F.col("y0").alias("top"), (F.col("y0") + 5).alias("bottom"), F.lit(None).cast("string").alias("text"), F.lit(True).alias("is_table")).unionByName(caps)
    reach = both.withColumn("low", F.least("top", "bottom") - gap).withColumn("high", F.greatest("bottom", F.col("top") + 5))
    item = F.struct("ord", "top", "bottom", "text")
    of = lambda is_table: F.array_sort(F.collect_list(F.when(F.col("is_table") == is_table, item)))
    parts = gap_groups(reach, PAGE, "low", "high", 0.0).groupBy(*PAGE, "group_no").agg(of(True).alias("tables"), of(False).alias("caps")).filter((F.size("tables") > 0) & (F.size("caps") > 0))
    none = F.array().cast("array<bigint>")

    def claim(s: Column, t: Column) -> Column:
        def one(own: Column, c: Column) -> Column:
            ok = (c["bottom"] <= own["top"] + 5) & (own["top"] - c["bottom"] <= gap) & ~F.array_contains(s["used"], c["ord"])
            return F.when(ok, F.struct(F.least(own["top"], c["top"]).alias("top"), F.concat(own["taken"], F.array(c["ord"])).alias("taken"))).otherwise(own)

        own = F.aggregate("caps", F.struct(t["top"].alias("top"), none.alias("taken")), one)
        return F.struct(F.concat(s["used"], own["taken"]).alias("used"), F.concat(s["out"], F.array(F.struct(t["ord"].alias("id"), own["top"].alias("top"), own["taken"].alias("taken")))).alias("out"))

    start = F.struct(none.alias("used"), F.array().cast("array<struct<id:bigint,top:double,taken:array<bigint>>>").alias("out"))
    claimed = parts.select(*PAGE, "caps", F.explode(F.aggregate("tables", start, claim, lambda s: s["out"])).alias("t")).filter(F.size("t.taken") > 0)
    first = F.get("t.taken", F.lit(0))
    text = F.get(F.filter("caps", lambda c: c["ord"] == first), F.lit(0))["text"]
    return claimed.select(*PAGE, "t.id", first.alias("block_no"), text.alias("text"), F.col("t.top").alias("y0"), F.size("t.taken").alias("n_claimed"))


def caption_near(regions: DataFrame, texts: DataFrame, pattern: str, above: bool = True) -> DataFrame:
    """C24. Caption of a region by block order: the last one among the first blocks down to it, or the first one below.

    ``regions``: id and y0, y1 as shares of the page; ``texts``: doc_id, page_idx, blocks (array).
    """
    r = regions.join(texts.select(*PAGE, "blocks"), PAGE)
    n = F.size("blocks")
    up = F.slice("blocks", F.lit(1), F.greatest(F.lit(1), F.floor(F.col("y0") * n).cast("int") + 2))
    down = F.slice("blocks", F.greatest(F.lit(0), F.floor(F.col("y1") * n).cast("int") - 1) + 1, n)
    hit = F.filter(up if above else down, lambda b: b.rlike(pattern))
    return r.select(*PAGE, "id", F.get(hit, F.size(hit) - 1 if above else F.lit(0)).alias("caption"))


def _stitched(batches: Iterator[pa.RecordBatch], every: bool) -> Iterator[pa.RecordBatch]:
    """Refs of tables that come stretch by stretch, in page order; only the tables of the last pages are held.

    ``held`` has of each ref the place of its first caption, and by page the sides of its tables (the latest one's unless ``every``).
    """
    stretch, on, held = None, None, {}
    for batch in batches:
        column = {c: batch.column(c).to_pylist() for c in ("doc_id", "stretch", "page_idx", "ref", "seen", "x0", "x1", "near_figure")}
        refs = []
        for doc, part, page, ref, seen, x0, x1, near_figure in zip(*column.values()):
            if (doc, part) != stretch:
                stretch, on, held = (doc, part), page, {}
            if page != on:
                on = page
                recent = {r: (first, {p: sides for p, sides in pages.items() if page - p <= 2}) for r, (first, pages) in held.items()}
                held = {r: v for r, v in recent.items() if v[1]}
            sided = x0 is not None and x1 is not None
            if ref is None and not near_figure and sided and x1 > x0:
                covers = lambda sides: any((min(b, x1) - max(a, x0)) / (x1 - x0) >= 0.5 for a, b in sides)  # noqa: B023, E731
                near = [(-p, first, r) for r, (first, pages) in held.items() for p, sides in pages.items() if p < page and covers(sides)]
                if near:
                    ref = min(near)[2]
                    seen = held[ref][0]
            if ref is not None and sided:
                if not every or ref not in held:
                    held[ref] = (seen, {})
                held[ref][1].setdefault(page, set()).add((x0, x1))
            refs.append(ref)
        kept = batch.drop_columns(["stretch", "seen"])
        yield pa.record_batch([*kept.columns, pa.array(refs, pa.string())], names=[*kept.schema.names, "stitched_ref"])


def stitch_table_pages(tables: DataFrame, width: float = PLACES, every: bool = False) -> DataFrame:
    """C25. Uncaptioned tables take the ref of which the latest table (captioned, or stitched to it) is one or two pages back and covers half their width.

    With ``every``, each table of a ref one or two pages back may cover it, not its latest alone.  Of several the
    latest page's counts, on one page the ref that was captioned first in the document.  ``tables``:
    doc_id, page_idx, id, ref (null: uncaptioned), x0, x1, near_figure.  Nothing reaches over two pages without a
    table, so a document falls into stretches of pages that are stitched apart; a stretch streams through its task.
    """
    columns = tables.select("doc_id", F.col("page_idx").cast("long").alias("page_idx"), "id", "ref", "x0", "x1", "near_figure")
    pages = columns.select("doc_id", (-F.col("page_idx")).alias("_back")).distinct()
    pages = saved(next_greater(pages, ["doc_id"], "_back", "_before", width).select("doc_id", (-F.col("_back")).alias("page_idx"), F.coalesce(F.col("_before") - F.col("_back") > 2, F.lit(True)).cast("int").alias("_begins")), "pages")
    pages = running(pages, ["doc_id"], ["page_idx"], "_begins", "stretch", "sum", width).select("doc_id", "page_idx", "stretch")
    place = F.concat(F.lpad(F.col("page_idx").cast("string"), 20, "0"), F.lit("/"), F.lpad(F.col("id").cast("string"), 20, "0"))
    seen = columns.filter("ref is not null").groupBy("doc_id", "ref").agg(F.min(place).alias("seen"))
    placed = columns.join(pages, ["doc_id", "page_idx"]).join(seen, ["doc_id", "ref"], "left").select(*columns.columns, "stretch", "seen")
    placed = placed.repartition("doc_id", "stretch").sortWithinPartitions("doc_id", "stretch", "page_idx", "id")
    return placed.mapInArrow(lambda batches: _stitched(batches, every), f"{', '.join(f'{n} {t}' for n, t in columns.dtypes)}, stitched_ref string")


def figure_caption_by_overlap(figures: DataFrame, model: DataFrame, near: DataFrame) -> DataFrame:
    """C26, E21. ref of each figure: the captioned model box of which the figure covers the largest share, else one without a box, else the nearby caption, else -1, -2, ..."""
    boxed = rect_join(model.filter("ref is not null and x0 is not null").select(*PAGE, "ref", "x0", "y0", "x1", "y1"), figures.select(*PAGE, "id", "x0", "y0", "x1", "y1"), PAGE)
    by_box = boxed.groupBy(*PAGE, "b_id").agg(F.max_by("a_ref", F.struct("share", "a_ref")).alias("r1")).withColumnRenamed("b_id", "id")
    loose = model.filter("ref is not null and x0 is null").groupBy(*PAGE).agg(F.min("ref").alias("r2"))
    out = figures.join(by_box, [*PAGE, "id"], "left").join(loose, PAGE, "left").join(near.select(*PAGE, "id", F.col("ref").alias("r3")), [*PAGE, "id"], "left")
    out = out.withColumn("ref", F.coalesce("r1", "r2", "r3")).drop("r1", "r2", "r3")
    return negative_ids(out)


def negative_ids(media: DataFrame) -> DataFrame:
    """E21. Unlabelled media are numbered -1, -2, ... in capture order within a document."""
    w = Window.partitionBy("doc_id").orderBy("page_idx", "id")
    k = F.sum(F.col("ref").isNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return media.withColumn("ref", F.coalesce("ref", (-k).cast("string")))


def fill_missing_media(captured: DataFrame, model: DataFrame) -> DataFrame:
    """C33. Captioned model boxes (four numbers) whose ref wasn't captured are added."""
    new = model.filter((F.size("bbox") == 4) & F.col("ref").isNotNull()).join(captured.select("doc_id", "kind", "ref"), ["doc_id", "kind", "ref"], "left_anti")
    return captured.unionByName(new.select(*captured.columns))


def expand_figure_box(detected: DataFrame, model: DataFrame) -> DataFrame:
    """C34. A figure's box united with the first captioned model box that covers 0.30 of its width and 0.20 of its height."""
    sides = ("x0", "y0", "x1", "y1")
    both = meeting(detected.select(*PAGE, "id", *sides), model.filter("ref is not null").select(*PAGE, "ord", *sides), PAGE)
    wide = (F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0")) / (F.col("a_x1") - F.col("a_x0"))
    high = (F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0")) / (F.col("a_y1") - F.col("a_y0"))
    first = both.filter((wide >= 0.30) & (high >= 0.20)).groupBy(*PAGE, F.col("a_id").alias("id")).agg(F.min_by(F.struct(*[F.col(f"b_{c}").alias(f"m_{c}") for c in sides]), "b_ord").alias("m"))
    out = detected.join(first, [*PAGE, "id"], "left")
    return out.select(*PAGE, "id", *[F.coalesce((F.least if c.endswith("0") else F.greatest)(F.col(c), F.col(f"m.m_{c}")), F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")])


def dominant_style(spans: DataFrame) -> DataFrame:
    """D26. Of each block the (size, italic, bold) with the most characters, and the page's body size."""
    n = spans.groupBy(*PAGE, "block_no", "size", "italic", "bold").agg(F.sum(F.length("text")).alias("n"))
    block = n.groupBy(*PAGE, "block_no").agg(F.max_by(F.struct("size", "italic", "bold"), F.struct("n", "size", "italic", "bold")).alias("s")).select(*PAGE, "block_no", "s.*")
    page = n.groupBy(*PAGE, "size").agg(F.sum("n").alias("n")).groupBy(*PAGE).agg(F.max_by("size", F.struct("n", "size")).alias("body_size"))
    return block.join(page, PAGE)


def table_envelope(cells: DataFrame, layout: DataFrame) -> DataFrame:
    """D28. Boxes of tables around their cells; layout boxes only on pages without any cell."""
    own = cells.groupBy(*PAGE, "table_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    rest = layout.join(own.select(*PAGE).distinct(), PAGE, "left_anti").select(*own.columns)
    return own.unionByName(rest)


def cluster_boxes(boxes: DataFrame, gap: float = 30.0) -> DataFrame:
    """D29. Adds cluster, the smallest id of the boxes (over 3 wide and high) that hang together: two at most ``gap`` apart do.

    Boxes hang together by cells of their page's grid, without all their pairs, and what does is found by contracting the links: no page is one task.
    """
    rows = boxes.filter((F.col("x1") - F.col("x0") > 3) & (F.col("y1") - F.col("y0") > 3)).select(*PAGE, F.col("id").cast("long").alias("id"), "x0", "y0", "x1", "y1")
    # ids of pages without one meet nothing
    padded = rows.select(*PAGE, "id", (F.col("x0") - gap).alias("x0"), (F.col("y0") - gap).alias("y0"), (F.col("x1") + gap).alias("x1"), (F.col("y1") + gap).alias("y1"))
    of = components(hanging(padded, rows, PAGE), PAGE)
    return rows.join(of.withColumnRenamed("node", "id"), [*PAGE, "id"], "left").withColumn("cluster", F.coalesce("component", "id")).drop("component")


def real_figures(paths: DataFrame, clusters: DataFrame, blocks: DataFrame, page_w: float) -> DataFrame:
    """D30. Clusters that are figures: six paths; else little text and a curve or a fill that isn't white; not far right."""
    p = paths.groupBy(*PAGE, F.col("cluster").alias("id")).agg(F.count("*").alias("n"), F.bool_or("curve").alias("curve"), F.bool_or(F.coalesce(F.col("fill") != "white", F.lit(False))).alias("fill"))
    text = rect_join(clusters.select(*PAGE, "id", "x0", "y0", "x1", "y1"), blocks.select(*PAGE, "x0", "y0", "x1", "y1"), PAGE).groupBy(*PAGE, F.col("a_id").alias("id")).agg(F.sum("share").alias("covered"))
    out = clusters.join(p, [*PAGE, "id"]).join(text, [*PAGE, "id"], "left")
    ok = (F.col("n") >= 6) | ((F.coalesce("covered", F.lit(0.0)) <= 0.10) & (F.col("curve") | F.col("fill")))
    return out.filter(ok & (F.col("x0") <= 0.82 * page_w)).select(*clusters.columns)


def first_capture(media: DataFrame) -> DataFrame:
    """D32. First page and pages in order of each (kind, ref)."""
    return media.groupBy("doc_id", "kind", "ref").agg(F.min("page_idx").alias("first_page"), F.array_sort(F.collect_set("page_idx")).alias("pages"))


def text_lines(spans: DataFrame, gap: float = 26.0) -> DataFrame:
    """E13. Blocks of spans with vertical gaps of at most ``gap``."""
    return gap_groups(spans, PAGE, "y0", "y1", gap)


def running_extent(tables: DataFrame) -> DataFrame:
    """E20. Widest x-range of a table up to each page, after snapping to the margins (x0 < 0.30 and x1 < 0.85: 0.05 to 0.88)."""
    snap = (F.col("x0") < 0.30) & (F.col("x1") < 0.85)
    t = tables.withColumn("x0", F.when(snap, 0.05).otherwise(F.col("x0"))).withColumn("x1", F.when(snap, 0.88).otherwise(F.col("x1")))
    w = Window.partitionBy("doc_id", "ref").orderBy("page_idx").rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("x0", F.min("x0").over(w)).withColumn("x1", F.max("x1").over(w))


def clip_below_next(figures: DataFrame) -> DataFrame:
    """E23. A figure's bottom ends at the highest top of the page's figures with a higher number, wherever they lie."""
    w = Window.partitionBy(*PAGE).orderBy("number").rangeBetween(1, Window.unboundedFollowing)
    return figures.withColumn("y1", F.least("y1", F.min("y0").over(w)))


def numbered_formulas(blocks: DataFrame, pad_x: float = 20.0, pad_y: float = 5.0) -> DataFrame:
    """E24. First block of each formula number, without watermarks, clipped with some room."""
    f = blocks.withColumn("number", T.formula_number(F.col("text"))).filter(F.col("number").isNotNull() & ~F.substring("text", 1, 120).rlike(T.WATERMARK) & (F.col("y1") - F.col("y0") > 5))
    first = keep_first(f, ["doc_id", "number"], ["page_idx", "block_no"])
    return first.select("doc_id", "number", "page_idx", (F.col("x0") - pad_x).alias("x0"), (F.col("y0") - pad_y).alias("y0"), (F.col("x1") + pad_x).alias("x1"), (F.col("y1") + pad_y).alias("y1"))


def expand_clip(boxes: DataFrame, footer: float = 10.0) -> DataFrame:
    """H45. Shares of the page as points with room above (20, or 55 on a continuation) and below (90), kept on the page; thin clips go."""
    top = F.when(F.col("is_continuation"), 55.0).otherwise(20.0)
    out = boxes.select(
        *PAGE, "id", (F.col("x0") * F.col("page_w")).alias("x0"), F.greatest(F.lit(0.0), F.col("y0") * F.col("page_h") - top).alias("y0"),
        (F.col("x1") * F.col("page_w")).alias("x1"), F.least(F.col("page_h") - footer, F.col("y1") * F.col("page_h") + 90).alias("y1"),
    )
    return out.filter("y1 - y0 > 5 and x1 - x0 > 5")


def asof_heading_y(items: DataFrame, headings: DataFrame) -> DataFrame:
    """C15. Items with the nearest heading above them on their page; where all are below, the entry before the page's first."""
    h = headings.select(*PAGE, "ord", "title", F.col("y0").alias("hy"))
    above = asof_last(items.select(*PAGE, "id", "y0"), h, PAGE, "y0", "hy", ["title"])
    first = h.groupBy(*PAGE).agg(F.min("ord").alias("first"))
    before = headings.groupBy("doc_id", "ord").agg(F.min("title").alias("before_title")).select("doc_id", (F.col("ord") + 1).alias("first"), "before_title")
    out = above.join(first, PAGE, "left").join(before, ["doc_id", "first"], "left")
    return out.select(*PAGE, "id", F.coalesce("title", "before_title").alias("title"))


def preceding_anchor(items: DataFrame, blocks: DataFrame) -> DataFrame:
    """C16. Last 60 characters of the nearest block of ten or more characters above an item, else of a short one; no watermarks or page numbers."""
    b = blocks.filter(~F.substring("text", 1, 120).rlike(T.WATERMARK) & ~F.trim("text").rlike(T.PAGE_NUMBER)).select(*PAGE, F.trim("text").alias("text"), F.col("y1").alias("by1"))
    found = items.select(*PAGE, "id", (F.col("y0") + 2).alias("reach"))
    for name, own in (("far", b.filter(F.length("text") >= 10)), ("near", b.filter(F.length("text") < 10))):
        found = asof_last(found, own.groupBy(*PAGE, "by1").agg(F.max("text").alias(name)), PAGE, "reach", "by1", [name])
    text = F.coalesce("far", "near")
    return found.filter(text.isNotNull()).select(*PAGE, "id", F.substring(text, F.greatest(F.lit(1), F.length(text) - 59), F.lit(60)).alias("anchor"))


def formula_bands(lines: DataFrame) -> DataFrame:
    """H35. Lines that look like formulas on their own: few letters, not wide, of some size, and symbols or two fonts."""
    letters = F.length(F.regexp_replace("text", r"\P{L}", ""))
    symbols = F.length("text") - F.length(F.regexp_replace("text", T.MATH_CHARACTERS, ""))
    size = (F.col("x1") - F.col("x0") >= 12) & (F.col("y1") - F.col("y0") >= 6) & (F.col("x1") - F.col("x0") <= 0.8 * F.col("page_w"))
    return lines.filter((letters <= 40) & size & ((symbols >= 2) | (F.col("n_fonts") >= 2)))


def detected_formulas(by_line: DataFrame, by_band: DataFrame) -> DataFrame:
    """G5. What either detector found."""
    return by_line.unionByName(by_band, allowMissingColumns=True).dropDuplicates([*PAGE, "x0", "y0", "x1", "y1"])


def overlap_pairs(a: DataFrame, b: DataFrame, share: float, keys: list[str] = PAGE) -> DataFrame:
    """C18. Pairs of boxes with more than ``share`` of a's area in b."""
    return rect_join(a, b, keys, share)

