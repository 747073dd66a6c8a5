"""Page text: garble verdicts, block filtering, sections and media placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions import text as T

from .helpers import asof_last, keep_first

ORDER = ["page_idx", "block_no"]


def blocks_of(pages: DataFrame) -> DataFrame:
    """H27. (doc_id, page_idx, block_no, text) of page texts."""
    return pages.select("doc_id", "page_idx", F.posexplode(T.split_blocks(F.col("text"))).alias("block_no", "text"))


def drop_reason(block: Column, vision: Column | None = None) -> Column:
    """B11. Why a block goes, the first reason of the cascade; null where it stays."""
    key = F.lit(False) if vision is None else vision
    return (
        F.when(F.length(F.trim(block)) < 3, "short").when(F.substring(block, 1, 120).rlike(T.WATERMARK), "watermark").when(F.trim(block).rlike(T.PAGE_NUMBER), "page number")
        .when(F.trim(block).rlike(T.RUNNING_HEADER), "running header").when(key & (F.trim(block) == "Key"), "key").when(F.trim(block).rlike(T.RIGHTS_FOOTER), "rights footer")
    )


def block_filter(blocks: DataFrame, keys: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """B11, E17, E14. Adds drop_reason: the cascade, repeated footnotes, and all from the first back matter on."""
    reason = drop_reason(F.col("text"), F.col("vision") if "vision" in blocks.columns else None)
    first = F.row_number().over(Window.partitionBy(*keys, "text").orderBy(*ORDER))
    stop = F.max(F.col("text").rlike(T.BACK_MATTER).cast("int")).over(Window.partitionBy(*keys).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
    marked = blocks.withColumn("_n", first).withColumn("_stop", stop)
    note = F.col("text").rlike(T.FOOTNOTE) & (F.col("_n") > 1)
    return marked.withColumn("drop_reason", F.coalesce(reason, F.when(F.col("_stop") == 1, "back matter"), F.when(note, "repeated footnote"))).drop("_n", "_stop")


def band_filter(blocks: DataFrame, margin: float = 65.0) -> DataFrame:
    """B12. Without blocks that lie in the top or bottom margin."""
    return blocks.filter((F.col("y1") >= margin) & (F.col("y0") <= F.col("page_h") - margin))


def drop_layout_artifacts(blocks: DataFrame) -> DataFrame:
    """B13. Without ``(continued)`` captions and captions of a table after its first."""
    ref = T.table_ref(F.col("text"))
    n = F.row_number().over(Window.partitionBy("doc_id", ref).orderBy(*ORDER))
    return blocks.withColumn("_n", F.when(ref.isNotNull(), n)).filter(~F.col("text").rlike(T.TABLE_CONTINUED) & (F.coalesce("_n", F.lit(1)) == 1)).drop("_n")


def footnote_dedupe(blocks: DataFrame, section: str = "section") -> DataFrame:
    """E17. A footnote block with the same text is kept once a section."""
    n = F.row_number().over(Window.partitionBy("doc_id", section, "text").orderBy(*ORDER))
    return blocks.withColumn("_n", n).filter(~F.col("text").rlike(T.FOOTNOTE) | (F.col("_n") == 1)).drop("_n")


def tiny_media_filter(media: DataFrame, least: int = 2000) -> DataFrame:
    """B15. Without figures of few bytes and media captured outside the page range."""
    return media.filter(((F.col("kind") != "figure") | (F.col("n_bytes") >= least)) & F.col("page").between(F.col("first_page"), F.col("last_page")))


def route_extraction(docs: DataFrame, least: int = 500) -> DataFrame:
    """B17. Adds route: native for documents with styles, ocr where the text layer is short, else text."""
    return docs.withColumn("route", F.when(F.lower("filename").endswith(".docx"), "native").when(F.length(F.trim(F.coalesce("text", F.lit("")))) < least, "ocr").otherwise("text"))


def sample_pages(pages: DataFrame, n: int = 6) -> DataFrame:
    """E19. Pages 1, 1 + step, ... (n of them; step from the page count), page 0 only where it is alone."""
    total = F.count("*").over(Window.partitionBy("doc_id"))
    step = F.greatest(F.lit(1), F.floor((total - 1) / n))
    chosen = pages.withColumn("_total", total).withColumn("_step", step)
    picked = (F.col("_total") == 1) | ((F.col("page_idx") >= 1) & ((F.col("page_idx") - 1) % F.col("_step") == 0) & ((F.col("page_idx") - 1) / F.col("_step") < n))
    return chosen.filter(picked).drop("_total", "_step")


def page_verdicts(pages: DataFrame) -> DataFrame:
    """H25, H26. Adds garble_check (null: readable) and cipher_ratio; pages under ten characters aren't checked."""
    checked = F.length(F.trim(F.coalesce("text", F.lit("")))) >= 10
    return pages.withColumn("checked", checked).withColumn("garble_check", F.when(checked, T.garble_check(F.col("text")))).withColumn("cipher_ratio", F.when(checked, T.cipher_ratio(F.col("text"))))


def verdict_vote(verdicts: DataFrame) -> DataFrame:
    """D24. garbled by votes: two or more pages, or a third of them, judged garbled with confidence 0.6; none judged: clean."""
    yes = F.col("garbled") & (F.col("confidence") >= 0.6)
    out = verdicts.groupBy("doc_id").agg(F.count_if(yes).alias("n_garbled"), F.count("garbled").alias("n_judged"))
    return out.withColumn("garbled", (F.col("n_judged") > 0) & ((F.col("n_garbled") >= 2) | (F.col("n_garbled") / F.col("n_judged") >= 0.34)))


def doc_garble(pages: DataFrame, votes: DataFrame | None = None, n: int = 6) -> DataFrame:
    """D23. Verdict of each document and the signal that gave it: text, cipher, votes, or none for clean ones."""
    v = page_verdicts(sample_pages(pages, n))
    out = v.groupBy("doc_id").agg(F.count_if("checked").alias("n_checked"), F.avg(F.when(F.col("checked"), F.col("garble_check").isNotNull().cast("double"))).alias("share"), F.avg("cipher_ratio").alias("mean"), F.max("cipher_ratio").alias("most"))
    if votes is not None:
        out = out.join(verdict_vote(votes).select("doc_id", F.col("garbled").alias("voted")), "doc_id", "left")
    else:
        out = out.withColumn("voted", F.lit(False))
    signal = F.when((F.col("n_checked") == 0) | (F.col("share") >= 0.5), "text").when((F.col("mean") > 0.05) | (F.col("most") > 0.20), "cipher").when(F.col("voted"), "votes")
    return out.select("doc_id", "n_checked", signal.isNotNull().alias("garbled"), F.coalesce(signal, F.lit("none")).alias("signal"))


def section_blocks(blocks: DataFrame, is_heading: Column, stops: Column) -> DataFrame:
    """E14. Blocks of a section after its own heading, up to the first stop heading."""
    w = Window.partitionBy("doc_id", "section").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    begun = F.max(is_heading.cast("int")).over(w)
    ended = F.max((stops & ~is_heading).cast("int")).over(w)
    marked = blocks.withColumn("_b", begun).withColumn("_e", ended).withColumn("_h", is_heading)
    return marked.filter("_b = 1 and _e = 0 and not _h").drop("_b", "_e", "_h")


def inline_subsections(blocks: DataFrame) -> DataFrame:
    """E15. Adds is_header and number: short numbered blocks under the section become headers and the running number.

    A header is of at most 200 characters and four lines, no long sentence, and lies under the section's number.
    """
    number = T.section_number(F.split("text", "\n")[0])
    lines = F.size(F.split("text", "\n"))
    sentence = (F.length("text") > 80) & F.col("text").rlike(r"[.;]\s*$")
    header = number.isNotNull() & (F.length("text") <= 200) & (lines <= 4) & ~sentence & F.startswith(number, F.concat(F.col("section"), F.lit(".")))
    w = Window.partitionBy("doc_id", "section").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("is_header", F.coalesce(header, F.lit(False))).withColumn("number", F.coalesce(F.last(F.when(F.col("is_header"), number), ignorenulls=True).over(w), F.col("section")))


def sub_item_path(blocks: DataFrame) -> DataFrame:
    """E16. Adds path: the markers a), 1), ii) that enclose a block; a marker clears the deeper ones, a page or header clears all.

    The first pattern that fits decides the level, so ``i)`` is level 0; the path ends at the first empty level.
    """
    t = F.col("text")
    patterns = [r"^([a-z])\)\s+", r"^(\d+)\)\s+", r"(?i)^([ivxlcdm]+)\)\s+"]
    level = F.when(t.rlike(patterns[0]), 0).when(t.rlike(patterns[1]), 1).when(t.rlike(patterns[2]), 2)
    marker = F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in patterns])
    base = blocks.withColumn("_level", level).withColumn("_marker", marker)
    w = Window.partitionBy("doc_id", "section").orderBy(*ORDER)
    run = F.sum((F.coalesce(F.lag("page_idx").over(w) != F.col("page_idx"), F.lit(True)) | F.coalesce(F.col("is_header") if "is_header" in blocks.columns else F.lit(False), F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    base = base.withColumn("_run", run)
    inside = Window.partitionBy("doc_id", "section", "_run").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct("page_idx", "block_no")
    for k in range(3):
        base = base.withColumn(f"_m{k}", F.last(F.when(F.col("_level") == k, F.struct(place.alias("p"), F.col("_marker").alias("m"))), ignorenulls=True).over(inside))
    m0 = F.col("_m0")
    m1 = F.when(m0.isNull() | (F.col("_m1.p") > m0["p"]), F.col("_m1"))
    shallow = F.greatest(m0["p"], F.col("_m1.p"))
    m2 = F.when(shallow.isNull() | (F.col("_m2.p") > shallow), F.col("_m2"))
    path = F.when(m0.isNull(), "").when(m1.isNull(), m0["m"]).when(m2.isNull(), F.concat_ws(".", m0["m"], m1["m"])).otherwise(F.concat_ws(".", m0["m"], m1["m"], m2["m"]))
    return base.withColumn("path", path).drop("_level", "_marker", "_run", "_m0", "_m1", "_m2")


def emit_once(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """E18. First occurrence of each media key in a document."""
    return keep_first(rows, ["doc_id", *keys], order)


def caption_of(block: Column) -> Column:
    """H28. struct(kind, ref) of a caption block; null otherwise."""
    fig, tab, formula = T.figure_number(block), T.table_ref(block), T.formula_number(block)
    kind = F.when(fig.isNotNull(), "figure").when(tab.isNotNull(), "table").when(formula.isNotNull(), "formula")
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.coalesce(fig, tab, formula).alias("ref")))


def place_media(rows: DataFrame, media: DataFrame) -> DataFrame:
    """C28. (doc_id, ord, kind, ref, how): each medium once, at its caption if one is in range, else at its first reference."""
    captions = rows.select("doc_id", "ord", caption_of(F.col("text")).alias("c")).filter("c is not null").select("doc_id", "ord", "c.*", F.lit("caption").alias("how"), F.lit(0).alias("rank"))
    refs = rows.select("doc_id", "ord", F.explode(T.mentions(F.col("text"))).alias("c")).select("doc_id", "ord", "c.*", F.lit("reference").alias("how"), F.lit(1).alias("rank"))
    found = captions.unionByName(refs).join(media.select("doc_id", "kind", "ref").distinct(), ["doc_id", "kind", "ref"], "left_semi")
    return keep_first(found, ["doc_id", "kind", "ref"], ["rank", "ord"]).drop("rank")


def flush_media(rows: DataFrame, media: DataFrame, placed: DataFrame) -> DataFrame:
    """C29. Insert places of media not placed: after the last row of the section that owns their page (the latest start), else at the end.

    ``rows``: doc_id, ord, section, page; an unlabelled medium (negative ref) without a page is dropped.
    """
    left = media.join(placed.select("doc_id", "kind", "ref"), ["doc_id", "kind", "ref"], "left_anti").filter(~(F.col("page").isNull() & F.startswith("ref", F.lit("-"))))
    sections = rows.groupBy("doc_id", "section").agg(F.min("page").alias("start"), F.max("ord").alias("last_ord"))
    ends = rows.groupBy("doc_id").agg(F.max("ord").alias("end_ord"))
    owned = asof_last(left, sections.withColumnRenamed("last_ord", "ord").withColumn("after", F.col("ord")), ["doc_id"], "page", "start", ["section", "after"])
    return owned.join(ends, "doc_id", "left").select("doc_id", "kind", "ref", "section", (F.coalesce("after", "end_ord") + 0.5).alias("ord"))
