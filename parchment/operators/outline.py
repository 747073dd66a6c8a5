"""Outlines: detection, clean-up, page ranges and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions import text as T
from parchment.tables import saved

from .helpers import asof_last, contains_join, keep_first
from .scans import PLACES, next_greater, running, upper_medians


# Texts of heading size that are no headings.
NO_HEADING = (
    r"(?i)^(BS\s+)?ISO[\s/]",
    r"(?i)^IEC\s",
    r"(?i)^(INTERNATIONAL|EUROPEAN)\s",
    r"(?i)^(BSI|ANSI|AAMI|DIN|EN)\b",
    r"(?i)^(British Standards Institution)",
    r"^\d{4,}",
    r"(?i)^Copyrighted|^No further|^All rights",
    r"(?i)^\(normative\)|^\(informative\)",
)


#: Short titles that are broadcast at most.
FEW_TITLES = 256


def heading_candidates(lines: DataFrame) -> DataFrame:
    """H32, E7. Outline entries of page lines: the first line of each number. ``lines``: doc_id, page_idx, line_no, text."""
    found = lines.withColumn("num", T.heading_number(F.col("text"))).filter("num is not null and not substring(text, 1, 120) rlike '(?i)Copyrighted material|licensed to|Techstreet'")
    first = keep_first(found, ["doc_id", F.lower("num")], ["page_idx", "line_no"])
    return first.select("doc_id", "page_idx", "line_no", T.outline_level(F.col("num")).alias("level"), F.trim("text").alias("title"), (F.col("page_idx") + 1).alias("page"))


def heading_by_font(spans: DataFrame) -> DataFrame:
    """H33, D27. Entries by type: bold numbered spans from 8 pt; documents without any: spans from 1.5 pt above the median size.

    ``spans``: doc_id, page_idx, span_no, text, size, bold, y0, y1, page_h, n_pages.
    """
    s = spans.withColumn("text", F.trim("text")).filter((F.col("y1") >= 65) & (F.col("y0") <= F.col("page_h") - 65) & (F.length("text") >= 3))
    numbered = F.col("text").rlike(r"^(\d+(?:\.\d+)*)\s+\S") | F.col("text").rlike(r"(?i)^(Annex\s+[A-Z])\b")
    bold = keep_first(s.filter(F.col("bold") & (F.col("size") >= 8) & numbered), ["doc_id", "text"], ["page_idx", "span_no"])
    limit = upper_medians(s.filter("size >= 6"), ["doc_id"], "size", "least").withColumn("least", F.col("least") + 1.5)
    skip = F.substring("text", 1, 120).rlike(T.WATERMARK) | ~F.col("text").rlike(r"^[\p{Lu}\p{Nd}]")
    for pattern in NO_HEADING:
        skip = skip | F.col("text").rlike(pattern)
    large = s.join(bold.select("doc_id").distinct(), "doc_id", "left_anti").join(limit, "doc_id").filter((F.col("size") >= F.col("least")) & ~skip & (F.length("text") <= 80) & (F.col("page_idx") >= 3) & (F.col("page_idx") < F.col("n_pages") - 1))
    large = keep_first(large, ["doc_id", "text"], ["page_idx", "span_no"])
    one = lambda df, how: df.select("doc_id", "page_idx", "span_no", T.outline_level(F.col("text")).alias("level"), F.col("text").alias("title"), (F.col("page_idx") + 1).alias("page"), F.lit(how).alias("how"))
    return one(bold, "bold").unionByName(one(large, "size"))


def contents_pages(pages: DataFrame) -> DataFrame:
    """E11. Pages of the first run of contents pages: a ``Contents`` line or a dot run, from the first page that yields an entry."""
    lines = F.split("text", "\n")
    is_contents = F.exists(lines, lambda x: F.lower(F.trim(x)) == "contents") | F.exists(lines, lambda x: x.rlike(r"\.{6,}"))
    yields = F.exists(lines, lambda x: T.contents_line(x).isNotNull())
    w = Window.partitionBy("doc_id").orderBy("page_idx")
    flagged = pages.withColumn("_c", is_contents).filter("_c").withColumn("_y", yields).withColumn("_island", F.col("page_idx") - F.row_number().over(w))
    first = flagged.filter("_y").groupBy("doc_id").agg(F.min_by("_island", "page_idx").alias("_first"), F.min("page_idx").alias("_from"))
    return flagged.join(first, "doc_id").filter("_island = _first and page_idx >= _from").drop("_c", "_y", "_island", "_first", "_from")


def reflow_lines(lines: Column, most: int = 2) -> Column:
    """E12. Contents lines with up to ``most`` following lines joined until they are an entry."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("n"))

    def step(s: Column, line: Column) -> Column:
        text = F.when(s["open"].isNull(), F.trim(line)).otherwise(F.concat_ws(" ", s["open"], F.trim(line)))
        done = T.contents_line(text).isNotNull()
        full = s["n"] >= most
        push = lambda x: F.concat(s["out"], F.array(x))
        new = lambda out, o, n: F.struct(out.alias("out"), o.alias("open"), n.alias("n"))
        empty = F.lit(None).cast("string")
        return F.when(F.lower(F.trim(line)).isin("", "contents"), s).when(done, new(push(text), empty, F.lit(0))).when(full, new(push(s["open"]), F.trim(line), F.lit(1))).otherwise(new(s["out"], text, s["n"] + 1))

    return F.aggregate(lines, start, step, lambda s: F.when(s["open"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["open"]))))


def contents_entries(pages: DataFrame) -> DataFrame:
    """E11, E12, H31. Entries read from contents pages, in order."""
    lines = contents_pages(pages).select("doc_id", "page_idx", F.posexplode(reflow_lines(F.split("text", "\n"))).alias("line_no", "line"))
    return lines.select("doc_id", "page_idx", "line_no", T.contents_line(F.col("line")).alias("e")).filter("e is not null").select("doc_id", "page_idx", "line_no", "e.*")


def title_to_page(titles: DataFrame, pages: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """C27. First page (with the smallest offset in its first 60 lines) that has a title as a line, a numbered line, or anywhere.

    ``titles``: doc_id, ord, title; contents pages are left out; titles found only further down take the first such page.
    Pages without a document are one document; titles without a doc_id are looked for in every document; other columns are left out.
    """
    if contents is not None:
        pages = pages.join(contents.select("doc_id", "page_idx"), ["doc_id", "page_idx"], "left_anti")
    # an inner word of a title stands in a page's text as a word: the longest one is the key of a hash join
    keyed = "doc_id" in titles.columns
    t = titles.select(*["doc_id"] * keyed, "ord", "title", F.lower(F.trim("title")).alias("_t")).filter("_t <> ''")
    inner = F.slice(F.split("_t", " "), F.lit(2), F.greatest(F.size(F.split("_t", " ")) - 2, F.lit(0)))
    t = t.withColumn("_w", F.nullif(F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"], F.lit("")))
    words = pages.select(F.col("doc_id").alias("_doc"), "page_idx", F.explode(F.array_distinct(F.split(F.lower("text"), "[ \n]"))).alias("_word"))
    same = F.col("_word") == F.col("_w")
    long = t.filter("_w is not null").join(words, F.col("doc_id").eqNullSafe(F.col("_doc")) & same if keyed else same).drop("_word")
    # titles of one or two words have none: few are held against every text, more go by their longest word, which is
    # within a word of the text and found by its rarest run
    short = t.filter("_w is null").withColumn("_part", F.array_max(F.transform(F.split("_t", "[ \n]"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    both, n_short = long.withColumn("doc_id", F.col("_doc")).select("doc_id", "ord", "title", "_t", "page_idx"), short.count()
    if n_short:
        at = F.col("doc_id").eqNullSafe(F.col("_doc")) if keyed else F.lit(True)
        if n_short <= FEW_TITLES:
            texts = pages.select(F.col("doc_id").alias("_doc"), "page_idx", F.lower("text").alias("_text"))
            short = texts.join(F.broadcast(short), at & F.contains("_text", F.col("_t")))
        else:
            found = short.join(contains_join(short, "_part", words, "_word"), "_part").withColumnRenamed("_word", "_held")
            short = found.join(words, at & (F.col("_held") == F.col("_word")))
        both = both.unionByName(short.withColumn("doc_id", F.col("_doc")).select("doc_id", "ord", "title", "_t", "page_idx").distinct())
    head = F.lower(F.array_join(F.slice(F.split("text", "\n"), 1, 60), "\n"))
    p = pages.select(F.col("doc_id").alias("_doc"), F.col("page_idx").alias("_page"), head.alias("_head"), F.lower("text").alias("_text"))
    both = both.join(p, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("page_idx") == F.col("_page"))).drop("_doc", "_page")
    anywhere = F.expr("instr(_head, _t)")
    line = F.expr("instr(concat('\\n', _head, '\\n'), concat('\\n', _t, '\\n'))")
    deep = F.expr("instr(_text, _t)")
    rank = F.when(line > 0, F.struct(F.lit(0).alias("k"), line.alias("at"))).when(anywhere > 0, F.struct(F.lit(1).alias("k"), anywhere.alias("at"))).when(deep > 0, F.struct(F.lit(2).alias("k"), F.lit(0).alias("at")))
    hits = both.withColumn("_r", rank).filter("_r is not null")
    return hits.groupBy("doc_id", "ord", "title").agg(F.min_by("page_idx", F.struct("_r", "page_idx")).alias("page_idx"))


def median_offset(found: DataFrame) -> DataFrame:
    """D25. Upper median of page found minus (printed page - 1) of each document; documents without one are 0 at the use."""
    return upper_medians(found.filter("page_idx is not null and printed_page > 0").withColumn("_moved", F.col("page_idx") - (F.col("printed_page") - 1)), ["doc_id"], "_moved", "offset")


def monotone_pages(entries: DataFrame, offsets: DataFrame, n_pages: DataFrame, width: float = PLACES) -> DataFrame:
    """E9. Pages never fall: the running maximum of the page found, else the printed page moved by the offset and clamped, else 0."""
    out = entries.join(offsets, "doc_id", "left").join(n_pages, "doc_id", "left")
    guess = F.when(F.col("printed_page") > 0, F.greatest(F.lit(0), F.least(F.col("n_pages") - 1, F.col("printed_page") - 1 + F.coalesce("offset", F.lit(0)))))
    out = running(out.withColumn("_found", F.coalesce("page_idx", guess, F.lit(0))), ["doc_id"], ["ord"], "_found", "_page", "max", width)
    return out.withColumn("page", F.col("_page") + 1).drop("offset", "n_pages", "_found", "_page")


def dedupe_outline(outline: DataFrame, far: int = 70) -> DataFrame:
    """E10. Entries (doc_id, ord, level, title, page) without repeats, by title and by structural id, each with its last page.

    Then entries more than ``far`` pages before the next go, and figures, tables, bibliography, index and contents.
    """

    def once(df: DataFrame, key: Column) -> DataFrame:
        own = df.withColumn("_key", F.coalesce(key, F.concat(F.lit("#"), F.col("ord").cast("string"))))
        same = Window.partitionBy("doc_id", "_key")
        ranked = own.withColumn("_page", F.max("page").over(same)).withColumn("_k", F.row_number().over(same.orderBy("page", "ord")))
        return ranked.filter("_k = 1").withColumn("page", F.col("_page")).drop("_key", "_page", "_k")

    out = once(outline, F.nullif(T.normalized_title(F.col("title")), F.lit("")))
    out = once(out, T.structural_id(F.col("title")))
    w = Window.partitionBy("doc_id").orderBy("page", "ord")
    out = out.withColumn("_next", F.lead("page").over(w)).filter(F.col("_next").isNull() | (F.col("_next") - F.col("page") <= far)).drop("_next")
    return out.filter(~F.trim("title").rlike(r"(?i)^(Figures?|Tables?|Bibliography|INDEX|Contents)\b"))


def hierarchy_valid(outline: DataFrame) -> DataFrame:
    """D31. Whether each document's outline is plausible: three entries, few orphans, no large gap of top numbers; annexes alone are."""
    own = outline.select("doc_id", F.nullif(F.regexp_extract("title", r"^(\d+(?:\.\d+)*)", 1), F.lit("")).alias("num"))
    nums = saved(own.groupBy("doc_id", "num").agg(F.count("*").alias("k")), "numbers")
    numbered = nums.filter("num is not null")
    kids = numbered.filter(F.col("num").contains(".")).select("doc_id", F.regexp_replace("num", r"\.\d+$", "").alias("parent"), "k")
    orphans = kids.join(numbered.select("doc_id", F.col("num").alias("parent")), ["doc_id", "parent"], "left_anti").groupBy("doc_id").agg(F.sum("k").alias("orphans"))
    counts = nums.groupBy("doc_id").agg(F.sum("k").alias("n"), F.coalesce(F.sum(F.when(F.col("num").isNotNull(), F.col("k"))), F.lit(0)).alias("numbered"))
    counts = counts.join(orphans, "doc_id", "left").withColumn("orphans", F.coalesce("orphans", F.lit(0)))
    tops = numbered.select("doc_id", F.substring_index("num", ".", 1).try_cast("long").alias("top")).distinct()
    gaps = next_greater(tops, ["doc_id"], "top", "next").groupBy("doc_id").agg(F.max(F.col("next") - F.col("top")).alias("gap"))
    out = counts.join(gaps, "doc_id", "left")
    ok = (F.col("numbered") == 0) | ((F.col("orphans") / F.col("numbered") <= F.when(F.col("n") < 15, 0.5).otherwise(0.3)) & (F.coalesce("gap", F.lit(0)) <= 10))
    return out.select("doc_id", "n", "numbered", "orphans", "gap", ((F.col("n") >= 3) & ok).alias("valid"))


def pick_outline(chain: list[DataFrame], least: list[int] | None = None) -> DataFrame:
    """H34. Of each document the first method's entries that has any (bookmarks: ``least`` of them)."""
    least = least or [3, *[1] * (len(chain) - 1)]
    tagged = None
    for k, (df, n) in enumerate(zip(chain, least)):
        part = df.select("doc_id", "ord", "level", "title", "page", F.lit(k).alias("method")).withColumn("_n", F.count("*").over(Window.partitionBy("doc_id"))).filter(F.col("_n") >= n).drop("_n")
        tagged = part if tagged is None else tagged.unionByName(part)
    best = F.min("method").over(Window.partitionBy("doc_id"))
    return tagged.withColumn("_best", best).filter("method = _best").drop("_best")


def section_ranges(outline: DataFrame, n_pages: DataFrame, width: float = PLACES) -> DataFrame:
    """E8, C17. Adds end_page: the page of the first later entry on a later page, minus 1, else the last page (0-indexed as first_page)."""
    out = next_greater(outline, ["doc_id"], "page", "_next", width).join(n_pages, "doc_id", "left")
    return out.withColumn("first_page", F.col("page") - 1).withColumn("end_page", F.coalesce(F.col("_next") - 1, F.col("n_pages") - 1)).drop("_next", "n_pages")


def section_pages(ranges: DataFrame, blocks: DataFrame) -> DataFrame:
    """C17. Blocks of each section's page range: the range is exploded, so the join is by (doc, page)."""
    pages = ranges.select("doc_id", "ord", "title", F.explode(F.sequence("first_page", F.greatest("first_page", "end_page"))).alias("page_idx"))
    return pages.join(blocks, ["doc_id", "page_idx"])


def section_of(items: DataFrame, outline: DataFrame) -> DataFrame:
    """C14. Items with the title and level of the last entry at or before their page; null before the first."""
    return asof_last(items, outline.select("doc_id", "page", "ord", "level", "title"), ["doc_id"], "page", "page", ["level", "title"])


def select_ranges(outline: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """B14. (entries of the chosen index range of each document, rejected ranges)."""
    n = outline.groupBy("doc_id").agg((F.max("ord") + 1).alias("n"))
    r = ranges.join(n, "doc_id", "left").withColumn("ok", F.coalesce((F.col("start_idx") >= 0) & (F.col("start_idx") <= F.col("end_idx")) & (F.col("end_idx") < F.col("n")), F.lit(False)))
    good = r.filter("ok").select("doc_id", "start_idx", "end_idx")
    return outline.join(good, "doc_id").filter("ord between start_idx and end_idx").drop("start_idx", "end_idx"), r.filter("not ok").select("doc_id", "start_idx", "end_idx", "n")
