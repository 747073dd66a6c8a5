"""Expressions over page text: garble checks, captions, references, headings, contents lines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Common words of standards text.
COMMON_WORDS = (
    "the of and to in a is that for are shall be this with or an as not from by which when if on at it have was were been "
    "has all its each may used other than they any more within should must also only such between after can no per provided "
    "part section clause standard iso requirement system device test data value temperature pressure time information figure table annex note example"
).split()
# Patterns of standards pages.
WATERMARK = r"(?i)Copyrighted material|licensed to|Techstreet"
_NUMBER = r"(?:BS\s+)?(?:EN\s+)?(?:ISO|IEC|EN)\s+[\w\-]+[:\-]\d{4}(?:\s*\([^)]{1,3}\))?(?:\s+\S[^\r\n]*)?"
RUNNING_HEADER = rf"(?i)^(?:INTERNATIONAL\s+STANDARD\s*[\t ]*)?{_NUMBER}(?:\s*[\r\n]+\s*(?:{_NUMBER})?)?$"
STANDARD_PREFIX = r"(?i)^(?:INTERNATIONAL\s+STANDARD\s+)?(?:BS\s+)?(?:EN\s+)?(?:ISO|IEC|EN)\s+[\w/\-]+[:\-]\d{4}(?:\+[\w:\-]+)*(?:\s*\([^)]{1,5}\))?\s+"
RIGHTS_FOOTER = r"(?i)^\d{0,4}\s*\n?\s*All rights reserved\s*$|^©\s*(?:ISO|IEC|BSI|EN)\b.*All rights reserved.*$"
BACK_MATTER = r"(?i)^(?:Bibliography|NO COPYING WITHOUT BSI|British Standards Institution|This page deliberately left blank|BSI Group Headquarters|ICS\s+\d+\.\d+)"
FIGURE_CAPTION = r"^(?:Figure|FIGURE)\s+(\d+)\s*[—–\-]"
TABLE_CAPTION = r"^(?:Table|TABLE)\s+([A-Z](?:\.\d+)+|\d+(?:\.\d+)*)(?=[ \t]*(?:[—–\-]|\(|$|\n|\r))"
TABLE_CONTINUED = r"(?i)^Table\s+\S.*\(continued\)"
FORMULA_END = r"\((\d+)\)\s*$"
MATH_CHARACTERS = "[=×÷±∑∫√≤≥≠°μαβγΣδεθλπσφψω]"
PAGE_NUMBER = r"^\d{1,4}\s*$"
FOOTNOTE = r"(?i)^(?:[a-z]\s{1,4}\S|\d+\)\s|\*\s)"
FIGURE_REF = r"(?i)\bFigure\s+(\d+)\b"
TABLE_REF = r"(?i)\bTable\s+([a-z](?:\.\d+)+|\d+(?:\.\d+)*)\b"
FORMULA_REF = r"(?i)\bFormula\s+\((\d+)\)"
REFERENCE = r"(?i)\bFig(?:ure)?\.?\s+\d+(?:[.\-]\d+)*|\bTable\s+(?:[a-z](?:\.\d+)+|\d+(?:\.\d+)*)\b|\bFormula\s+\(\d+\)"
GARBLE = r"[A-Z][>:<^@=\\]{1,2}[A-Z]"
CIPHER = r"[A-Za-z][<>=?^~|\\]|[<>=?^~|\\][A-Za-z]"
URLISH = r"(?i)https?://|www\.|@|\.com|\.org|\.iso\.|techstreet"
TITLE_NOISE = "[\\u00a0\\u00ad\\u200b\\u200c\\u200d\\ufeff\\u2022\\u2023\\u25aa\\u25cf\\u00b7\\u2013\\u2014\\u2012*\\u0000-\\u001f]"
SECTION_ID = r"(?i)^\s*(?:(\d+(?:\.\d+)*)|annex\s+([a-z])|figure\s+((?:[a-z]\.?)?\d+(?:\.\d+)*)|table\s+((?:[a-z]\.?)?\d+(?:\.\d+)*))\b"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern))


def _any_of(words: Sequence[str]) -> str:
    """Pattern of some words, by their first letter."""
    first = sorted({w[0] for w in words})
    return "|".join(f"{c}(?:{'|'.join(w[1:] for w in words if w[0] == c)})" for c in first)


# Tokens are runs without blanks, and count without what is no letter or digit (of ASCII) at their ends.  A pattern takes the rest of its token, so it counts tokens.
_BEGIN, _END = r"(?:^|\s)[^\sa-zA-Z0-9]*+", r"[^\sa-zA-Z0-9]*+(?!\S)"
TOKEN, WORDLIKE = r"\S+", r"[a-zA-Z0-9]\S*"
# the lower case of a dotted I is a letter and a mark
LETTERS = rf"{_BEGIN}(?:[a-zA-Z]{{2,}}+{_END}|[a-zA-Z][\p{{L}}&&[^\u0130]]*[a-zA-Z]{_END})"
KNOWN = rf"{_BEGIN}(?i:{_any_of([w for w in COMMON_WORDS if len(w) > 1])}){_END}"
ODD = r"[\p{C}\p{Zl}\p{Zp}&&[^\n\r\t]]"
GARBLED = rf"{GARBLE}\S*"
LINKS = rf"(?:{URLISH})\S*"
CIPHERED = rf"(?:^|\s)(?=\S*?(?:{CIPHER}))(?!\S*?(?:{URLISH}))\S+"


def _with(counts: dict[str, Column], then: Callable[[Column], Column]) -> Column:
    """``then`` of the counts, each of which is counted once."""
    return F.get(F.transform(F.array(F.struct(*[c.alias(n) for n, c in counts.items()])), then), F.lit(0))


def garble_check(text: Column) -> Column:
    """H25. Which check a text fails: short, unprintable, letters, words, pattern; null for readable text."""
    counts = {name: _count(text, p) for name, p in (("raw", TOKEN), ("tokens", WORDLIKE), ("alpha", LETTERS), ("known", KNOWN), ("odd", ODD), ("hits", GARBLED))}

    def fails(n: Column) -> Column:
        return (
            F.when(n["odd"] / F.length(text) > 0.4, "unprintable")
            .when((n["tokens"] == 0) | (n["alpha"] / n["tokens"] < 0.30), "letters")
            .when((n["alpha"] > 10) & (n["known"] / n["alpha"] < 0.03), "words")
            .when((n["raw"] > 0) & (n["hits"] / n["raw"] > 0.08), "pattern")
        )

    return F.when(text.isNull() | (F.length(F.trim(text)) < 20), "short").otherwise(_with(counts, fails))


def cipher_ratio(text: Column) -> Column:
    """H26. Share of tokens with a cipher symbol next to a letter; links aside; 0 for ten tokens or fewer."""
    counts = {"n": _count(text, TOKEN) - _count(text, LINKS), "hits": _count(text, CIPHERED)}
    return _with(counts, lambda c: F.when(c["n"] <= 10, F.lit(0.0)).otherwise(c["hits"] / c["n"]))


def split_blocks(text: Column) -> Column:
    """H27. Paragraphs: at blank lines, and before a caption on an inner line."""
    caption = r"\n[ \t]*(?=(?:Figure|FIGURE)\s+\d+\s*[—–\-]|(?:Table|TABLE)\s+(?:[A-Z](?:\.\d+)+|\d+(?:\.\d+)*)[ \t]*(?:[—–\-(]|\r?\n|\r|$))"
    marked = F.regexp_replace(text, caption, "\n\n")
    return F.filter(F.transform(F.split(F.coalesce(marked, F.lit("")), r"\n{2,}"), lambda b: F.trim(b, F.lit(" \n\t\r"))), lambda b: b != "")


def figure_number(block: Column) -> Column:
    return F.nullif(F.regexp_extract(block, FIGURE_CAPTION, 1), F.lit(""))


def table_ref(block: Column) -> Column:
    return F.nullif(F.regexp_extract(block, TABLE_CAPTION, 1), F.lit(""))


def formula_number(block: Column) -> Column:
    """Number at the end of a block with a mathematical character."""
    return F.when(block.rlike(MATH_CHARACTERS), F.nullif(F.regexp_extract(block, FORMULA_END, 1), F.lit("")))


def mentions(text: Column) -> Column:
    """H29. Distinct (kind, ref) of the figures, tables and formulas a text mentions."""
    one = lambda kind, pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda r: F.struct(F.lit(kind).alias("kind"), F.upper(r).alias("ref")))
    return F.array_distinct(F.concat(one("figure", FIGURE_REF), one("table", TABLE_REF), one("formula", FORMULA_REF)))


def highlights(text: Column) -> Column:
    """H29. The reference texts to highlight, in order."""
    return F.regexp_extract_all(text, F.lit(f"({REFERENCE})"), 1)


def section_number(title: Column) -> Column:
    """H30. Leading section number or annex letter."""
    return F.coalesce(F.nullif(F.regexp_extract(title, r"^\s*(\d+(?:\.\d+)*)\b", 1), F.lit("")), F.nullif(F.upper(F.regexp_extract(title, r"(?i)^\s*Annex\s+([A-Z])\b", 1)), F.lit("")))


def outline_level(title: Column) -> Column:
    """H30. 1 for annexes and plain titles, else the number of parts of the section number."""
    number = F.regexp_extract(title, r"^\s*(\d+(?:\.\d+)*)\b", 1)
    return F.when(number == "", 1).otherwise(F.size(F.split(number, r"\.")))


def structural_id(title: Column) -> Column:
    """H30. ``sec:4.3``, ``annex:a``, ``figure:9`` or ``table:a.6``; null for other titles."""
    part = lambda k: F.regexp_extract(title, SECTION_ID, k)
    return F.when(part(1) != "", F.concat(F.lit("sec:"), part(1))).when(part(2) != "", F.concat(F.lit("annex:"), F.lower(part(2)))).when(part(3) != "", F.concat(F.lit("figure:"), F.lower(part(3)))).when(part(4) != "", F.concat(F.lit("table:"), F.lower(part(4))))


def normalized_title(title: Column) -> Column:
    """H30. Lower-cased, without noise characters, blanks and outer marks made alike."""
    t = F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), TITLE_NOISE, " "), r"\s+", " ")))
    t = F.regexp_replace(F.regexp_replace(t, r"\)\s*", ") "), r"\s*\(", " (")
    return F.regexp_replace(F.trim(F.regexp_replace(t, r"\s+", " ")), "^[.,;:!? ]+|[.,;:!? ]+$", "")


def contents_line(line: Column) -> Column:
    """H31. struct(number, level, title, printed_page) of a contents line in dot-leader or index form; null otherwise.

    A printed page that isn't a number is 0; doubled labels and running headers are dropped.
    """
    clean = F.regexp_replace(F.trim(line), STANDARD_PREFIX, "")
    dotted = r"^\s*(.+?)\s*\.{7,}\s*(\d+|[ivxlcdmIVXLCDM]+)\s*$"
    indexed = r"^\s*(\d+(?:\.\d+)*)\s+(.+?)\s+(\d+)\s*$"
    is_dotted, is_indexed = clean.rlike(dotted), clean.rlike(indexed)
    raw = F.when(is_dotted, F.regexp_extract(clean, dotted, 1)).when(is_indexed, F.concat_ws(" ", F.regexp_extract(clean, indexed, 1), F.regexp_extract(clean, indexed, 2)))
    title = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"\.{2,}", " "), r"\s+", " "), r"(?i)^(?:Table|Figure|Annex)s?\s+(Table|Figure|Annex)\b", "$1"))
    page = F.when(is_dotted, F.regexp_extract(clean, dotted, 2)).otherwise(F.regexp_extract(clean, indexed, 3))
    return F.when(is_dotted | is_indexed, F.struct(section_number(title).alias("number"), outline_level(title).alias("level"), title.alias("title"), F.coalesce(page.try_cast("int"), F.lit(0)).alias("printed_page")))


def heading_number(line: Column) -> Column:
    """H32. Number (or ``annex x``) of a line that can be a heading; null otherwise."""
    s = F.trim(line)
    number, tail = F.regexp_extract(s, r"^(\d+(?:\.\d+)*)\s+(\S.*)$", 1), F.trim(F.regexp_extract(s, r"^(\d+(?:\.\d+)*)\s+(\S.*)$", 2))
    annex = F.lower(F.regexp_extract(s, r"(?i)^(Annex\s+[A-Z])\b", 1))
    top = F.substring_index(number, ".", 1).try_cast("int")
    plain = ~number.contains(".") & (~tail.rlike(r"^\p{Lu}") | (F.length(s) > 80))
    bad = (F.length(s) < 3) | (F.length(s) > 120) | s.rlike(r"\.{6,}")
    return F.when(bad, F.lit(None).cast("string")).when((number != "") & ~tail.rlike(r"^[\d\s.,;%()+-]+$") & (top <= 30) & ~plain, number).when(annex != "", annex)


def text_metrics(text: Column) -> Column:
    """D33. struct(chars, sentences, items): pieces after ``.!?`` and a blank, pieces at ``|`` or lines; 0 for empty text."""
    s = F.trim(F.coalesce(text, F.lit("")), F.lit(" \n\t\r"))
    pieces = lambda pattern: F.greatest(F.lit(1), F.size(F.filter(F.split(s, pattern), lambda p: F.trim(p, F.lit(" \n\t\r")) != "")))
    count = lambda c: F.when(s == "", 0).otherwise(c)
    return F.struct(F.length(s).alias("chars"), count(pieces(r"[.!?]\s+")).alias("sentences"), count(F.when(s.contains("|"), pieces(r"\|")).otherwise(pieces("\n"))).alias("items"))


def cell_subblocks(cell: Column, headers: list[str]) -> Column:
    """H40. Array of (header, text) of a ``|`` cell (line breaks count as ``|`` where there is none): text after each header piece."""
    s = F.coalesce(cell, F.lit(""))
    pieces = F.filter(F.transform(F.split(F.when(s.contains("|"), s).otherwise(F.regexp_replace(s, r"\n+", "|")), r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    low = [h.lower() for h in headers]
    start = F.array().cast("array<struct<header:string,text:string>>")

    def step(acc: Column, p: Column) -> Column:
        is_header = F.regexp_replace(F.lower(p), r"\s*:\s*$", "").isin(*low)
        last = F.element_at(acc, -1)
        more = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["header"].alias("header"), F.concat_ws("\n", F.nullif(last["text"], F.lit("")), p).alias("text"))))
        new = F.array(F.struct(F.when(is_header, F.regexp_replace(p, r"\s*:\s*$", "")).otherwise("").alias("header"), F.when(is_header, "").otherwise(p).alias("text")))
        return F.when(is_header | (F.size(acc) == 0), F.concat(acc, new)).otherwise(more)

    return F.aggregate(pieces, start, step)


def math_signal(text: Column, math_share: Column, italic_share: Column) -> Column:
    """H35. Whether a line looks like a formula: by fonts, by two symbols, or by one in mostly italic text."""
    symbols = F.length(text) - F.length(F.regexp_replace(text, MATH_CHARACTERS, ""))
    return (math_share > 0.30) | (symbols >= 2) | ((symbols >= 1) & (italic_share > 0.70))
