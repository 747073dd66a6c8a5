"""Section-generation jobs: task fan-out, prompts, replies, edits and calibration texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions import ids
from parchment.functions import text as T

from .helpers import keep_first, ordered_list

TRUTHY = ("yes", "on", "true", "1", "checked")


def fan_out(docs: DataFrame, sections: list[str]) -> DataFrame:
    """K1. One task a document and section: the short fixed list is a literal, so nothing is joined."""
    return docs.select("*", F.posexplode(F.lit(sections)).alias("section_no", "section"))


def assemble_prompt(tasks: DataFrame, parts: list[str], no_bound: tuple[str, ...] = ("troubleshooting",), bound: str = "bound") -> DataFrame:
    """K2. Adds prompt: the parts in order, blank ones left out; sections in ``no_bound`` take no bound."""
    value = lambda c: F.when(F.col("section").isin(*no_bound), F.lit(None)).otherwise(ids.blank_to_null(c)) if c == bound else ids.blank_to_null(c)
    return tasks.withColumn("prompt", F.concat_ws("\n\n", *[value(c) for c in parts]))


def reply_json(reply: Column) -> Column:
    """K3. The JSON text of a reply: what stands in a fence, else from the first bracket to the last."""
    fenced = F.nullif(F.trim(F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.lit(" \n\t\r")), F.lit(""))
    body = F.coalesce(fenced, F.trim(reply, F.lit(" \n\t\r")))
    outer = F.regexp_extract(body, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.when(F.try_parse_json(body).isNotNull(), body).otherwise(F.nullif(outer, F.lit("")))


def parse_replies(replies: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """K3. Adds value (canonical JSON), reason (null, or ``unparsable``) and truncated.

    An object with one key whose value is an object or array is unwrapped; what can't be parsed becomes the
    section's empty value.
    """
    raw = F.trim(F.coalesce("reply", F.lit("")), F.lit(" \n\t\r"))
    parsed = F.try_parse_json(reply_json(F.col("reply")))
    out = replies.withColumn("_v", parsed).withColumn("_m", F.from_json(F.to_json(parsed), "map<string,variant>"))
    inner = F.map_values("_m")[0]
    single = (F.size("_m") == 1) & (F.schema_of_variant(inner).startswith("OBJECT") | F.schema_of_variant(inner).startswith("ARRAY"))
    value = F.when(single, F.to_json(inner)).otherwise(F.to_json("_v"))
    empty = F.create_map(*[F.lit(x) for kv in (defaults or {}).items() for x in kv])[F.col("section")] if defaults and "section" in replies.columns else F.lit(None).cast("string")
    return out.withColumn("reason", F.when(F.col("_v").isNull(), "unparsable")).withColumn("value", F.when(F.col("_v").isNull(), F.coalesce(empty, F.lit("{}"))).otherwise(value)).withColumn("truncated", ~raw.rlike(r"[}\]](\s*```)?$")).drop("_v", "_m")


def normalize_phases(phases: DataFrame) -> DataFrame:
    """K4. equipment and software lists of a phase value: an object's lists, a list as equipment, a text as one item, null as none."""
    v = F.try_parse_json("value")
    kind = F.schema_of_variant(v)
    strings = lambda x, p: F.coalesce(F.try_variant_get(x, p, "array<string>"), F.transform(F.array_compact(F.array(F.try_variant_get(x, p, "string"))), lambda s: s), F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    equipment = F.when(kind.startswith("OBJECT"), strings(v, "$.equipment")).when(kind.startswith("ARRAY"), F.coalesce(F.try_variant_get(v, "$", "array<string>"), none)).when(kind == "STRING", F.array(F.try_variant_get(v, "$", "string"))).otherwise(none)
    software = F.when(kind.startswith("OBJECT"), strings(v, "$.software")).otherwise(none)
    clean = lambda a: F.filter(a, lambda s: ids.text_of(s) != "")
    return phases.withColumn("equipment", clean(equipment)).withColumn("software", clean(software))


def list_html(items: Column) -> Column:
    return F.concat(F.lit("<ul>"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("<li>"), x, F.lit("</li>"))), ""), F.lit("</ul>"))


def flatten_leaves(docs: DataFrame, keys: list[str]) -> DataFrame:
    """K5. (run_id, key_path, kind, value, items) of the leaves at the dotted ``keys`` of a JSON document; lists as ``<ul><li>``."""
    v = F.try_parse_json("doc")

    def leaf(k: str) -> Column:
        items = F.try_variant_get(v, f"$.{k}", "array<string>")
        text = F.try_variant_get(v, f"$.{k}", "string")
        return F.struct(F.lit(k).alias("key_path"), F.when(items.isNotNull(), "list").otherwise("text").alias("kind"), F.when(items.isNotNull(), list_html(items)).otherwise(text).alias("value"), items.alias("items"))

    return docs.select("run_id", F.explode(F.array(*[leaf(k) for k in keys])).alias("l")).select("run_id", "l.*").filter("value is not null")


def html_items(html: Column) -> Column:
    """K7. Texts of the list items, else the lines that aren't empty; tags are stripped. Nested lists: their innermost items."""
    strip = lambda s: F.trim(F.regexp_replace(s, r"(?s)<[^>]*>", ""), F.lit(" \n\t\r"))
    found = F.regexp_extract_all(html, F.lit(r"(?is)<li[^>]*>(.*?)</li>"), 1)
    full = lambda a: F.filter(F.transform(a, strip), lambda s: s != "")
    return F.when(F.size(found) > 0, full(found)).otherwise(full(F.split(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?i)<br\s*/?>|</p>|</div>", "\n"), "\n")))


def overlay_edits(leaves: DataFrame, sections: DataFrame) -> DataFrame:
    """K6. Leaves with edited sections (revision above 1) laid over; lists are read back into items."""
    s = sections.filter("revision > 1").select("run_id", F.col("section_key").alias("key_path"), F.col("html").alias("_html"))
    out = leaves.join(s, ["run_id", "key_path"], "left")
    return out.select("run_id", "key_path", "kind", F.coalesce("_html", "value").alias("value"), F.when(F.col("_html").isNotNull() & (F.col("kind") == "list"), html_items(F.col("_html"))).otherwise(F.col("items")).alias("items"))


# Tags that stay, and the attribute a list item keeps.
ALLOWED = "p br div ul ol li b strong i em u".split()
KEPT_ATTRIBUTE = {"li": "data-list"}
#: Pieces of HTML: a comment, a tag (whose quoted attributes may hold ``>``), another mark-up item, text, a lone ``<``.
PIECES = r"""(?s)(<!--.*?-->|</?[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*>|<[!?/][^>]*>|[^<]+|<)"""


def sanitized_html(html: Column) -> Column:
    """K8. Only allowed tags stay; of others the text is kept; comments go; other ``<``, ``>`` and ``&`` of the text are escaped."""

    def clean(piece: Column) -> Column:
        name = F.lower(F.regexp_extract(piece, "^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
        kept = F.lit("")
        for tag, attribute in KEPT_ATTRIBUTE.items():
            value = F.regexp_extract(piece, rf"""(?i)\s{attribute}\s*=\s*["']?([^"'>\s]*)""", 1)
            kept = F.when((name == tag) & piece.rlike(rf"(?i)\s{attribute}\s*="), F.concat(F.lit(f' {attribute}="'), value, F.lit('"'))).otherwise(kept)
        closing = piece.startswith("</")
        tag = F.when(~name.isin(*ALLOWED) | (closing & (name == "br")), "").when(closing, F.concat(F.lit("</"), name, F.lit(">"))).otherwise(F.concat(F.lit("<"), name, kept, F.lit(">")))
        text = F.regexp_replace(F.regexp_replace(piece, "&(?![a-zA-Z0-9#]+;)", "&amp;"), ">", "&gt;")
        return F.when(piece == "<", "&lt;").when(name != "", tag).when(piece.startswith("<"), "").otherwise(text)

    return F.array_join(F.transform(F.regexp_extract_all(html, F.lit(PIECES), 1), clean), "")


def sanitize_html(df: DataFrame, column: str = "html", to: str = "clean_html") -> DataFrame:
    """K8. Adds the column's allowed mark-up (``sanitized_html``); null stays null."""
    return df.withColumn(to, sanitized_html(F.col(column)))


def review_outcome(reviews: DataFrame) -> DataFrame:
    """K9. status, issues and a message; a reply that can't be read or has no status is ok without issues."""
    v = F.try_parse_json(reply_json(F.col("reply")))
    status = F.try_variant_get(v, "$.status", "string")
    issues = F.coalesce(F.try_variant_get(v, "$.issues", "array<string>"), F.array().cast("array<string>"))
    known = status.isNotNull()
    out = reviews.withColumn("status", F.coalesce(status, F.lit("ok"))).withColumn("issues", F.when(known, issues).otherwise(F.array().cast("array<string>")))
    return out.withColumn("message", F.when(F.size("issues") == 0, "no issues").otherwise(F.concat(F.size("issues").cast("string"), F.lit(" issue(s)"))))


PAGE_SCHEMA = "text string, images array<struct<caption:string,bbox_norm:array<double>>>, tables array<struct<caption:string,bbox_norm:array<double>,data:array<array<string>>>>, page_w_pts double, page_h_pts double"


def page_results(replies: DataFrame) -> DataFrame:
    """K10. Text, images, tables and page size of a reply; a failed one is an empty page of 595 by 842 points."""
    p = F.from_json(reply_json(F.col("reply")), PAGE_SCHEMA)
    d = lambda c, v: F.coalesce(p[c], v)
    return replies.select(
        "doc_id", "page_idx", d("text", F.lit("")).alias("text"), d("images", F.from_json(F.lit("[]"), "array<struct<caption:string,bbox_norm:array<double>>>")).alias("images"),
        d("tables", F.from_json(F.lit("[]"), "array<struct<caption:string,bbox_norm:array<double>,data:array<array<string>>>>")).alias("tables"), d("page_w_pts", F.lit(595.0)).alias("page_w_pts"), d("page_h_pts", F.lit(842.0)).alias("page_h_pts"),
    )


def accepted_formulas(verdicts: DataFrame, anchors: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K11. (formulas with anchor and section, counts of the others by reason); without both a formula goes."""
    key = ["doc_id", "page_idx", "id"]
    ok = verdicts.filter("is_equation").join(anchors, key, "left").join(sections, key, "left").filter("anchor is not null or section is not null")
    return ok, verdicts.filter("not coalesce(is_equation, false)").groupBy("doc_id", F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


def apply_manual_fields(reports: DataFrame, fields: DataFrame, names: dict[str, str], flags: tuple[str, ...] = ()) -> DataFrame:
    """K13. Values entered by hand (run_id, field, value) over a report's columns: renamed by ``names``, unknown ones ignored, omitted ones kept."""
    wide = fields.filter(F.col("field").isin(*names)).groupBy("run_id").pivot("field", list(names)).agg(F.first("value"))
    wide = wide.select("run_id", *[F.col(f).alias(f"_m_{c}") for f, c in names.items()])
    out = reports.join(wide, "run_id", "left")
    for c in names.values():
        value = F.lower(ids.text_of(f"_m_{c}")).isin(*TRUTHY) if c in flags else F.col(f"_m_{c}")
        out = out.withColumn(c, F.when(F.col(f"_m_{c}").isNotNull(), value).otherwise(F.col(c)))
    return out.drop(*[f"_m_{c}" for c in names.values()])


def model_map(tasks: DataFrame, call: Callable, retries: int = 2, batch: int | None = None) -> DataFrame:
    """K14. Adds reply and error: ``call`` on every prompt, tried again a bounded number of times; one task's failure stays its own.

    ``batch``: ``call`` takes up to so many prompts as a list and returns as many replies; the prompts of a batch that
    keeps failing are tried one by one.
    """
    schema = f"{', '.join(f'{n} {t}' for n, t in tasks.dtypes)}, reply string, error string"

    def tried(prompts: list) -> tuple[list, str | None]:
        error = None
        for _ in range(retries + 1):
            try:
                replies = list(call(prompts)) if batch else [call(p) for p in prompts]
                if len(replies) != len(prompts):
                    raise ValueError(f"{len(replies)} replies to {len(prompts)} prompts")
                return replies, None
            except Exception as e:  # noqa: BLE001
                error = f"{type(e).__name__}: {e}"
        return [None] * len(prompts), error

    def run(frames: Iterator):
        for pdf in frames:
            replies, errors = [], []
            prompts = pdf["prompt"].tolist()
            for at in range(0, len(prompts), batch or 1):
                part = prompts[at : at + (batch or 1)]
                found, error = tried(part)
                for one in [(found, error)] if error is None or len(part) == 1 else map(lambda p: tried([p]), part):
                    replies += one[0]
                    errors += [one[1]] * len(one[0])
            yield pdf.assign(reply=replies, error=errors)

    return tasks.mapInPandas(run, schema)


def pair_lists(docs: DataFrame, path: str, first: str, second: str) -> DataFrame:
    """K15. Entries of a list as (ord, first, second): objects by their keys, arrays of two by place; others are dropped."""
    items = F.try_variant_get(F.try_parse_json("doc"), path, "array<variant>")
    rows = docs.select("run_id", F.posexplode(items).alias("ord", "e"))
    kind = F.schema_of_variant("e")
    by = lambda p: F.try_variant_get("e", p, "string")
    pair = F.when(kind.startswith("OBJECT"), F.struct(by(f"$.{first}").alias("a"), by(f"$.{second}").alias("b"))).when(kind.startswith("ARRAY") & (F.size(F.try_variant_get("e", "$", "array<variant>")) == 2), F.struct(by("$[0]").alias("a"), by("$[1]").alias("b")))
    return rows.select("run_id", "ord", pair.alias("p")).filter("p is not null and (p.a is not null or p.b is not null)").select("run_id", "ord", F.col("p.a").alias(first), F.col("p.b").alias(second))


def gold_lookup(cells: DataFrame, sections: DataFrame) -> DataFrame:
    """C32. Text of each (heading, label) of the section map: the first cell whose heading and label begin with them, in any case.

    ``cells``: heading, label, text, ord; an empty label joins all cells of the heading.  A heading meets the map by
    each of its beginnings, so the join is by hash, however long the map is.
    """
    s = sections.select("section", F.lower("heading").alias("_h"), F.lower(F.coalesce("label", F.lit(""))).alias("_l"))
    heading = F.lower("heading")
    begun = cells.filter("heading is not null").withColumn("_h", F.explode(F.transform(F.sequence(F.lit(0), F.length(heading)), lambda n: F.substring(heading, F.lit(1), n))))
    hit = begun.join(s, "_h").filter((F.col("_l") == "") | F.startswith(F.lower(F.coalesce("label", F.lit(""))), F.col("_l")))
    out = hit.groupBy("section", "_l").agg(F.min_by("text", "ord").alias("one"), ordered_list(F.col("text"), F.col("ord"), "\n").alias("all"))
    return out.select("section", F.when(F.col("_l") == "", F.col("all")).otherwise(F.col("one")).alias("text"))


def section_bounds(gold: DataFrame, static: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D34. (rule of each section: from the gold text's size, else the static one; counts of derived, kept and skipped)."""
    m = T.text_metrics(F.col("text"))
    rule = F.format_string("about %d sentences and %d items, at most %d characters", m["sentences"], m["items"], F.ceil(m["chars"] * 1.2))
    g = gold.select("section", F.when(m["chars"] > 0, rule).alias("derived"))
    out = static.join(g, "section", "full").select("section", F.coalesce("derived", "bound").alias("bound"), F.when(F.col("derived").isNotNull(), "derived").when(F.col("bound").isNotNull(), "kept").otherwise("skipped").alias("origin"))
    return out.filter("bound is not null").select("section", "bound"), out.groupBy("origin").agg(F.array_sort(F.collect_list("section")).alias("sections"))


def section_examples(lines: DataFrame) -> DataFrame:
    """D35. Body of each heading: lines with ``##`` and ``###`` sub-headings and indented ones, in order."""
    mark = F.create_map(F.lit(2), F.lit("## "), F.lit(3), F.lit("### "))[F.col("level")]
    line = F.concat(F.coalesce(mark, F.lit("")), F.repeat(F.lit("  "), F.coalesce("indent", F.lit(0))), "text")
    return lines.groupBy("doc_id", "heading").agg(ordered_list(line, F.col("ord"), "\n").alias("example"))


def flatten_sections(docs: DataFrame) -> DataFrame:
    """H41. Marked-up text of nested sections: ``sections``: array of struct(heading, content array<string>, table array<array<string>>)."""
    part = lambda s: F.concat(
        F.array(F.concat(F.lit("# "), s["heading"])), F.coalesce(s["content"], F.array().cast("array<string>")),
        F.transform(F.coalesce(s["table"], F.array().cast("array<array<string>>")), lambda r: F.array_join(r, " | ")),
    )
    return docs.withColumn("text", F.array_join(F.flatten(F.transform("sections", part)), "\n"))


def first_replies(replies: DataFrame, order: list[str]) -> DataFrame:
    """The first reply without an error of each task."""
    return keep_first(replies.filter("error is null"), ["run_id", "section"], order)


def numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("no", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
