"""Manufacturing report: stages, compositions, components and general information of batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions import clean, ids

from .helpers import contains_join, first_filled_by, keep_first, nulls_last, ordered_list


def bind_prefix(df: DataFrame, roots: DataFrame, exact: bool = True, pattern: str = r"BA[A-Z]?\d{4,}") -> DataFrame:
    """B2. Rows whose batch_id begins with a root; adds root.

    Both sides take the same leading id by ``pattern`` and are joined on it as a hash join.  With ``exact=False`` a
    longer id that begins with a root's digits also belongs to it, as with LIKE.
    """
    short = lambda c: F.regexp_substr(c, F.lit(f"^.*?{pattern}"))
    left = df.withColumn("_short", short(F.col("batch_id")))
    r = roots.select(F.col("root")).distinct()
    if exact:
        return left.join(r, left["_short"] == r["root"]).drop("_short")
    # every prefix of the leading id that could be a root is a key
    keys = left.withColumn("root", F.explode(F.transform(F.sequence(F.lit(1), F.length("batch_id")), lambda n: F.substring("batch_id", F.lit(1), n))))
    return keys.join(r, "root").drop("_short")


def filter_components(df: DataFrame, prefix: str = "urn:batch:") -> DataFrame:
    """B3. Batch references and packaging by name."""
    return df.filter(F.col("component_ref").startswith(prefix) | clean.is_packaging(F.col("display_name")))


def pick_parameters(df: DataFrame, refs: list[str]) -> DataFrame:
    """B6. Rows of the listed parameters."""
    return df.filter(F.col("parameter_ref").isin(*refs))


def has_data_batches(roots: DataFrame, *relations: DataFrame) -> DataFrame:
    """B10. root, has_data: whether any relation has a row of the root."""
    some = None
    for r in relations:
        keys = r.select("root").distinct()
        some = keys if some is None else some.unionByName(keys)
    some = some.distinct().withColumn("some", F.lit(True))
    return roots.select("root").distinct().join(some, "root", "left").select("root", F.coalesce("some", F.lit(False)).alias("has_data"))


def composition(formulation_batches: DataFrame, components: DataFrame) -> DataFrame:
    """C4. Components of each batch's formulation."""
    return formulation_batches.filter("formulation_id is not null").join(components, "formulation_id")


def resolve_components(batch_components: DataFrame, lots: DataFrame, prefix: str = "urn:batch:") -> DataFrame:
    """C5. Adds resolved_name: the lot's name for the reference without its prefix."""
    key = F.regexp_replace("component_ref", f"^{prefix}", "")
    return batch_components.withColumn("_id", key).join(lots.select(F.col("id").cast("string").alias("_id"), F.col("displayname").alias("resolved_name")), "_id", "left").drop("_id")


def material_properties(properties: DataFrame, formulation_batches: DataFrame) -> DataFrame:
    """C6. Properties of the materials any batch is made of."""
    return properties.join(formulation_batches.select("material_id").distinct(), "material_id", "left_semi")


def quality_standard(parameters: DataFrame, batch_components: DataFrame, lots: DataFrame, parameter: str = "qualityStandardRef") -> DataFrame:
    """C7. Quality standards of components, with the lot's name where known."""
    p = parameters.filter((F.col("parameter_ref") == parameter) & F.col("value").isNotNull()).select("ref_id", F.col("value").alias("quality_standard"))
    c = batch_components.select(F.col("component_id").alias("ref_id"), F.col("component_ref"))
    named = p.join(c, "ref_id", "left").withColumn("_id", F.regexp_replace("component_ref", "^urn:batch:", ""))
    return named.join(lots.select(F.col("id").cast("string").alias("_id"), F.col("displayname").alias("component_name")), "_id", "left").drop("_id", "component_ref")


def label_stages(stages: DataFrame, labels: DataFrame, operations: dict[str, str]) -> DataFrame:
    """C8. Adds unit_operation and confident: the stage's label, else the decoded address, else the raw one."""
    d = clean.decoded(F.col("unit_operation_uri"), operations)
    out = stages.join(labels.select("stage_id", "label"), "stage_id", "left")
    has = ids.text_of("label") != ""
    return out.withColumn("unit_operation", F.when(has, F.col("label")).otherwise(d["label"])).withColumn("confident", has | d["confident"]).drop("label")


def decode_dict(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """C9. Adds ``<column>_label`` and ``<column>_confident`` from a table (key, label): empty is confident, a miss stays raw."""
    raw = ids.text_of(column)
    out = df.withColumn("_raw", raw).join(names.select(F.col("key").alias("_raw"), F.col("label").alias("_label")), "_raw", "left")
    return out.withColumn(f"{column}_label", F.coalesce("_label", "_raw")).withColumn(f"{column}_confident", F.col("_label").isNotNull() | (F.col("_raw") == "")).drop("_raw", "_label")


def short_id(batch: Column) -> Column:
    return F.upper(F.regexp_substr(batch, F.lit(r"BA[A-Z]?\d+")))


def id_exists(wanted: DataFrame, batches: DataFrame, pattern: str = r"[A-Z]+[A-Z]?\d+") -> DataFrame:
    """C12. id, found: whether an id occurs in any batch_id, case-insensitively.

    Ids are looked up by the short ids that batches contain (a hash join), and what isn't found so by its rarest run
    of three characters.
    """
    keys = batches.select(F.explode(F.regexp_extract_all(F.upper("batch_id"), F.lit(f"({pattern})"), 1)).alias("_id")).distinct().withColumn("_hit", F.lit(True))
    first = wanted.select("id").distinct().withColumn("_id", F.upper("id")).join(keys, "_id", "left")
    found = first.filter("_hit").select("id", F.lit(True).alias("found"))
    rest = first.filter("_hit is null").select("id", "_id")
    hay = batches.select(F.upper("batch_id").alias("_hay")).distinct()
    within = contains_join(rest, "_id", hay, "_hay").select("_id").distinct()
    hits = rest.join(within, "_id", "left_semi").select("id").union(rest.filter("_id = ''").select("id")).distinct().withColumn("found", F.lit(True))
    return found.unionByName(rest.select("id").join(hits, "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found")))


def resolve_root(wanted: DataFrame, batches: DataFrame) -> DataFrame:
    """C13. id, root: the smallest batch id with the id, cut after it; the id itself where there is none."""
    b = batches.select("batch_id", short_id(F.col("batch_id")).alias("_id")).filter("_id is not null").groupBy("_id").agg(F.min("batch_id").alias("full"))
    out = wanted.select("id").distinct().withColumn("_id", F.upper("id")).join(b, "_id", "left")
    cut = F.expr("substring(full, 1, instr(upper(full), _id) + length(_id) - 1)")
    return out.select("id", F.coalesce(cut, F.col("id")).alias("root"))


def stage_labels(steps: DataFrame) -> DataFrame:
    """D4. Label of each stage: the text before `` - `` of its step names, the smallest; in order of the first step."""
    stage = F.regexp_replace("stage_id", r"-\d{2}$", "")
    rows = steps.select(stage.alias("stage_id"), F.trim(F.substring_index("stage", " - ", 1)).alias("label"), "ts")
    return rows.groupBy("stage_id").agg(F.min("label").alias("label"), F.min("ts").alias("first_ts"))


def batch_counts(**relations: DataFrame) -> DataFrame:
    """D5. Rows of each root in each relation: one tagged union and one pass of conditional counts."""
    tagged = None
    for name, df in relations.items():
        part = df.select("root", F.lit(name).alias("relation"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy("root").agg(*[F.count_if(F.col("relation") == n).alias(f"n_{n}") for n in relations])


def coalesce_siblings(rows: DataFrame, root: str, columns: list[str], order: list[str], times: tuple[str, ...] = ("start_time",)) -> DataFrame:
    """D13. One row a root: the first row with a time (else the first row), its blanks filled by the first sibling that isn't blank."""
    w = Window.partitionBy(root).orderBy(*nulls_last(*order))
    ranked = rows.withColumn("_o", F.row_number().over(w))
    timed = F.lit(False)
    for t in times:
        timed = timed | (ids.text_of(F.col(t).cast("string")) != "")
    base = F.struct(F.when(timed, 0).otherwise(1).alias("t"), F.col("_o"))
    out = []
    for c in columns:
        own = F.min_by(ids.blank_to_null(F.col(c).cast("string")), base)
        other = ids.blank_to_null(F.col(c).cast("string"))
        out.append(F.coalesce(own, F.min_by(other, F.when(other.isNotNull(), F.col("_o")))).alias(c))
    return ranked.groupBy(root).agg(*out)


def stage_index(stages: DataFrame, root: str = "root", order: str = "batch_id") -> DataFrame:
    """E2. Adds stage_index, from 1 within the root by batch id."""
    return stages.withColumn("stage_index", F.row_number().over(Window.partitionBy(root).orderBy(*nulls_last(order))))


def stage_yield(stages: DataFrame, root: str = "root", order: str = "ord") -> DataFrame:
    """D14, E2. yield_percent: last amount by the first (or the first batch size where that is missing or zero), one decimal.

    Decimal half-up; null where a part isn't a number or not above 0.
    """
    amount = F.col("amount").cast("string").try_cast("decimal(18,4)")
    size = F.col("batch_size").cast("string").try_cast("decimal(18,4)") if "batch_size" in stages.columns else F.lit(None).cast("decimal(18,4)")
    one = stages.groupBy(root).agg(F.min_by(F.struct(amount.alias("a"), size.alias("s")), order).alias("f"), F.max_by(F.struct(amount.alias("a")), order).alias("l"))
    first = F.coalesce(F.nullif(F.col("f.a"), F.lit(0).cast("decimal(18,4)")), F.col("f.s"))
    ok = (first > 0) & (F.col("l.a") != 0)
    return one.select(root, F.when(ok, F.round(F.col("l.a") * 100 / first, 1).cast("decimal(18,1)")).alias("yield_percent"))


def composition_rows(rows: DataFrame, order: list[str], units: dict[str, str] | None = None) -> DataFrame:
    """E7, H17, H21. Composition without stage repeats: first by (name, function, amount, unit), with amount text and ingredient flag."""
    key = [F.lower(ids.text_of("component_name")), F.lower(ids.text_of("component_function")), ids.text_of(F.col("amount").cast("string")), ids.text_of("amount_unit")]
    a = clean.amount_text(F.col("amount").cast("string"), F.col("amount_unit"), units)
    out = keep_first(rows, ["root", *key], nulls_last(*order))
    return out.withColumn("amount_per_unit", a["label"]).withColumn("is_ingredient", clean.is_ingredient(F.col("component_function")))


def component_split(rows: DataFrame, order: list[str], intermediate: str, substance: tuple[str, ...] = ()) -> DataFrame:
    """H18, H20, E7. Packaging (first by name and reference) and drug-substance lots (first by lot, else reference)."""
    name = F.coalesce(ids.blank_to_null("display_name"), ids.text_of("resolved_name"))
    kind = clean.component_class(name, F.col("component_ref"), intermediate, substance)
    lot = ids.component_lot(F.col("component_ref"))
    out = rows.withColumn("name", name).withColumn("kind", kind).withColumn("lot", lot).withColumn("batch_tail", ids.component_batch(F.col("component_ref"))).filter("kind is not null")
    key = F.when(F.col("kind") == "packaging", F.concat(F.lower("name"), F.lit("|"), ids.text_of("component_ref"))).otherwise(F.coalesce(ids.blank_to_null("lot"), ids.text_of("component_ref")))
    return keep_first(out, ["root", "kind", key], nulls_last(*order))


def first_parameters(rows: DataFrame, order: str = "ord") -> DataFrame:
    """D15. The first value that isn't empty (with its unit) of each parameter's short name."""
    short = F.substring_index("parameter_ref", ":", -1)
    filled = rows.filter(ids.text_of("value") != "")
    return filled.groupBy("root", short.alias("parameter")).agg(F.min_by(F.struct("value", "unit"), order).alias("v")).select("root", "parameter", "v.value", "v.unit")


def last_wins(rows: DataFrame, name: str, value: str, order: str, keys: tuple[str, ...] = ("root",)) -> DataFrame:
    """D16. The last value that isn't blank of each lower-cased name."""
    v = ids.blank_to_null(value)
    return rows.filter(v.isNotNull()).groupBy(*keys, F.lower(ids.text_of(name)).alias("name")).agg(F.max_by(v, order).alias("value"))


def composition_narrative(rows: DataFrame, order: str = "ord") -> DataFrame:
    """D17. Ingredients as ``amount name, ...`` in order; water isn't named."""
    named = rows.filter(F.col("is_ingredient") & ~F.lower(ids.text_of("component_name")).startswith("water"))
    return named.groupBy("root").agg(ordered_list(F.trim(F.concat_ws(" ", ids.blank_to_null("amount_per_unit"), "component_name")), F.col(order)).alias("narrative"))


def report_counts(compositions: DataFrame, components: DataFrame, stages: DataFrame) -> DataFrame:
    """D18. Ingredients, other rows, drug-substance lots, packaging and stages of each root."""
    one = lambda df, kind: df.select("root", kind.alias("kind"))
    rows = one(compositions, F.when(F.col("is_ingredient"), "ingredient").otherwise("other")).unionByName(one(components, F.col("kind"))).unionByName(one(stages, F.lit("stage")))
    return rows.groupBy("root").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("ingredient", "other", "substance", "packaging", "stage")])


def packaging_slots(components: DataFrame, order: str = "ord") -> DataFrame:
    """D19. First container, stopper and closure of each root."""
    low = F.lower("name")
    named = components.filter(F.col("kind") == "packaging").groupBy("root").agg(*[F.min(F.when(c, F.struct(order, "name"))).alias(n) for c, n in ((low.rlike("vial|syringe"), "c"), (low.contains("stopper"), "s"), (low.rlike("crimp|cap"), "k"))])
    return named.select("root", F.col("c.name").alias("container"), F.col("s.name").alias("stopper"), F.col("k.name").alias("closure"))


def active_concentration(rows: DataFrame, order: str = "ord") -> DataFrame:
    """D20. Amount of the first active ingredient that has one."""
    return rows.filter(F.lower(ids.text_of("component_function")).contains("active")).groupBy("root").agg(first_filled_by("amount_per_unit", order).alias("concentration"))


def general_info(report: DataFrame, lines: list[tuple[str, list[str]]], missing: str = "—") -> DataFrame:
    """D37, H23. One (parameter, value) row a line: the first of the line's columns that isn't blank, in order, else a dash."""
    rows = [F.struct(F.lit(i).alias("ord"), F.lit(name).alias("parameter"), clean.first_filled(*[F.col(c).cast("string") for c in columns], placeholder=missing).alias("value")) for i, (name, columns) in enumerate(lines)]
    return report.select("root", F.explode(F.array(*rows)).alias("r")).select("root", "r.*")


def backfill_header(headers: DataFrame, compositions: DataFrame, components: DataFrame, properties: DataFrame, info: DataFrame | None = None, order: str = "ord") -> DataFrame:
    """H23. Blank header fields from general information, then compositions, component names and material properties.

    ``headers``: root, dose_mg, dose_form_code, dose_form_label, volume_ml, container.  ``info`` (one row a root):
    dose_strength, dose_form, packaging_system.  Of a composition only the first active ingredient counts, and only in
    mg/mL; a fill volume stands in for a missing volume; unit strength and nominal volume override what is there.
    Stage amounts are no volumes.  What stays blank is null.
    """
    if info is None:
        info = headers.select("root", *[F.lit(None).cast("string").alias(c) for c in ("dose_strength", "dose_form", "packaging_system")])
    number = r"^\s*(\d+(?:\.\d+)?)"
    given = properties.groupBy("root").agg(*[F.max(F.when(F.col("parameter") == n, ids.blank_to_null("value"))).alias(f"_{n}") for n in ("unitStrength", "nominalVolume", "fillVolume")])
    active = compositions.filter(F.contains(F.lower(ids.text_of("component_function")), F.lit("active"))).groupBy("root").agg(F.min_by(F.struct("amount_per_unit"), order).alias("_a"))
    active = active.select("root", F.nullif(F.regexp_extract("_a.amount_per_unit", rf"(?i){number}\s*mg/mL\b", 1), F.lit("")).alias("_active"))
    boxes = components.groupBy("root").agg(*[F.bool_or(F.contains(F.lower("name"), F.lit(k))).alias(f"_{k}") for k in clean.CONTAINERS])
    own = info.select("root", "dose_strength", "dose_form", "packaging_system").toDF("root", "_strength", "_form", "_packed")
    out = headers
    for df in (own, active, boxes, given):
        out = out.join(df, "root", "left")
    form, packed = F.lower(F.col("_form")), F.lower(F.regexp_extract("_packed", r"(?i)\b(PFS|Vial|Cartridge|Syringe)\b", 1))
    by_form = F.when(form.contains("sol") & ~form.contains("powder"), "S.INJ").when(form.contains("powder") | form.contains("lyo"), "P.S.INJ")
    code = F.coalesce(by_form, F.when(F.col("_active").isNotNull(), "S.INJ"))
    has, names = ids.blank_to_null("dose_form_code").isNotNull(), F.create_map(*[F.lit(x) for k in ("S.INJ", "P.S.INJ") for x in (k, clean.DOSE_FORMS[k])])
    canonical = F.create_map(*[F.lit(x) for kv in clean.CONTAINERS.items() for x in kv])
    filled = {
        "dose_mg": F.coalesce("_unitStrength", ids.blank_to_null("dose_mg"), F.nullif(F.regexp_extract("_strength", number, 1), F.lit("")), "_active"),
        "dose_form_code": F.coalesce(ids.blank_to_null("dose_form_code"), code),
        "dose_form_label": F.when(has, ids.blank_to_null("dose_form_label")).otherwise(names[code]),
        "volume_ml": F.coalesce("_nominalVolume", ids.blank_to_null("volume_ml"), "_fillVolume"),
        "container": F.coalesce(ids.blank_to_null("container"), canonical[packed], *[F.when(F.col(f"_{k}"), v) for k, v in clean.CONTAINERS.items()]),
    }
    return out.select(*[c for c in headers.columns if c not in filled], *[v.alias(k) for k, v in filled.items()])


def list_ids(batches: DataFrame, limit: int = 200) -> DataFrame:
    """F5. The highest distinct short ids."""
    return batches.select(F.regexp_substr("batch_id", F.lit(r"BA[A-Z]?\d+")).alias("id")).filter("id is not null").distinct().orderBy(F.desc("id")).limit(limit)


def suggest_ids(batches: DataFrame, typed: str, most: int = 25) -> DataFrame:
    """F6. Short ids of batches that contain what was typed, case-insensitively; nothing for a blank."""
    hits = batches.filter(F.contains(F.upper("batch_id"), F.lit(typed.strip().upper())) if typed.strip() else F.lit(False))
    return hits.select(F.regexp_substr("batch_id", F.lit(r"BA[A-Z]?\d+")).alias("id")).filter("id is not null").distinct().orderBy("id").limit(most)


def batch_flags(info: DataFrame, compositions: DataFrame, components: DataFrame, stages: DataFrame) -> DataFrame:
    """G1. Review flags of batches: undecoded units, operations and stage amounts warn; what is absent (composition, drug-substance lot) and manual registration inform.

    ``stages``: unit_operation and confident; amounts are looked at where stages have amount and amount_unit.
    """
    roots = info.select("root").distinct()
    f = lambda df, no, area, message, severity="warn": df.select("root", F.lit(no).alias("rule_no"), F.lit(severity).alias("severity"), F.lit(area).alias("area"), message.alias("message"))
    unknown = lambda value, unit: (ids.text_of(F.col(value).cast("string")) != "") & ~clean.decoded(F.col(unit), clean.BATCH_UNITS)["confident"]
    rules = [f(info.filter(unknown(c, f"{c}_unit")), i, "general_info", F.concat(F.lit(f"{c} unit not decoded: "), F.col(f"{c}_unit"))) for i, c in enumerate(("batch_size", "dose_strength", "density"), 1)]
    rules.append(f(stages.filter("not confident"), 4, "stages", F.concat(F.lit("operation not decoded: "), ids.text_of("unit_operation"))))
    rules.append(f(roots.join(compositions.select("root"), "root", "left_anti"), 5, "composition", F.lit("no composition"), "info"))
    rules.append(f(roots.join(components.filter("kind = 'substance'").select("root"), "root", "left_anti"), 6, "components", F.lit("no drug-substance lot"), "info"))
    rules.append(f(roots.filter(ids.batch_id(F.col("root").cast("string"))["registration"] == "manual"), 7, "general_info", F.lit("manual registration"), "info"))
    if {"amount", "amount_unit"} <= set(stages.columns):
        rules.append(f(stages.filter(unknown("amount", "amount_unit")), 8, "stages", F.concat(F.lit("amount unit not decoded: "), F.col("amount_unit"))))
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out
