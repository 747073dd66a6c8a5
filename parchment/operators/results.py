"""Analytical report: result rows, methods, pivots, stability matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions import clean, ids

from .helpers import keep_first, nulls_last, ordered_list

NA = "N/A"
#: Bookkeeping names among the measured parameters.
METADATA = ("analysisid", "analysiscount", "resultid", "sampleid", "test material number", "peak name", "ecd", "replicate", "context", "result name", "analyte name", "uri")
#: Order of storage conditions.
CONDITIONS = {"5C": 0, "25C": 1, "40C": 2}
SIZE_ROW = "ECD"


def bind_ids(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """B1. Rows of the wanted ids: a semi-join, for many ids at once."""
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def drop_pairing_rows(df: DataFrame, name: str = "result_name", pairing: str = SIZE_ROW) -> DataFrame:
    """B4. Without the size rows; null names go too."""
    return df.filter(F.col(name) != pairing)


def drop_metadata_rows(df: DataFrame, name: str = "result_name") -> DataFrame:
    """B5. Without bookkeeping rows; a null name is no bookkeeping name."""
    return df.filter(~F.lower(ids.text_of(name)).isin(*METADATA))


def has_data_results(requests: DataFrame, validation: DataFrame, rows: DataFrame) -> DataFrame:
    """B9. request_id, has_data: the validation count is above 0; where there is no row to read, any result row; a null count is 0."""
    counts = validation.groupBy("request_id").agg(F.max(F.coalesce(F.col("result_rows").cast("string").try_cast("long"), F.when(F.col("result_rows").isNull(), 0))).alias("n"))
    any_row = rows.select("request_id").distinct().withColumn("some", F.lit(True))
    out = requests.select("request_id").distinct().join(counts, "request_id", "left").join(any_row, "request_id", "left")
    return out.select("request_id", F.coalesce(F.col("n") > 0, F.col("some"), F.lit(False)).alias("has_data"))


def request_header(requests: DataFrame, results: DataFrame, batch_properties: DataFrame) -> DataFrame:
    """C1, D1. One row a request: project from the first source that has one, and its batches as an ordered list."""
    joined = requests.select("request_id").join(results, "request_id").join(batch_properties.select("batch_id", "project_name"), "batch_id", "left")
    return joined.groupBy("request_id").agg(
        F.coalesce(F.max("project_name"), F.max("batch_project"), F.max("request_project")).alias("project_code"),
        F.array_join(F.array_sort(F.collect_set("batch_id")), ", ").alias("batch_ids"),
    )


def with_particle_size(results: DataFrame, pairing: str = SIZE_ROW) -> DataFrame:
    """C2, D3. particle_size: the largest size row of the same request, experiment, sample and group; one scan, no self-join.

    A null experiment, sample or group pairs with nothing.
    """
    keys = ["request_id", "experiment_id", "sample_id", "group_index"]
    size = F.max(F.when(F.col("result_name") == pairing, F.col("size_value"))).over(Window.partitionBy(*keys))
    known = F.col("experiment_id").isNotNull() & F.col("sample_id").isNotNull() & F.col("group_index").isNotNull()
    return results.withColumn("particle_size", F.when(known, size))


def result_rows(results: DataFrame, units: dict[str, str] | None = None) -> DataFrame:
    """C2, H4-H7, B4. Measured rows with value, source, decoded unit, size, timepoint and storage condition."""
    v = clean.reported_value(F.col("reported_value"), F.col("reported_number"), F.col("actual_value"), F.col("actual_number"))
    return drop_pairing_rows(with_particle_size(results)).select(
        "request_id", "experiment_id", ids.last_segment(F.col("technique")).alias("technique"), "result_name", "analyte_name", "sample_id", "sample_name", "batch_id", "detail_context",
        v["value"].alias("reported_value"), v["source"].alias("value_source"), clean.unit_label(F.col("unit"), units).alias("units"), "particle_size",
        ids.timepoint(F.col("sample_name")).alias("timepoint"), ids.storage(F.col("sample_name")).alias("storage"),
    )


def result_order() -> list[Column]:
    """F1. technique, batch, sample, size, name; nulls last."""
    return nulls_last("technique", "batch_id", "sample_name", "particle_size", "result_name")


def batch_lots(results: DataFrame, lots: DataFrame) -> DataFrame:
    """C3, G2. Distinct batches with the lot's name, null where there is no lot."""
    return results.select("request_id", "batch_id").distinct().join(lots.select(F.col("id").alias("batch_id"), F.col("displayname").alias("lot_display")), "batch_id", "left")


def first_summary(results: DataFrame) -> DataFrame:
    """E1. The first conclusion of each request by its experiment id."""
    rows = results.filter(F.col("summary_conclusion").isNotNull()).select("request_id", "summary_exp_id", "scope", "summary_conclusion")
    return keep_first(rows, ["request_id"], nulls_last("summary_exp_id", "scope", "summary_conclusion"))


def validation_counts(results: DataFrame) -> DataFrame:
    """D2. Rows and distinct experiments, samples and batches of each request."""
    return results.groupBy("request_id").agg(F.count("*").alias("result_rows"), *[F.countDistinct(f"{c}_id").alias(f"n_{c}s" if c != "batch" else "n_batches") for c in ("experiment", "sample", "batch")])


def method_techniques(methods: DataFrame, hints: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """H4, H8, H9 of each distinct (test_description, method_reference): technique, confident and the reference without its version.

    There are few of them, however many rows name them, so the texts are read once each and joined back.
    """
    head = F.coalesce(ids.blank_to_null(ids.last_segment(F.col("test_description"))), F.col("test_description"))
    t = clean.technique(head, F.col("method_reference"), hints)
    named = methods.select("test_description", "method_reference").distinct()
    return named.select(F.col("test_description").alias("_d"), F.col("method_reference").alias("_m"), t.alias("t"), clean.strip_version(F.col("method_reference")).alias("short")).select("_d", "_m", "t.name", "t.confident", "short")


def methods_rollup(methods: DataFrame, hints: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """D6, F4, E26. One row a technique and method: experiments by (length, text), confidence, display number ``3.i``.

    A technique is what follows the last ``_`` or ``-`` of a description; blank experiments aren't named.
    ``hints``: (part of a method reference, technique) pairs that tell an ambiguous header's techniques apart.
    """
    t = method_techniques(methods, hints)
    eln = F.nullif(F.trim(F.col("eln_id").cast("string")), F.lit(""))
    rows = methods.select("request_id", eln.alias("eln_id"), "test_description", "method_reference").distinct()
    rows = rows.join(t, F.col("test_description").eqNullSafe(F.col("_d")) & F.col("method_reference").eqNullSafe(F.col("_m")))
    rows = rows.select("request_id", "eln_id", F.col("name").alias("technique"), "confident", F.col("short").alias("method_reference"))
    out = rows.groupBy("request_id", "technique", "method_reference").agg(
        F.array_sort(F.collect_set(F.when(F.col("eln_id").isNotNull(), F.struct(F.length("eln_id").alias("n"), F.col("eln_id"))))).alias("e"), F.bool_and("confident").alias("confident"), F.min("eln_id").alias("first_eln")
    )
    w = Window.partitionBy("request_id").orderBy(*nulls_last("first_eln", "technique", "method_reference"))
    return out.select("request_id", "technique", "method_reference", F.array_join(F.col("e.eln_id"), ", ").alias("eln_ids"), "confident", F.concat(F.lit("3."), F.row_number().over(w).cast("string")).alias("number"))


def sample_columns(results: DataFrame) -> DataFrame:
    """D7. Sorted distinct samples of each request."""
    return results.groupBy("request_id").agg(F.array_sort(F.collect_set("sample_id")).alias("samples"))


def results_pivot(rows: DataFrame, order: Column) -> DataFrame:
    """D8. Long pivot: every (technique, label) and sample of a request; the last value in order wins, ``N/A`` where none.

    ``rows``: request_id, technique, label, sample_id, value.
    """
    line = ["request_id", "technique", "label"]
    cells = rows.repartition(*line).groupBy(*line, "sample_id").agg(F.max_by("value", order).alias("value"))
    # a line has its cells as a map, a request its samples once; they meet by request
    lines = cells.groupBy(*line).agg(F.map_from_entries(F.collect_list(F.when(F.col("sample_id").isNotNull(), F.struct("sample_id", "value")))).alias("m"), F.max(F.when(F.col("sample_id").isNull(), F.struct("value"))).alias("none"))
    samples = rows.groupBy(F.col("request_id").alias("of")).agg(F.collect_set("sample_id").alias("s"), F.bool_or(F.col("sample_id").isNull()).alias("some"))
    wide = lines.join(samples, F.col("request_id").eqNullSafe(F.col("of")))
    every = F.concat(F.transform("s", lambda s: F.struct(s.alias("sample_id"), F.col("m")[s].alias("value"))), F.when(F.col("some"), F.array(F.struct(F.lit(None).cast("string").alias("sample_id"), F.col("none.value").alias("value")))).otherwise(F.array()))
    long = wide.select(*line, F.explode(every).alias("c"))
    return long.select(*line, "c.sample_id", F.coalesce(F.nullif("c.value", F.lit("")), F.lit(NA)).alias("value"))


def prefer_container(rows: DataFrame) -> DataFrame:
    """C10. ``per volume`` rows go where a ``per container`` row has the same request, batch, sample, technique and size (not null).

    One window over the keys; rows without a size or of another context stay.
    """
    keys = ["request_id", "batch_id", "sample_name", clean.tech_key(F.col("technique")), "particle_size"]
    other = F.max(F.when(F.lower("detail_context") == "per container", 1)).over(Window.partitionBy(*keys))
    gone = (F.lower("detail_context") == "per volume") & F.col("particle_size").isNotNull() & other.isNotNull()
    return rows.withColumn("_gone", F.coalesce(gone, F.lit(False))).filter("not _gone").drop("_gone")


def matrix_cells(rows: DataFrame, order: list[Column]) -> DataFrame:
    """D9. One cell a batch, sample, technique key and leaf: distinct rounded values in first-seen order, and whether any is actual."""
    w = Window.partitionBy("request_id", "batch_id").orderBy(*order)
    numbered = rows.withColumn("ord", F.row_number().over(w)).withColumn("actual", F.col("value_source") == "actual")
    cells = numbered.select(
        "request_id", "batch_id", "sample_name", clean.tech_key(F.col("technique")).alias("tech_key"), clean.leaf_label(F.col("particle_size"), F.col("analyte_name"), F.col("result_name")).alias("leaf"),
        clean.round_value(F.col("reported_value")).alias("value"), "actual", "ord",
    )
    keys = ["request_id", "batch_id", "sample_name", "tech_key", "leaf"]
    values = cells.groupBy(*keys, "value").agg(F.min("ord").alias("ord"), F.bool_or("actual").alias("actual"))
    return values.groupBy(*keys).agg(F.coalesce(ordered_list(F.nullif("value", F.lit("")), F.col("ord"), " / "), F.lit("")).alias("value"), F.coalesce(F.bool_or("actual"), F.lit(False)).alias("is_actual"))


def leaf_order(leaf: Column) -> Column:
    """F3. Sizes by number, then other labels by text."""
    size = F.regexp_extract(leaf, r">=\s*([\d.]+)", 1).try_cast("double")
    return F.struct(F.when(size.isNull(), 1).otherwise(0).alias("a"), F.coalesce(size, F.lit(0.0)).alias("b"), F.when(size.isNull(), F.lower(leaf)).otherwise("").alias("c"))


def display_technique(names: str = "technique") -> Column:
    """H14. Aggregate: the shortest name without a replacement character."""
    n = F.col(names)
    return clean.translate_terms(F.min_by(n, F.struct(n.contains("�").alias("bad"), F.length(n).alias("n"), n.alias("t"))))


def matrix_headers(rows: DataFrame, order: list[Column]) -> DataFrame:
    """D10. Leaves of each batch: technique group by display name, leaf in order, the group's width, the last row's unit."""
    w = Window.partitionBy("request_id", "batch_id").orderBy(*order)
    base = rows.withColumn("ord", F.row_number().over(w)).withColumn("tech_key", clean.tech_key(F.col("technique"))).withColumn("leaf", clean.leaf_label(F.col("particle_size"), F.col("analyte_name"), F.col("result_name")))
    names = base.groupBy("request_id", "batch_id", "tech_key").agg(display_technique().alias("technique"))
    leaves = base.groupBy("request_id", "batch_id", "tech_key", "leaf").agg(F.max_by("units", "ord").alias("unit")).join(names, ["request_id", "batch_id", "tech_key"])
    group = Window.partitionBy("request_id", "batch_id", "tech_key")
    batch = Window.partitionBy("request_id", "batch_id").orderBy(F.lower("technique"), "tech_key")
    return leaves.select(
        "request_id", "batch_id", "tech_key", "technique", "leaf", "unit", F.count("*").over(group).alias("group_span"),
        F.dense_rank().over(batch).alias("group_no"), F.row_number().over(group.orderBy(leaf_order(F.col("leaf")))).alias("leaf_no"),
    )


def lead_columns(rows: DataFrame) -> DataFrame:
    """D11, D12. Of each request: whether any row has a timepoint (then it is a stability report) or a storage condition."""
    return rows.groupBy("request_id").agg(F.bool_or(F.col("timepoint").isNotNull()).alias("has_timepoint"), F.bool_or(F.col("storage").isNotNull()).alias("has_storage"), F.bool_or(F.col("timepoint").isNotNull()).alias("is_stability"))


def row_order(timepoint: Column, storage: Column) -> Column:
    """F2. Days before months before none, then the storage condition."""
    days = F.regexp_replace(timepoint, r"\D", "").try_cast("int")
    months = F.regexp_extract(timepoint, r"^(\d+)M", 1).try_cast("int")
    conditions = F.create_map(*[F.lit(x) for kv in CONDITIONS.items() for x in kv])
    kind = F.when(F.coalesce(timepoint, F.lit("")) == "", 2).when(F.lower(timepoint).startswith("day"), 0).otherwise(1)
    return F.struct(kind.alias("kind"), F.when(kind == 0, F.coalesce(days, F.lit(0))).when(kind == 1, F.coalesce(months, F.lit(999))).otherwise(0).alias("n"), F.coalesce(conditions[storage], F.lit(9)).alias("condition"))


def request_picker(requests: DataFrame, prefix: str = "") -> DataFrame:
    """F9, H1. Distinct ids in their normal forms; what has none is left out."""
    return requests.select(ids.request_id(F.col("request_id").cast("string"), prefix, prefix).alias("r")).filter("r is not null").select("r.*").distinct()


def result_flags(rows: DataFrame, methods: DataFrame, attachment: str = "Attachment A01", hints: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """G1, F10. Review flags of methods, then results: (request_id, rule_no, method_no, severity, area, message).

    Methods are those of the rollup, ``method_no`` their place in it (null for results); one whose experiments carry
    the ``attachment`` mark is a third party's.  Results are named by technique, label and sample; repeats are one flag.
    """
    m = methods_rollup(methods, hints).withColumn("method_no", F.substring_index("number", ".", -1).cast("int"))
    named = F.concat(F.col("technique"), F.lit(" ("), F.col("eln_ids"), F.lit(")"))

    def flag(df: DataFrame, no: int, severity: str, area: str, message: Column) -> DataFrame:
        place = "method_no" if "method_no" in df.columns else F.lit(None).cast("int").alias("method_no")
        return df.select("request_id", F.lit(no).alias("rule_no"), place, F.lit(severity).alias("severity"), F.lit(area).alias("area"), message.alias("message"))

    # what is missing or ambiguous is few rows: techniques and labels are read for these alone
    heads = rows.select("request_id", "technique", "result_name").distinct().withColumn("t", clean.technique(F.col("technique"), F.col("result_name")))
    missing = rows.filter(ids.text_of("reported_value") == "").select("request_id", "technique", "result_name", "units", "analyte_name", F.col("sample_id").cast("string").alias("sample")).distinct()
    name = clean.technique(F.col("technique"), F.col("result_name"))["name"]
    label = clean.parameter_label(F.col("name"), F.col("result_name"), F.col("units"), F.col("analyte_name"))
    missing = missing.withColumn("name", name).select("request_id", F.concat_ws(" / ", "name", label, F.coalesce("sample", F.lit(""))).alias("what")).distinct()
    rules = [
        flag(m.filter(ids.text_of("method_reference") == ""), 1, "warn", "methods", F.concat(F.lit("method reference missing for "), named)),
        flag(m.filter("not confident"), 2, "warn", "methods", F.concat(F.lit("ambiguous technique: "), named)),
        flag(missing, 3, "warn", "results", F.concat(F.lit("value missing: "), F.col("what"))),
        flag(heads.filter("not t.confident").select("request_id", "t.name").distinct(), 4, "warn", "results", F.concat(F.lit("ambiguous technique: "), F.col("name"))),
        flag(m.filter(F.contains(F.lower("eln_ids"), F.lit(attachment.lower()))), 5, "info", "methods", F.concat(F.lit("third-party result: "), named)),
    ]
    out = rules[0]
    for rule in rules[1:]:
        out = out.unionByName(rule)
    return out
