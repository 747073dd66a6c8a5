"""Queries of the batch report: compositions, components, stages, headers and general information, over every order as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchment.functions import clean, ids
from parchment.operators import batches as B
from parchment.operators import results as R
from parchment.operators.helpers import nulls_last

from . import views as V

OPERATIONS = {"urn:op:0": "Mixing", "urn:op:1": "Filling", "urn:op:2": "Filtration"}
LINES = [
    ("Batch size", ["batch_size"]), ("Dosage form", ["dose_form", "form_code"]), ("Strength", ["dose_mg"]), ("Container", ["manual_container", "container"]), ("Manufacturer", ["maker"]),
]


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order numbered in a full order of their columns."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    w = Window.partitionBy("l_orderkey").orderBy(*order)
    return V.t(spark, sf, "lineitem").withColumn("root", F.col("l_orderkey")).withColumn("ord", F.row_number().over(w))


def _case(column, *values, other=None):
    out = F.lit(other)
    for k, v in reversed(list(enumerate(values))):
        out = F.when(column == k, v).otherwise(out)
    return out


def components(spark: SparkSession, sf: str) -> DataFrame:
    """Components of a batch: packaging, drug-substance lots and prior-stage intermediates by name and reference."""
    part = F.lpad(F.col("l_partkey").cast("string"), 6, "0")
    seven = (F.col("l_partkey") % 7).cast("string")
    return lines(spark, sf).select(
        "root", "ord", _case(F.col("l_linenumber") % 5, "Vial 6R", "Stopper 20 mm", "", "Drug Substance A", other="Crimp Cap").alias("display_name"),
        F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("Syringe "), seven)).otherwise(F.concat(F.lit("DS lot "), seven)).alias("resolved_name"),
        _case(F.col("l_suppkey") % 4, F.concat(F.lit("urn:batch:stage-BAX"), part), F.concat(F.lit("urn:batch:ext-"), part), F.concat(F.lit("urn:batch:BA"), part)).alias("component_ref"),
    )


def split(spark: SparkSession, sf: str) -> DataFrame:
    return B.component_split(components(spark, sf), ["ord"], intermediate="stage-", substance=("ext-",))


def component_classes(spark: SparkSession, sf: str) -> DataFrame:
    """E7, H18, H20."""
    return split(spark, sf).select("root", "name", "kind", "lot", "batch_tail", "component_ref")


def filtered_components(spark: SparkSession, sf: str) -> DataFrame:
    """B3."""
    return B.filter_components(components(spark, sf)).select("root", "ord", "display_name", "component_ref")


def packaging_slots(spark: SparkSession, sf: str) -> DataFrame:
    """D19."""
    return B.packaging_slots(split(spark, sf))


def compositions(spark: SparkSession, sf: str) -> DataFrame:
    """C4, then E7, H17 and H21: the parts of each order's formulation; every seventh order has none."""
    keyed = lines(spark, sf).select("root", "ord", F.when(F.col("root") % 7 != 0, F.col("l_partkey")).alias("formulation_id"), F.col("l_quantity").cast("int").cast("string").alias("amount"))
    parts = V.t(spark, sf, "part").select(
        F.col("p_partkey").alias("formulation_id"), _case(F.col("p_size") % 4, "Water for injection", "Sucrose", "Polysorbate 80", other="Vial").alias("component_name"),
        _case(F.col("p_partkey") % 5, "Active ingredient", "Bulk solution", "Stopper", other="Excipient").alias("component_function"),
    )
    rows = B.composition(keyed, parts).withColumn("amount_unit", F.lit("http://qudt.org/vocab/unit/MilliGM"))
    return B.composition_rows(rows, ["ord"])


def composition_rows(spark: SparkSession, sf: str) -> DataFrame:
    """C4, E7, H17, H21."""
    return compositions(spark, sf).select("root", "ord", "component_name", "component_function", "amount_per_unit", "is_ingredient")


def composition_narrative(spark: SparkSession, sf: str) -> DataFrame:
    """D17."""
    return B.composition_narrative(compositions(spark, sf))


def active_concentration(spark: SparkSession, sf: str) -> DataFrame:
    """D20."""
    return B.active_concentration(compositions(spark, sf))


def report_counts(spark: SparkSession, sf: str) -> DataFrame:
    """D18."""
    return B.report_counts(compositions(spark, sf), split(spark, sf), lines(spark, sf))


def stage_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Stage labels, else the decoded operation, else its address; with the stage's place."""
    s = lines(spark, sf).select("root", F.concat_ws("-", F.col("root").cast("string"), F.lpad(F.col("ord").cast("string"), 3, "0")).alias("stage_id"), F.concat(F.lit("urn:op:"), (F.col("l_suppkey") % 5).cast("string")).alias("unit_operation_uri"), (F.col("l_partkey") % 3 == 0).alias("named"))
    labels = s.filter("named").select("stage_id", F.concat(F.lit("Step "), F.right("stage_id", F.lit(3))).alias("label"))
    return B.stage_index(B.label_stages(s.drop("named"), labels, OPERATIONS), order="stage_id")


def decoded_status(spark: SparkSession, sf: str) -> DataFrame:
    """C9 from a table of names: a miss stays raw, an empty one is confident."""
    names = V.t(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("key"), F.col("r_name").alias("label"))
    o = V.t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "").otherwise((F.col("o_custkey") % 8).cast("string")).alias("region"))
    return B.decode_dict(o, "region", names)


def material_properties(spark: SparkSession, sf: str) -> DataFrame:
    """C6."""
    used = V.t(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("material_id"))
    props = V.t(spark, sf, "part").select(F.col("p_partkey").alias("material_id"), F.col("p_brand").alias("value"))
    return B.material_properties(props, used)


def quality_standards(spark: SparkSession, sf: str) -> DataFrame:
    """Two chained left joins; references without a lot keep a null name."""
    p = V.t(spark, sf, "orders").select(F.col("o_orderkey").alias("ref_id"), F.when(F.col("o_orderkey") % 2 == 0, "qualityStandardRef").otherwise("other").alias("parameter_ref"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("value"))
    c = V.t(spark, sf, "orders").select(F.col("o_orderkey").alias("component_id"), F.concat(F.lit("urn:batch:"), (F.col("o_custkey") * 2).cast("string")).alias("component_ref"))
    lots = V.t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("displayname"))
    return B.quality_standard(p, c, lots)


def picked_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """B6."""
    p = V.t(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("parameter_ref"))
    return B.pick_parameters(p, ["Brand#11", "Brand#23", "Brand#5", "Brand#1"])


def last_values(spark: SparkSession, sf: str) -> DataFrame:
    """The last value that isn't blank of each lower-cased name."""
    s = lines(spark, sf).select("root", "ord", _case(F.col("l_partkey") % 3, " Density", "DENSITY", other="pH ").alias("name"), F.when(F.col("l_suppkey") % 4 == 0, " ").otherwise(F.col("l_partkey").cast("string")).alias("value"))
    return B.last_wins(s, "name", "value", "ord")


def batches_with_data(spark: SparkSession, sf: str) -> DataFrame:
    """B10."""
    roots = V.t(spark, sf, "orders").select(F.col("o_orderkey").alias("root"))
    l = V.t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("root"), "l_quantity", "l_returnflag")  # noqa: E741
    return B.has_data_batches(roots, l.filter("l_quantity > 49"), l.filter("l_returnflag = 'R' and l_quantity < 3"))


def bound_batches(spark: SparkSession, sf: str) -> DataFrame:
    """B2: the batches of each root, by prefix and exactly."""
    b = V.t(spark, sf, "part").select(F.concat(F.lit("BAX"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 2 == 0, "-01").otherwise("")).alias("batch_id"))
    roots = V.t(spark, sf, "supplier").select(F.concat(F.lit("BAX"), (F.col("s_suppkey") + 1000).cast("string")).alias("root"))
    exact = B.bind_prefix(b, roots).withColumn("how", F.lit("exact"))
    return exact.unionByName(B.bind_prefix(b, roots, exact=False).withColumn("how", F.lit("prefix"))).select("root", "batch_id", "how")


def header_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Batch headers: name parts of an order, some blank."""
    name = F.concat_ws(" ", F.concat((F.col("o_custkey") % 400 + 1).cast("string"), F.lit("mg")), _case(F.col("o_orderkey") % 3, "S.INJ", "P.S.INJ", other="tablet"), F.when(F.col("o_custkey") % 4 != 0, F.concat((F.col("o_custkey") % 20 + 1).cast("string"), F.lit(".5 mL"))), _case(F.col("o_orderkey") % 4, "vial", "PFS", "cartridge"))
    p = clean.batch_name_parts(name)
    return V.t(spark, sf, "orders").select(F.col("o_orderkey").alias("root"), p.alias("p"), name.alias("batch_name")).select("root", "batch_name", "p.*")


def batch_names(spark: SparkSession, sf: str) -> DataFrame:
    """Dose, form, volume and container read from a name, the title line and the amount in a unit."""
    h = header_rows(spark, sf)
    parts = F.struct("dose_mg", "dose_form_code", "volume_ml", "container")
    return h.select("root", "dose_mg", "dose_form_code", "dose_form_label", "volume_ml", "container", clean.title_line(parts).alias("title_line"), clean.mg_per_unit(F.concat("dose_mg", F.lit(" mg/mL")), F.col("volume_ml")).alias("amount"))


def backfilled_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Blank header fields from general information, compositions, components and properties; unit strength and nominal volume override."""
    blank = lambda by, c: F.when(by, "").otherwise(F.col(c)).alias(c)
    named = F.col("root") % 4 == 0
    headers = header_rows(spark, sf).select("root", blank(F.col("root") % 2 != 0, "dose_mg"), blank(named, "dose_form_code"), blank(named, "dose_form_label"), blank(F.col("root") % 5 == 0, "volume_ml"), blank(named, "container"))
    o = V.t(spark, sf, "orders").withColumnRenamed("o_orderkey", "root")
    props = o.select("root", _case(F.col("root") % 3, "unitStrength", "nominalVolume", other="fillVolume").alias("parameter"), F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey").cast("string")).otherwise("").alias("value"))
    info = o.select(
        "root", F.when(F.col("o_custkey") % 5 < 2, F.concat((F.col("o_custkey") % 90).cast("string"), F.lit(".5 mg/mL"))).alias("dose_strength"),
        _case(F.col("o_custkey") % 4, "Solution", "Lyophilised powder", "Tablet").alias("dose_form"), _case(F.col("o_custkey") % 6, "6R vial, clear", "pfs 1 mL").alias("packaging_system"),
    )
    made = compositions(spark, sf).withColumn("amount_per_unit", F.when(F.col("root") % 3 > 0, F.concat("amount_per_unit", F.lit("/mL"))).otherwise(F.col("amount_per_unit")))
    return B.backfill_header(headers, made, split(spark, sf), props, info)


def general_info(spark: SparkSession, sf: str) -> DataFrame:
    """One (parameter, value) row a line of the table, with its fallback order."""
    h = header_rows(spark, sf).select(
        "root", F.when(F.col("root") % 3 == 0, "").otherwise((F.col("root") % 50).cast("string")).alias("batch_size"), F.col("dose_form_label").alias("dose_form"), F.col("dose_form_code").alias("form_code"), "dose_mg",
        F.when(F.col("root") % 6 == 0, "Bag").alias("manual_container"), "container", F.lit(" ").alias("maker"),
    )
    return B.general_info(h, LINES)


def batch_flags(spark: SparkSession, sf: str) -> DataFrame:
    """G1: undecoded units, operations and amounts, no composition, no drug-substance lot, manual registration."""
    o = V.t(spark, sf, "orders")
    unit = F.when(F.col("o_orderkey") % 2 == 0, "http://qudt.org/vocab/unit/L").otherwise("urn:unit:9")
    code = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "BAX").otherwise("BA"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0"))
    info = o.select(code.alias("root"), F.when(F.col("o_custkey") % 4 != 0, "5").alias("batch_size"), unit.alias("batch_size_unit"), F.lit("").alias("dose_strength"), unit.alias("dose_strength_unit"), F.when(F.col("o_custkey") % 5 == 0, "1.1").alias("density"), unit.alias("density_unit"))
    comp = o.filter("o_orderstatus <> 'P'").select(code.alias("root"))
    parts = o.filter("o_orderpriority <> '5-LOW'").select(code.alias("root"), F.when(F.col("o_orderpriority") == "1-URGENT", "packaging").otherwise("substance").alias("kind"))
    stages = o.select(code.alias("root"), F.lit("urn:op:7").alias("unit_operation"), (F.col("o_custkey") % 2 == 0).alias("confident"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).alias("amount"), unit.alias("amount_unit"))
    return B.batch_flags(info, comp, parts, stages)


def bound_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted distinct samples of the wanted requests."""
    wanted = V.t(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("request_id"))
    return R.sample_columns(R.bind_ids(V.results(spark, sf), wanted, "request_id"))


def measured_names(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of bookkeeping names go, rows without a name stay."""
    p = V.t(spark, sf, "part").select("p_partkey", _case(F.col("p_partkey") % 6, " Peak Name ", "ECD", "Context", "Density", F.lit(None).cast("string"), other="Purity").alias("result_name"))
    return R.drop_metadata_rows(p)


def requests_with_data(spark: SparkSession, sf: str) -> DataFrame:
    """By the validation count, else by any row; a null count is 0."""
    o = V.t(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id"), "o_custkey", "o_orderstatus")
    validation = o.filter("o_orderstatus <> 'F'").select("request_id", _case(F.col("o_custkey") % 4, "0", F.lit(None).cast("string"), "7", other="many").alias("result_rows"))
    return R.has_data_results(o, validation, V.t(spark, sf, "lineitem").filter("l_quantity > 30").select(F.col("l_orderkey").alias("request_id")))


def stability_rows(spark: SparkSession, sf: str) -> DataFrame:
    """place of each row of a request in report order and in stability order."""
    rows = R.result_rows(V.results(spark, sf))
    tie = ["reported_value", "value_source", "experiment_id", "sample_id", "detail_context"]
    report = Window.partitionBy("request_id").orderBy(*R.result_order(), *nulls_last(*tie))
    stability = Window.partitionBy("request_id").orderBy(R.row_order(F.col("timepoint"), F.col("storage")), "sample_name", *R.result_order(), *nulls_last(*tie))
    return rows.select("request_id", "experiment_id", "sample_id", "result_name", "reported_value", F.row_number().over(report).alias("report_no"), F.row_number().over(stability).alias("stability_no"))


def parameter_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels without the technique's word, with analyte and unit, in English and with their umlauts put right."""
    k = F.col("p_partkey")
    name = _case(k % 8, "Trübung", "TrÃ¼bung", "pH value", "Purity by SEC", "Sichtbare Partikel", "Gehalt_a", "Dichte", other="Rate [1/s]")
    tech = F.when(k % 16 < 8, "Purity").otherwise("Visible")
    return V.t(spark, sf, "part").select("p_partkey", clean.parameter_label(tech, name, F.when(k % 3 == 0, "mg"), F.when(k % 5 == 0, "Monomer")).alias("label"), clean.translate_terms(name).alias("translated"), clean.fix_mojibake(name).alias("repaired"))


def resolved_techniques(spark: SparkSession, sf: str) -> DataFrame:
    """Techniques told apart by hints that the caller gives; batch ids and experiment ids in their normal forms."""
    k = F.col("p_partkey")
    t = clean.technique(_case(k % 4, "MFI", "Compendial", "PS20", other="Färbung"), _case(k % 3, "DOC-1 ph", "clarity of", other="none"))
    b = ids.batch_id(F.concat(_case(k % 3, "x bax", "y BA", other="z BQ-"), F.lpad(k.cast("string"), 5, "0"), F.lit(" z")), registered_prefix="reg-")
    url = F.when(k % 2 == 0, F.concat(F.lit("https://h/p?entityId="), k.cast("string"), F.lit("&v=1")))
    return V.t(spark, sf, "part").select("p_partkey", t["name"].alias("technique"), t["confident"].alias("confident"), b["short"].alias("short"), b["query"].alias("query"), b["registration"].alias("registration"), ids.experiment_id(url).alias("experiment"))


def file_names(spark: SparkSession, sf: str) -> DataFrame:
    """Keys, safe names, titles, sizes and capped texts."""
    k = F.col("o_orderkey")
    name = F.concat(F.lit("dir\\My  report: "), k.cast("string"), F.lit("?.pdf"))
    return V.t(spark, sf, "orders").select(
        "o_orderkey", ids.object_key(F.lit("/root/"), k, F.lit("output"), name, F.when(k % 2 == 0, "drafts")).alias("key"), ids.archive_key("arch/", F.lit("re port"), F.when(k % 3 != 0, F.concat(F.lit("--A/"), (k % 5).cast("string"))), k.cast("string"), F.lit("v 1"), ".pdf").alias("archive"),
        ids.sanitized_filename(name).alias("safe"), ids.output_stem(name, 12).alias("stem"), clean.strip_control(F.concat(F.lit("a\x01b\tc"), k.cast("string"))).alias("printable"), clean.doc_title(F.when(k % 2 == 0, " "), F.when(k % 3 == 0, "Meta"), F.concat(F.lit("a/b/stem"), k.cast("string"), F.lit(".v1.docx"))).alias("title"),
        ids.format_bytes(k * k * 37).alias("size"), ids.given_name(F.when(k % 2 == 0, "Family, Given Middle").otherwise("Ada B Lovelace")).alias("given"), ids.humanize_key(F.concat(F.lit("some_key-part."), k.cast("string"))).alias("human"),
        clean.cap_text(F.col("o_comment") if "o_comment" in V.t(spark, sf, "orders").columns else F.repeat(k.cast("string"), 3), 9, "...").alias("capped"), ids.progress(k % 300 - 100).alias("progress"),
    )


_NAMES = (
    component_classes, filtered_components, packaging_slots, composition_rows, composition_narrative, active_concentration, report_counts, stage_operations, decoded_status, material_properties, quality_standards, picked_parameters, last_values,
    batches_with_data, bound_batches, batch_names, backfilled_headers, general_info, batch_flags, bound_requests, measured_names, requests_with_data, stability_rows, parameter_labels, resolved_techniques, file_names,
)
QUERIES = {f.__name__: f for f in _NAMES}

_LINES = "ln AS (SELECT *, l_orderkey AS root, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus)::INTEGER AS ord FROM lineitem)"
_P6 = "lpad(CAST(l_partkey AS VARCHAR), 6, '0')"
_COMPONENTS = f"""{_LINES}, comp AS (SELECT root, ord, CASE l_linenumber % 5 WHEN 0 THEN 'Vial 6R' WHEN 1 THEN 'Stopper 20 mm' WHEN 2 THEN '' WHEN 3 THEN 'Drug Substance A' ELSE 'Crimp Cap' END AS display_name,
 CASE WHEN l_partkey % 2 = 0 THEN 'Syringe ' || (l_partkey % 7) ELSE 'DS lot ' || (l_partkey % 7) END AS resolved_name,
 CASE l_suppkey % 4 WHEN 0 THEN 'urn:batch:stage-BAX' || {_P6} WHEN 1 THEN 'urn:batch:ext-' || {_P6} WHEN 2 THEN 'urn:batch:BA' || {_P6} END AS component_ref FROM ln)"""
_SPLIT = f"""{_COMPONENTS}, named AS (SELECT *, CASE WHEN display_name <> '' THEN display_name ELSE resolved_name END AS name FROM comp),
kinds AS (SELECT *, CASE WHEN coalesce(component_ref, '') NOT LIKE '%stage-%' AND regexp_matches(lower(name), 'vial|syringe|stopper|crimp|cap') THEN 'packaging' WHEN regexp_matches(lower(name), 'drug substance|ds lot') OR component_ref LIKE '%ext-%' THEN 'substance' END AS kind,
 CASE WHEN component_ref LIKE '%ext-%' THEN substring(component_ref, 15) ELSE '' END AS lot, CASE WHEN component_ref LIKE '%BA%' THEN regexp_extract(component_ref, 'BAX?[0-9]+') ELSE '' END AS batch_tail FROM named),
parts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root, kind, CASE WHEN kind = 'packaging' THEN lower(name) || '|' || coalesce(component_ref, '') WHEN lot <> '' THEN lot ELSE coalesce(component_ref, '') END ORDER BY ord) AS k FROM kinds WHERE kind IS NOT NULL) WHERE k = 1)"""
_COMPOSED = f"""{_LINES}, cx AS (SELECT root, ord, CASE p_size % 4 WHEN 0 THEN 'Water for injection' WHEN 1 THEN 'Sucrose' WHEN 2 THEN 'Polysorbate 80' ELSE 'Vial' END AS component_name, CASE p_partkey % 5 WHEN 0 THEN 'Active ingredient' WHEN 1 THEN 'Bulk solution' WHEN 2 THEN 'Stopper' ELSE 'Excipient' END AS component_function, CAST(l_quantity AS INTEGER) AS amount FROM ln JOIN part ON p_partkey = l_partkey WHERE root % 7 <> 0),
composed AS (SELECT root, ord, component_name, component_function, amount || ' mg' AS amount_per_unit, component_function NOT IN ('Bulk solution', 'Stopper') AS is_ingredient FROM (SELECT *, row_number() OVER (PARTITION BY root, component_name, component_function, amount ORDER BY ord) AS k FROM cx) WHERE k = 1)"""
_SLOTS = "slots AS (SELECT root, arg_min(name, ord) FILTER (WHERE regexp_matches(lower(name), 'vial|syringe')) AS container, arg_min(name, ord) FILTER (WHERE lower(name) LIKE '%stopper%') AS stopper, arg_min(name, ord) FILTER (WHERE regexp_matches(lower(name), 'crimp|cap')) AS closure FROM parts WHERE kind = 'packaging' GROUP BY 1)"
_HEADER = """hd AS (SELECT o_orderkey AS root, o_custkey, CAST(o_custkey % 400 + 1 AS VARCHAR) AS dose_mg, CASE o_orderkey % 3 WHEN 0 THEN 'S.INJ' WHEN 1 THEN 'P.S.INJ' ELSE '' END AS dose_form_code, CASE o_orderkey % 3 WHEN 0 THEN 'Solution for Injection' WHEN 1 THEN 'Powder for Solution for Injection' ELSE '' END AS dose_form_label,
 CASE WHEN o_custkey % 4 <> 0 THEN (o_custkey % 20 + 1) || '.5' ELSE '' END AS volume_ml, CASE o_orderkey % 4 WHEN 0 THEN 'Vial' WHEN 1 THEN 'PFS' WHEN 2 THEN 'Cartridge' ELSE '' END AS container FROM orders)"""
_NAME8 = "CASE p_partkey % 8 WHEN 0 THEN {} WHEN 1 THEN {} WHEN 2 THEN 'pH value' WHEN 3 THEN 'Purity by SEC' WHEN 4 THEN {} WHEN 5 THEN {} WHEN 6 THEN {} ELSE 'Rate [1/s]' END"
_TRIM_NUMBER = "regexp_replace(regexp_replace(CAST(CAST({} AS DECIMAL(24,6)) AS VARCHAR), '0+$', ''), '\\.$', '')"
ORACLE_SQL = {
    "component_classes": f"WITH {_SPLIT} SELECT root, name, kind, lot, batch_tail, component_ref FROM parts",
    "filtered_components": f"WITH {_COMPONENTS} SELECT root, ord, display_name, component_ref FROM comp WHERE component_ref IS NOT NULL OR regexp_matches(lower(display_name), 'vial|syringe|stopper|crimp|cap')",
    "packaging_slots": f"WITH {_SPLIT}, {_SLOTS} SELECT * FROM slots",
    "composition_rows": f"WITH {_COMPOSED} SELECT * FROM composed",
    "composition_narrative": f"WITH {_COMPOSED} SELECT root, string_agg(amount_per_unit || ' ' || component_name, ', ' ORDER BY ord) AS narrative FROM composed WHERE is_ingredient AND component_name NOT LIKE 'Water%' GROUP BY 1",
    "active_concentration": f"WITH {_COMPOSED} SELECT root, arg_min(amount_per_unit, ord) AS concentration FROM composed WHERE component_function = 'Active ingredient' GROUP BY 1",
    "report_counts": f"""WITH {_SPLIT}, {_COMPOSED.replace(_LINES + ', ', '')}, k AS (SELECT root, CASE WHEN is_ingredient THEN 'ingredient' ELSE 'other' END AS kind FROM composed UNION ALL SELECT root, kind FROM parts UNION ALL SELECT root, 'stage' FROM ln)
SELECT root, {', '.join(f"count(*) FILTER (WHERE kind = '{x}') AS n_{x}" for x in ('ingredient', 'other', 'substance', 'packaging', 'stage'))} FROM k GROUP BY 1""",
    "stage_operations": f"""WITH {_LINES} SELECT root, root || '-' || lpad(CAST(ord AS VARCHAR), 3, '0') AS stage_id, 'urn:op:' || (l_suppkey % 5) AS unit_operation_uri,
CASE WHEN l_partkey % 3 = 0 THEN 'Step ' || lpad(CAST(ord AS VARCHAR), 3, '0') ELSE CASE l_suppkey % 5 WHEN 0 THEN 'Mixing' WHEN 1 THEN 'Filling' WHEN 2 THEN 'Filtration' ELSE 'urn:op:' || (l_suppkey % 5) END END AS unit_operation, l_partkey % 3 = 0 OR l_suppkey % 5 < 3 AS confident, ord AS stage_index FROM ln""",
    "decoded_status": "SELECT o_orderkey, v AS region, CASE WHEN v = '' THEN '' ELSE coalesce(r_name, v) END AS region_label, v = '' OR r_name IS NOT NULL AS region_confident FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE CAST(o_custkey % 8 AS VARCHAR) END AS v FROM orders) LEFT JOIN region ON CAST(r_regionkey AS VARCHAR) = v",
    "material_properties": "SELECT p_partkey AS material_id, p_brand AS value FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "quality_standards": "SELECT o_orderkey AS ref_id, o_orderpriority AS quality_standard, p_name AS component_name FROM orders LEFT JOIN part ON p_partkey = o_custkey * 2 WHERE o_orderkey % 2 = 0 AND o_orderstatus <> 'P'",
    "picked_parameters": "SELECT p_partkey, p_brand AS parameter_ref FROM part WHERE p_brand IN ('Brand#11', 'Brand#23', 'Brand#5', 'Brand#1')",
    "last_values": f"WITH {_LINES} SELECT root, CASE WHEN l_partkey % 3 < 2 THEN 'density' ELSE 'ph' END AS name, CAST(arg_max(l_partkey, ord) AS VARCHAR) AS value FROM ln WHERE l_suppkey % 4 <> 0 GROUP BY 1, 2",
    "batches_with_data": "SELECT o_orderkey AS root, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49 OR l_returnflag = 'R' AND l_quantity < 3) AS has_data FROM orders",
    "bound_batches": """WITH b AS (SELECT 'BAX' || p_partkey AS short, 'BAX' || p_partkey || CASE WHEN p_size % 2 = 0 THEN '-01' ELSE '' END AS batch_id FROM part), r AS (SELECT 'BAX' || (s_suppkey + 1000) AS root FROM supplier)
SELECT root, batch_id, 'exact' AS how FROM b JOIN r ON short = root UNION ALL SELECT root, batch_id, 'prefix' FROM b JOIN r ON starts_with(batch_id, root)""",
    "batch_names": f"""WITH {_HEADER} SELECT root, dose_mg, dose_form_code, dose_form_label, volume_ml, container, concat_ws(' ', dose_mg || ' mg', nullif(dose_form_code, ''), CASE WHEN volume_ml <> '' THEN volume_ml || ' mL' END, CASE WHEN container <> '' THEN 'in ' || container END) AS title_line,
CASE WHEN volume_ml = '' THEN '' ELSE {_TRIM_NUMBER.format('(o_custkey % 400 + 1) * (o_custkey % 20 + 1.5)')} || ' mg' END AS amount FROM hd""",
    "backfilled_headers": f"""WITH {_SPLIT}, {_COMPOSED.replace(_LINES + ', ', '')}, {_HEADER}, f AS (SELECT root, arg_min(amount_per_unit, ord) AS amount FROM composed WHERE component_function = 'Active ingredient' GROUP BY 1),
a AS (SELECT root, replace(amount, ' mg', '') AS active FROM f WHERE root % 3 > 0), n AS (SELECT root, lower(string_agg(name, ' ')) AS names FROM parts GROUP BY 1),
j AS (SELECT hd.*, active, names, CASE WHEN o_custkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) END AS given FROM hd LEFT JOIN a ON a.root = hd.root LEFT JOIN n ON n.root = hd.root),
k AS (SELECT *, CASE WHEN root % 4 <> 0 AND dose_form_code <> '' THEN dose_form_code WHEN o_custkey % 4 = 0 THEN 'S.INJ' WHEN o_custkey % 4 = 1 THEN 'P.S.INJ' WHEN active IS NOT NULL THEN 'S.INJ' END AS code FROM j)
SELECT root, coalesce(CASE WHEN root % 3 = 0 THEN given END, CASE WHEN root % 2 = 0 THEN dose_mg END, CASE WHEN o_custkey % 5 < 2 THEN (o_custkey % 90) || '.5' END, active) AS dose_mg, code AS dose_form_code,
CASE code WHEN 'S.INJ' THEN 'Solution for Injection' WHEN 'P.S.INJ' THEN 'Powder for Solution for Injection' END AS dose_form_label,
coalesce(CASE WHEN root % 3 = 1 THEN given END, CASE WHEN root % 5 <> 0 THEN nullif(volume_ml, '') END, CASE WHEN root % 3 = 2 THEN given END) AS volume_ml,
CASE WHEN root % 4 <> 0 AND container <> '' THEN container WHEN o_custkey % 6 = 0 THEN 'Vial' WHEN o_custkey % 6 = 1 THEN 'PFS' WHEN names LIKE '%syringe%' THEN 'Syringe' WHEN names LIKE '%vial%' THEN 'Vial' END AS container FROM k""",
    "general_info": f"""WITH {_HEADER}, p AS (SELECT unnest(range(5)) AS ord, unnest(['Batch size', 'Dosage form', 'Strength', 'Container', 'Manufacturer']) AS parameter)
SELECT root, CAST(ord AS INTEGER) AS ord, parameter, CASE ord WHEN 0 THEN CASE WHEN root % 3 = 0 THEN '—' ELSE CAST(root % 50 AS VARCHAR) END WHEN 1 THEN coalesce(nullif(dose_form_label, ''), nullif(dose_form_code, ''), '—') WHEN 2 THEN dose_mg WHEN 3 THEN CASE WHEN root % 6 = 0 THEN 'Bag' ELSE coalesce(nullif(container, ''), '—') END ELSE '—' END AS value FROM hd, p""",
    "batch_flags": """WITH o AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'BAX' ELSE 'BA' END || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS root, * FROM orders), f AS (
SELECT root, 1 AS rule_no, 'general_info' AS area, 'batch_size unit not decoded: urn:unit:9' AS message FROM o WHERE o_custkey % 4 <> 0 AND o_orderkey % 2 <> 0 UNION ALL SELECT root, 3, 'general_info', 'density unit not decoded: urn:unit:9' FROM o WHERE o_custkey % 5 = 0 AND o_orderkey % 2 <> 0
UNION ALL SELECT root, 4, 'stages', 'operation not decoded: urn:op:7' FROM o WHERE o_custkey % 2 <> 0 UNION ALL SELECT root, 8, 'stages', 'amount unit not decoded: urn:unit:9' FROM o WHERE o_custkey % 3 > 0 AND o_orderkey % 2 <> 0 UNION ALL SELECT root, 5, 'composition', 'no composition' FROM o WHERE o_orderstatus = 'P'
UNION ALL SELECT root, 6, 'components', 'no drug-substance lot' FROM o WHERE o_orderpriority IN ('1-URGENT', '5-LOW') UNION ALL SELECT root, 7, 'general_info', 'manual registration' FROM o WHERE o_orderkey % 3 <> 0) SELECT root, rule_no, CASE WHEN rule_no IN (5, 6, 7) THEN 'info' ELSE 'warn' END AS severity, area, message FROM f""",
    "bound_requests": f"WITH {V.SQL['results']} SELECT request_id, list(DISTINCT sample_id ORDER BY sample_id) AS samples FROM results WHERE request_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1",
    "measured_names": "SELECT p_partkey, CASE p_partkey % 6 WHEN 3 THEN 'Density' WHEN 5 THEN 'Purity' END AS result_name FROM part WHERE p_partkey % 6 >= 3",
    "requests_with_data": "SELECT o_orderkey AS request_id, CASE WHEN o_orderstatus <> 'F' AND o_custkey % 4 < 3 THEN o_custkey % 4 = 2 ELSE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30) END AS has_data FROM orders",
    "stability_rows": f"""WITH {V.SQL['results']} SELECT request_id, experiment_id, sample_id, result_name, reported_value,
CAST(row_number() OVER (PARTITION BY request_id ORDER BY technique, batch_id, sample_name, particle_size NULLS LAST, result_name, reported_value, value_source, experiment_id, sample_id, detail_context) AS INTEGER) AS report_no,
CAST(row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN timepoint LIKE 'Day%' THEN 0 ELSE 1 END, CAST(regexp_extract(timepoint, '[0-9]+') AS INTEGER), CASE storage WHEN '5C' THEN 0 WHEN '25C' THEN 1 ELSE 9 END, sample_name, technique, batch_id, particle_size NULLS LAST, result_name, reported_value, value_source, experiment_id, sample_id, detail_context) AS INTEGER) AS stability_no FROM rows_""",
    "parameter_labels": f"""WITH n AS (SELECT p_partkey, {_NAME8.format("'Trübung'", "'TrÃ¼bung'", "'Sichtbare Partikel'", "'Gehalt_a'", "'Dichte'")} AS raw, {_NAME8.format("'Trübung'", "'Trübung'", "'Sichtbare Partikel'", "'Gehalt_a'", "'Dichte'")} AS repaired, {_NAME8.format("'Turbidity'", "'Turbidity'", "'Visible Particles'", "'Content_a'", "'Density'")} AS translated FROM part),
s AS (SELECT *, CASE WHEN p_partkey % 8 = 2 THEN 'value' WHEN p_partkey % 16 = 3 THEN 'by SEC' ELSE translated END AS label FROM n), a AS (SELECT *, label || CASE WHEN p_partkey % 5 = 0 THEN ' — Monomer' ELSE '' END AS named FROM s)
SELECT p_partkey, CASE WHEN p_partkey % 8 = 1 AND p_partkey % 5 = 0 THEN raw || ' — Monomer' ELSE named END || CASE WHEN p_partkey % 3 = 0 AND p_partkey % 8 <> 7 THEN ' [mg]' ELSE '' END AS label, translated, repaired FROM a""",
    "resolved_techniques": """WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Sub-Visible Particles - MFI' WHEN 1 THEN CASE p_partkey % 3 WHEN 0 THEN 'pH' WHEN 1 THEN 'Clarity and Opalescence' ELSE 'Compendial' END WHEN 2 THEN 'Polysorbate 20' ELSE 'Coloration' END AS technique, p_partkey % 4 <> 1 OR p_partkey % 3 < 2 AS confident, lpad(CAST(p_partkey AS VARCHAR), 5, '0') AS n FROM part)
SELECT p_partkey, technique, confident, CASE p_partkey % 3 WHEN 0 THEN 'BAX' || n WHEN 1 THEN 'BA' || n END AS short, CASE p_partkey % 3 WHEN 0 THEN 'reg-BAX' || n WHEN 1 THEN 'BA' || n END AS query, CASE p_partkey % 3 WHEN 0 THEN 'nest' WHEN 1 THEN 'manual' END AS registration, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE '' END AS experiment FROM t""",
    "file_names": """WITH b AS (SELECT o_orderkey AS k, o_orderkey * o_orderkey * 37 AS n FROM orders)
SELECT k AS o_orderkey, 'root/' || k || CASE WHEN k % 2 = 0 THEN '/drafts/' ELSE '/output/' END || 'My  report: ' || k || '?.pdf' AS key, 'arch/re-port/' || CASE WHEN k % 3 <> 0 THEN 'A-' || (k % 5) ELSE 'unknown' END || '/' || k || '_v-1.pdf' AS archive,
'dir_My_report__' || k || '_.pdf' AS safe, substring('dir_My_report__' || k || '_.pdf', 1, 12) AS stem, 'ab' || chr(9) || 'c' || k AS printable, CASE WHEN k % 3 = 0 THEN 'Meta' ELSE 'stem' || k || '.v1' END AS title,
CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', round(n / 1024.0, 1)) WHEN n < 1073741824 THEN printf('%.1f MB', round(n / 1048576.0, 1)) ELSE printf('%.1f GB', round(n / 1073741824.0, 1)) END AS size,
CASE WHEN k % 2 = 0 THEN 'Given' ELSE 'Ada' END AS given, 'Some key part ' || k AS human, CASE WHEN length(repeat(CAST(k AS VARCHAR), 3)) > 9 THEN substring(repeat(CAST(k AS VARCHAR), 3), 1, 9) || '...' ELSE repeat(CAST(k AS VARCHAR), 3) END AS capped, CAST(greatest(0, least(100, k % 300 - 100)) AS BIGINT) AS progress FROM b""",
}
