"""Queries of the analytical and manufacturing reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.functions import ids
from parchment.operators import batches as B
from parchment.operators import compare as C
from parchment.operators import results as R
from parchment.operators.helpers import nulls_last

from . import views as V

ORDER = ["technique", "batch_id", "sample_name", "particle_size", "result_name", "reported_value", "value_source", "experiment_id", "sample_id"]
_CELL = "request_id, batch_id, sample_name, regexp_replace(lower(technique), '[^a-z0-9]', '', 'g') AS tech_key, CASE WHEN particle_size IS NOT NULL THEN '>=' || particle_size || ' um' ELSE result_name END AS leaf"
_PREFER = """kept AS (SELECT * FROM (SELECT *, max(CASE WHEN detail_context = 'per container' THEN 1 END) OVER (PARTITION BY request_id, batch_id, sample_name, technique, particle_size) AS other FROM rows_)
  WHERE NOT (detail_context = 'per volume' AND particle_size IS NOT NULL AND other IS NOT NULL))"""
_ORD = "technique, batch_id, sample_name, particle_size NULLS LAST, result_name, reported_value, value_source, experiment_id, sample_id"


def rows(spark: SparkSession, sf: str) -> DataFrame:
    return R.result_rows(V.results(spark, sf))


def result_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rows(spark, sf).drop("analyte_name")


def batch_matrix_cells(spark: SparkSession, sf: str) -> DataFrame:
    return R.matrix_cells(R.prefer_container(rows(spark, sf)), nulls_last(*ORDER))


def matrix_headers(spark: SparkSession, sf: str) -> DataFrame:
    return R.matrix_headers(rows(spark, sf), nulls_last(*ORDER))


def lead_columns(spark: SparkSession, sf: str) -> DataFrame:
    return R.lead_columns(rows(spark, sf))


def request_header(spark: SparkSession, sf: str) -> DataFrame:
    requests = V.t(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id"))
    results = V.results(spark, sf).select("request_id", F.col("batch_id").cast("string").alias("batch_id"), F.lit(None).cast("string").alias("batch_project"), F.col("technique").alias("request_project"))
    props = V.t(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("batch_id"), F.col("r_name").alias("project_name"))
    return R.request_header(requests, results, props)


def methods_rollup(spark: SparkSession, sf: str) -> DataFrame:
    m = V.t(spark, sf, "lineitem").join(V.t(spark, sf, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return R.methods_rollup(m.select(F.col("l_orderkey").alias("request_id"), F.concat(F.lit("E"), F.col("l_suppkey").cast("string")).alias("eln_id"), F.concat(F.lit("x-"), "p_brand").alias("test_description"), F.concat("p_type", F.lit(", V "), F.col("l_linenumber").cast("string")).alias("method_reference")))


def results_pivot_long(spark: SparkSession, sf: str) -> DataFrame:
    r = rows(spark, sf).select("request_id", "technique", F.col("result_name").alias("label"), "sample_id", F.col("reported_value").alias("value"))
    return R.results_pivot(r, F.col("value"))


def first_summary(spark: SparkSession, sf: str) -> DataFrame:
    o = V.t(spark, sf, "orders")
    return R.first_summary(o.select(F.col("o_custkey").alias("request_id"), F.col("o_orderkey").alias("summary_exp_id"), F.col("o_orderstatus").alias("scope"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("summary_conclusion")))


def validation_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.validation_counts(V.results(spark, sf))


def batch_lots(spark: SparkSession, sf: str) -> DataFrame:
    lots = V.t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("displayname"))
    return R.batch_lots(V.results(spark, sf), lots)


def result_flags(spark: SparkSession, sf: str) -> DataFrame:
    r = rows(spark, sf).withColumn("technique", F.when(F.col("technique").endswith("1"), "Compendial").otherwise(F.col("technique"))).withColumn("reported_value", F.when(F.col("value_source") == "reported", F.col("reported_value")))
    l = V.t(spark, sf, "lineitem").join(V.t(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))  # noqa: E741
    m = l.select(
        F.col("l_orderkey").alias("request_id"), F.concat(F.lit("E"), F.col("l_suppkey").cast("string"), F.when(F.col("l_returnflag") == "R", " attachment a01").otherwise("")).alias("eln_id"),
        F.concat(F.lit("who-17_"), F.when(F.col("l_linenumber") % 2 == 0, "Compendial").otherwise(F.col("p_brand"))).alias("test_description"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("DOC-17-A, V "), F.col("l_linenumber").cast("string"))).otherwise(F.when(F.col("l_quantity") < 25, "").otherwise("REF")).alias("method_reference"),
    )
    return R.result_flags(r, m, hints=(("DOC-17", "pH"),))


def batch_counts(spark: SparkSession, sf: str) -> DataFrame:
    l = V.t(spark, sf, "lineitem")  # noqa: E741
    return B.batch_counts(
        lines=l.select(F.col("l_orderkey").alias("root")), returned=l.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("root")), headers=V.t(spark, sf, "orders").select(F.col("o_orderkey").alias("root")),
        open_lines=l.filter("l_linestatus = 'O'").select(F.col("l_orderkey").alias("root")),
    )


def resolve_components(spark: SparkSession, sf: str) -> DataFrame:
    c = V.t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("root"), F.concat(F.lit("urn:batch:"), F.col("l_partkey").cast("string")).alias("component_ref")).distinct()
    lots = V.t(spark, sf, "part").filter("p_size > 10").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("displayname"))
    return B.resolve_components(c, lots)


def composition_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    c = V.t(spark, sf, "lineitem").join(V.t(spark, sf, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    c = c.select(F.col("l_orderkey").alias("root"), F.col("p_brand").alias("component_name"), F.col("p_type").alias("component_function"), F.col("l_linenumber").cast("string").alias("amount"), F.lit("http://qudt.org/vocab/unit/GM").alias("amount_unit"))
    out = B.composition_rows(c, ["component_name", "component_function", "amount"])
    return out.select("root", "component_name", "component_function", "amount_per_unit", "is_ingredient")


def material_props_first(spark: SparkSession, sf: str) -> DataFrame:
    s = V.stages(spark, sf)
    return B.first_parameters(s.select("root", "ord", F.concat(F.lit("urn:x:"), F.coalesce(F.nullif("dose_form", F.lit("")), F.lit("none"))).alias("parameter_ref"), F.col("density").alias("value"), F.lit("g").alias("unit")))


def stage_labels(spark: SparkSession, sf: str) -> DataFrame:
    s = V.t(spark, sf, "lineitem").select(F.concat(F.col("l_orderkey").cast("string"), F.lit("-0"), F.col("l_linenumber").cast("string")).alias("stage_id"), F.concat("l_returnflag", F.lit(" - step "), "l_linestatus").alias("stage"), F.col("l_shipdate").alias("ts"))
    return B.stage_labels(s)


def stage_yield(spark: SparkSession, sf: str) -> DataFrame:
    return B.stage_yield(V.stages(spark, sf))


def coalesce_siblings(spark: SparkSession, sf: str) -> DataFrame:
    return B.coalesce_siblings(V.stages(spark, sf), "root", ["start_time", "density", "dose_form"], ["ord"])


def _batch_ids(spark: SparkSession, sf: str) -> DataFrame:
    return V.t(spark, sf, "part").select(F.concat(F.lit("reg-BAX"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit("-01")).alias("batch_id"))


def list_ids(spark: SparkSession, sf: str) -> DataFrame:
    return B.list_ids(_batch_ids(spark, sf))


def suggest_ids(spark: SparkSession, sf: str) -> DataFrame:
    return B.suggest_ids(_batch_ids(spark, sf), "ax0001")


def id_exists(spark: SparkSession, sf: str) -> DataFrame:
    wanted = V.t(spark, sf, "supplier").select(F.concat(F.lit("bax"), F.lpad((F.col("s_suppkey") * 30).cast("string"), 6, "0")).alias("id"))
    return B.id_exists(wanted, _batch_ids(spark, sf))


def resolve_root(spark: SparkSession, sf: str) -> DataFrame:
    wanted = V.t(spark, sf, "supplier").select(F.concat(F.lit("BAX"), F.lpad((F.col("s_suppkey") * 30).cast("string"), 6, "0")).alias("id"))
    return B.resolve_root(wanted, _batch_ids(spark, sf))


def row_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.row_counts({n: V.t(spark, sf, n) for n in ("orders", "lineitem", "part", "supplier", "documents", "pages")})


def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return C.content_hash(V.t(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "request_id"), ["request_id"])


def request_ids(spark: SparkSession, sf: str) -> DataFrame:
    o = V.t(spark, sf, "orders").select(F.concat(F.lit("REQ-"), F.col("o_orderkey").cast("string")).alias("request_id"))
    return R.request_picker(o, "REQ-")


def method_versions(spark: SparkSession, sf: str) -> DataFrame:
    """H4, H7, H8, H12, H16 over every part."""
    from parchment.functions import clean

    p = V.t(spark, sf, "part")
    return p.select(
        "p_partkey", clean.strip_version(F.concat("p_type", F.lit(" v"), F.col("p_size").cast("string"))).alias("method"), ids.last_segment(F.concat("p_brand", F.lit("_"), "p_type")).alias("segment"),
        ids.batch_label(F.col("p_brand"), F.col("p_partkey").cast("string")).alias("label"), clean.round_value((F.col("p_retailprice").cast("decimal(18,2)") / 7).cast("decimal(18,4)").cast("string")).alias("rounded"),
    )


_NAMES = (
    result_rows, batch_matrix_cells, matrix_headers, lead_columns, request_header, methods_rollup, results_pivot_long, first_summary, validation_counts, batch_lots, result_flags, batch_counts, resolve_components,
    composition_dedupe, material_props_first, stage_labels, stage_yield, coalesce_siblings, list_ids, suggest_ids, id_exists, resolve_root, row_counts, content_hash, request_ids, method_versions,
)
QUERIES = {f.__name__: f for f in _NAMES}

_R, _S = V.SQL["results"], V.SQL["stages"]
_IDS = "ids AS (SELECT 'reg-BAX' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '-01' AS batch_id FROM part), wanted AS (SELECT 'BAX' || lpad(CAST(s_suppkey * 30 AS VARCHAR), 6, '0') AS id FROM supplier)"
ORACLE_SQL = {
    "result_rows": f"WITH {_R} SELECT * FROM rows_",
    "batch_matrix_cells": f"""WITH {_R}, {_PREFER}, c AS (SELECT {_CELL}, reported_value AS value, value_source = 'actual' AS actual, row_number() OVER (PARTITION BY request_id, batch_id ORDER BY {_ORD}) AS ord FROM kept),
v AS (SELECT request_id, batch_id, sample_name, tech_key, leaf, value, min(ord) AS ord, bool_or(actual) AS actual FROM c GROUP BY ALL)
SELECT request_id, batch_id, sample_name, tech_key, leaf, string_agg(value, ' / ' ORDER BY ord) AS value, bool_or(actual) AS is_actual FROM v GROUP BY ALL""",
    "matrix_headers": f"""WITH {_R}, l AS (SELECT DISTINCT request_id, batch_id, regexp_replace(lower(technique), '[^a-z0-9]', '', 'g') AS tech_key, technique, CASE WHEN particle_size IS NOT NULL THEN '>=' || particle_size || ' um' ELSE result_name END AS leaf, particle_size FROM rows_)
SELECT request_id, batch_id, tech_key, technique, leaf, 'NTU' AS unit, count(*) OVER (PARTITION BY request_id, batch_id, tech_key) AS group_span, dense_rank() OVER (PARTITION BY request_id, batch_id ORDER BY lower(technique), tech_key) AS group_no,
row_number() OVER (PARTITION BY request_id, batch_id, tech_key ORDER BY particle_size IS NULL, coalesce(particle_size, 0), lower(leaf)) AS leaf_no FROM l""",
    "lead_columns": f"WITH {_R} SELECT request_id, bool_or(timepoint IS NOT NULL) AS has_timepoint, bool_or(storage IS NOT NULL) AS has_storage, bool_or(timepoint IS NOT NULL) AS is_stability FROM rows_ GROUP BY 1",
    "request_header": f"""WITH {_R} SELECT request_id, coalesce(max(r_name), max(technique)) AS project_code, string_agg(DISTINCT CAST(batch_id AS VARCHAR), ', ' ORDER BY CAST(batch_id AS VARCHAR)) AS batch_ids
FROM results JOIN orders ON o_orderkey = request_id LEFT JOIN region ON CAST(r_regionkey AS VARCHAR) = CAST(batch_id AS VARCHAR) GROUP BY 1""",
    "methods_rollup": """WITH m AS (SELECT l_orderkey AS request_id, 'E' || l_suppkey AS eln, p_brand AS technique, p_type AS method_reference FROM lineitem JOIN part ON l_partkey = p_partkey),
d AS (SELECT DISTINCT * FROM m), g AS (SELECT request_id, technique, method_reference, string_agg(eln, ', ' ORDER BY length(eln), eln) AS eln_ids, min(eln) AS f FROM d GROUP BY 1, 2, 3)
SELECT request_id, technique, method_reference, eln_ids, true AS confident, '3.' || row_number() OVER (PARTITION BY request_id ORDER BY f, technique, method_reference) AS number FROM g""",
    "results_pivot_long": f"""WITH {_R}, c AS (SELECT request_id, technique, result_name AS label, sample_id, max(reported_value) AS value FROM rows_ GROUP BY 1, 2, 3, 4),
l AS (SELECT DISTINCT request_id, technique, result_name AS label FROM rows_), s AS (SELECT DISTINCT request_id, sample_id FROM rows_)
SELECT request_id, technique, label, sample_id, coalesce(value, 'N/A') AS value FROM l JOIN s USING (request_id) LEFT JOIN c USING (request_id, technique, label, sample_id)""",
    "first_summary": """SELECT request_id, summary_exp_id, scope, summary_conclusion FROM (SELECT o_custkey AS request_id, o_orderkey AS summary_exp_id, o_orderstatus AS scope, o_orderpriority AS summary_conclusion,
row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_orderstatus, o_orderpriority) AS k FROM orders WHERE o_orderstatus <> 'P') WHERE k = 1""",
    "validation_counts": f"WITH {_R} SELECT request_id, count(*) AS result_rows, count(DISTINCT experiment_id) AS n_experiments, count(DISTINCT sample_id) AS n_samples, count(DISTINCT batch_id) AS n_batches FROM results GROUP BY 1",
    "batch_lots": f"WITH {_R}, d AS (SELECT DISTINCT request_id, batch_id FROM results) SELECT request_id, batch_id, p_name AS lot_display FROM d LEFT JOIN part ON p_partkey = batch_id",
    "result_flags": f"""WITH {_R}, r AS (SELECT request_id, CASE WHEN technique LIKE '%1' THEN 'Compendial' ELSE technique END AS technique, result_name, units, sample_id, CASE WHEN value_source = 'reported' THEN reported_value END AS v FROM rows_),
m AS (SELECT DISTINCT l_orderkey AS request_id, 'E' || l_suppkey || CASE WHEN l_returnflag = 'R' THEN ' attachment a01' ELSE '' END AS eln, CASE WHEN l_linenumber % 2 <> 0 THEN p_brand WHEN l_linestatus = 'F' THEN 'pH' ELSE 'Compendial' END AS technique,
 CASE WHEN l_linestatus = 'F' THEN 'DOC-17-A' WHEN l_quantity < 25 THEN '' ELSE 'REF' END AS ref FROM lineitem JOIN part ON p_partkey = l_partkey),
g AS (SELECT request_id, technique, ref, string_agg(eln, ', ' ORDER BY length(eln), eln) AS elns, min(eln) AS first_eln FROM m GROUP BY 1, 2, 3),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY first_eln, technique, ref) AS INTEGER) AS method_no, technique || ' (' || elns || ')' AS named FROM g),
f AS (SELECT request_id, 1 AS rule_no, method_no, 'warn' AS severity, 'methods' AS area, 'method reference missing for ' || named AS message FROM n WHERE ref = ''
UNION ALL SELECT request_id, 2, method_no, 'warn', 'methods', 'ambiguous technique: ' || named FROM n WHERE technique = 'Compendial'
UNION ALL SELECT request_id, 5, method_no, 'info', 'methods', 'third-party result: ' || named FROM n WHERE elns LIKE '%attachment a01%'
UNION ALL SELECT DISTINCT request_id, 3, NULL, 'warn', 'results', 'value missing: ' || technique || ' / ' || result_name || coalesce(' [' || units || ']', '') || ' / ' || sample_id FROM r WHERE v IS NULL
UNION ALL SELECT DISTINCT request_id, 4, NULL, 'warn', 'results', 'ambiguous technique: Compendial' FROM r WHERE technique = 'Compendial')
SELECT * FROM f""",
    "batch_counts": """WITH k AS (SELECT l_orderkey AS root, 1 AS a, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS b, 0 AS c, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS d FROM lineitem UNION ALL SELECT o_orderkey, 0, 0, 1, 0 FROM orders)
SELECT root, CAST(sum(a) AS BIGINT) AS n_lines, CAST(sum(b) AS BIGINT) AS n_returned, CAST(sum(c) AS BIGINT) AS n_headers, CAST(sum(d) AS BIGINT) AS n_open_lines FROM k GROUP BY 1""",
    "resolve_components": "WITH c AS (SELECT DISTINCT l_orderkey AS root, l_partkey FROM lineitem) SELECT root, 'urn:batch:' || l_partkey AS component_ref, p_name AS resolved_name FROM c LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = l_partkey",
    "composition_dedupe": "SELECT DISTINCT l_orderkey AS root, p_brand AS component_name, p_type AS component_function, l_linenumber || ' g' AS amount_per_unit, true AS is_ingredient FROM lineitem JOIN part ON l_partkey = p_partkey",
    "material_props_first": f"WITH {_S} SELECT root, coalesce(nullif(dose_form, ''), 'none') AS parameter, arg_min(density, ord) AS value, 'g' AS unit FROM stages WHERE density IS NOT NULL GROUP BY 1, 2",
    "stage_labels": "SELECT CAST(l_orderkey AS VARCHAR) AS stage_id, min(l_returnflag) AS label, min(l_shipdate) AS first_ts FROM lineitem WHERE l_linenumber < 10 GROUP BY 1 UNION ALL SELECT l_orderkey || '-0' || l_linenumber, min(l_returnflag), min(l_shipdate) FROM lineitem WHERE l_linenumber >= 10 GROUP BY 1",
    "stage_yield": f"WITH {_S}, y AS (SELECT root, arg_min(amount, ord) AS a, arg_max(amount, ord) AS l FROM stages GROUP BY 1) SELECT root, CASE WHEN a > 0 AND l <> 0 THEN CAST(round(CAST(l AS DECIMAL(18,4)) * 100 / a, 1) AS DECIMAL(18,1)) END AS yield_percent FROM y",
    "coalesce_siblings": f"""WITH {_S}, b AS (SELECT root, arg_min(ord, CASE WHEN start_time IS NOT NULL THEN 0 ELSE 1000000 END + ord) AS o FROM stages GROUP BY 1),
f AS (SELECT root, min(CASE WHEN start_time IS NOT NULL THEN ord END) AS s, min(CASE WHEN density IS NOT NULL THEN ord END) AS d, min(CASE WHEN dose_form <> '' THEN ord END) AS p FROM stages GROUP BY 1)
SELECT f.root, coalesce(x.start_time, s1.start_time) AS start_time, coalesce(x.density, d1.density) AS density, coalesce(nullif(x.dose_form, ''), p1.dose_form) AS dose_form FROM f JOIN b ON b.root = f.root
JOIN stages x ON x.root = f.root AND x.ord = b.o LEFT JOIN stages s1 ON s1.root = f.root AND s1.ord = f.s LEFT JOIN stages d1 ON d1.root = f.root AND d1.ord = f.d LEFT JOIN stages p1 ON p1.root = f.root AND p1.ord = f.p""",
    "list_ids": f"WITH {_IDS} SELECT DISTINCT regexp_extract(batch_id, 'BA[A-Z]?[0-9]+') AS id FROM ids ORDER BY 1 DESC LIMIT 200",
    "suggest_ids": f"WITH {_IDS} SELECT DISTINCT regexp_extract(batch_id, 'BA[A-Z]?[0-9]+') AS id FROM ids WHERE upper(batch_id) LIKE '%AX0001%' ORDER BY 1 LIMIT 25",
    "id_exists": f"WITH {_IDS} SELECT lower(w.id) AS id, bool_or(i.batch_id IS NOT NULL) AS found FROM wanted w LEFT JOIN ids i ON contains(i.batch_id, w.id) GROUP BY 1",
    "resolve_root": f"WITH {_IDS} SELECT w.id, coalesce('reg-' || min(CASE WHEN i.batch_id IS NOT NULL THEN w.id END), w.id) AS root FROM wanted w LEFT JOIN ids i ON contains(i.batch_id, w.id) GROUP BY w.id",
    "row_counts": " UNION ALL ".join(f"SELECT '{n}' AS relation, count(*) AS n FROM {n}" for n in ("orders", "lineitem", "part", "supplier", "documents", "pages")),
    "request_ids": "SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS short, 'REQ-' || o_orderkey AS display, 'REQ-' || o_orderkey AS query FROM (SELECT regexp_extract(CAST(o_orderkey AS VARCHAR), '[0-9]{3,}') AS o_orderkey FROM orders) WHERE o_orderkey <> ''",
    "method_versions": "SELECT p_partkey, p_type AS method, p_type AS segment, CASE WHEN p_partkey >= 10000 THEN p_partkey || ' (' || p_brand || ')' ELSE p_brand END AS label, regexp_replace(regexp_replace(CAST(CAST(round(CAST(CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DECIMAL(28,12)) / 7 AS DECIMAL(18,4)), 2) AS DECIMAL(18,2)) AS VARCHAR), '0+$', ''), '\\.$', '') AS rounded FROM part",
}
