"""Cases whose results are known from outside: many small documents at once, a row or an outline each."""

import pytest
from pyspark.sql import functions as F

from parchment.functions import clean
from parchment.functions import text as T
from parchment.operators import batches as B
from parchment.operators import jobs as J
from parchment.operators import layout as L
from parchment.operators import outline as O
from parchment.operators import records
from parchment.operators import results as R

OUTLINE = "doc_id string, ord int, level int, title string, page int"


def outlines(spark, cases: dict):
    """One document a case; its entries are (title, page)."""
    return spark.createDataFrame([(name, k, 1, title, page) for name, entries in cases.items() for k, (title, page) in enumerate(entries)], OUTLINE)


# Outlines and what is left of them.
OUTLINES = {
    "doubled": ([("1 Scope", 3), ("2 Normative references", 4), ("1 Scope", 40), ("2 Normative references", 41)], [("1 Scope", 40), ("2 Normative references", 41)]),
    "noise": ([("Annex A (informative)", 30), ("Annex A  (informative)", 60), ("1 Scope", 3)], [("1 Scope", 3), ("Annex A (informative)", 60)]),
    "renamed": ([("4.3 Minimum creepage distances", 20), ("4.3 Not used", 55), ("1 Scope", 3)], [("1 Scope", 3), ("4.3 Minimum creepage distances", 55)]),
    "table": ([("1 Scope", 3), ("Table 11 - Minimum creepage distances", 20), ("Table 11 - Not used", 55), ("2 Normative references", 60)], [("1 Scope", 3), ("2 Normative references", 60)]),
    "left behind": ([("Redline version marker", 5), ("1 Scope", 100), ("2 Normative references", 101)], [("1 Scope", 100), ("2 Normative references", 101)]),
    "clean": ([("1 Scope", 3), ("2 Normative references", 4), ("4.1 Materials", 5)], [("1 Scope", 3), ("2 Normative references", 4), ("4.1 Materials", 5)]),
    **{word: ([("1 Scope", 3), (word, 4), ("2 Normative references", 5)], [("1 Scope", 3), ("2 Normative references", 5)]) for word in ("Figures", "Tables", "Bibliography", "INDEX", "Contents")},
}


def test_outlines_without_repeats(spark):
    left = {name: [] for name in OUTLINES}
    for r in O.dedupe_outline(outlines(spark, {name: given for name, (given, _) in OUTLINES.items()})).orderBy("page", "ord").collect():
        left[r.doc_id].append((r.title, r.page))
    assert left == {name: wanted for name, (_, wanted) in OUTLINES.items()}


def test_plausible_outlines(spark):
    cases = {
        "two": ["1 Scope", "2 Refs"],
        "three": ["1 Scope", "2 Refs", "3 Terms"],
        "annexes": ["Annex A", "Annex B", "Annex C"],
        "gap": ["1 Scope", "2 Refs", "40 Nope"],
        "orphans": [f"{n}.1.1 Orphan" for n in range(1, 20)],
    }
    out = O.hierarchy_valid(outlines(spark, {name: [(t, 1) for t in titles] for name, titles in cases.items()}))
    assert {r.doc_id: r.valid for r in out.collect()} == {"two": False, "three": True, "annexes": True, "gap": False, "orphans": False}


def test_contents_of_documents(spark):
    """Only contents pages yield entries, a running header before a number goes, and pages follow from where titles stand."""
    dots = " ......................................... "
    pages = [
        ("a", 0, "INTERNATIONAL STANDARD\nISO 99999-1:2026"),
        ("a", 1, f"Contents\n1 Scope{dots}3\n2 Normative references{dots}3\n4.1 Materials{dots}5\n"),
        ("a", 2, "1 Scope\nThis document specifies requirements."),
        ("a", 3, "4.1 Materials\nThe materials shall be inert."),
        ("b", 0, f"Contents\nISO 11608-4:2022(E) 8.10.6 NIS-E requirements{dots}12\n9 Marking{dots}15\n"),
        ("b", 1, "body"),
        ("c", 0, "Just some body prose with no contents page at all."),
    ]
    p = spark.createDataFrame(pages, "doc_id string, page_idx int, text string")
    entries = O.contents_entries(p).withColumn("ord", F.col("line_no"))
    assert [(r.doc_id, r.title, r.printed_page) for r in entries.orderBy("doc_id", "ord").collect()] == [
        ("a", "1 Scope", 3), ("a", "2 Normative references", 3), ("a", "4.1 Materials", 5), ("b", "8.10.6 NIS-E requirements", 12), ("b", "9 Marking", 15),
    ]
    found = O.title_to_page(entries, p, O.contents_pages(p))
    placed = entries.drop("page_idx").join(found.select("doc_id", "ord", "page_idx"), ["doc_id", "ord"], "left")
    n_pages = p.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    out = O.monotone_pages(placed, O.median_offset(placed), n_pages)
    assert [(r.title, r.page) for r in out.filter("doc_id = 'a'").orderBy("ord").collect()] == [("1 Scope", 3), ("2 Normative references", 3), ("4.1 Materials", 4)]


def test_best_boxes(spark):
    box = "doc_id int, page_idx int, id int, x0 double, y0 double, x1 double, y1 double"
    scaled = lambda doc, id, x0, y0, x1, y1: (doc, 0, id, x0 * 595, y0 * 842, x1 * 595, y1 * 842)
    model = [scaled(1, 1, 0.11, 0.31, 0.59, 0.49), scaled(2, 1, 0.01, 0.01, 0.05, 0.05), scaled(3, 1, 0.1, 0.1, 0.5, 0.5), scaled(4, 1, 0.5, 0.5, 0.5, 0.5)]
    found = [scaled(1, 7, 0.80, 0.80, 0.95, 0.95), scaled(1, 8, 0.10, 0.30, 0.60, 0.50), scaled(2, 7, 0.80, 0.80, 0.95, 0.95), scaled(4, 7, 0.1, 0.1, 0.9, 0.9)]
    out = L.best_box_match(spark.createDataFrame(model, box), spark.createDataFrame(found, box))
    assert {r.doc_id: r.match for r in out.collect()} == {1: 8, 2: None, 3: None, 4: None}


def test_replies(spark):
    replies = {
        '{"purpose": "x"}': ('{"purpose":"x"}', False),
        '```json\n{"purpose": "x"}\n```': ('{"purpose":"x"}', False),
        '```\n{"purpose": "x"}\n```': ('{"purpose":"x"}', False),
        'Here you go: {"purpose": "x"} — hope that helps': ('{"purpose":"x"}', True),
        "[1, 2]": ("[1,2]", False),
        '{"a": "unterminat': (None, True),
        "   ": (None, True),
    }
    out = J.parse_replies(spark.createDataFrame([(r,) for r in replies], "reply string")).collect()
    assert {r.reply: (None if r.reason else r.value, r.truncated) for r in out} == replies


def test_phases(spark):
    phases = {'{"equipment": ["a"], "software": ["b"]}': (["a"], ["b"]), '["a", "b"]': (["a", "b"], []), '"one step"': (["one step"], []), "null": ([], []), '{"equipment": "a"}': (["a"], [])}
    out = J.normalize_phases(spark.createDataFrame([(v,) for v in phases], "value string")).collect()
    assert {r.value: (r.equipment, r.software) for r in out} == phases


def test_troubleshooting(spark):
    rows = spark.createDataFrame([(1, '{"t": [{"issue": "i", "resolution": "r"}]}'), (2, '{"t": "not a list"}'), (3, None)], "run_id int, doc string")
    assert [(r.run_id, r.issue, r.resolution) for r in J.pair_lists(rows, "$.t", "issue", "resolution").collect()] == [(1, "i", "r")]


def test_amounts_a_unit(spark):
    cases = {("180 mg/mL", "2.00"): "360 mg", ("1.0 mg/mL", "2"): "2 mg", ("180 mg/mL", ""): "", ("", "2.00"): "", ("not numeric", "2.00"): "", ("180 mg/mL", "abc"): ""}
    out = spark.createDataFrame(list(cases), "c string, v string").withColumn("r", clean.mg_per_unit(F.col("c"), F.col("v"))).collect()
    assert {(r.c, r.v): r.r for r in out} == cases


@pytest.mark.parametrize("text, ratio", [(" ".join(["https://www.example.org/standard/1234.html"] * 20), 0.0), ("a<b c>d e=f", 0.0)])
def test_no_cipher(spark, text, ratio):
    assert spark.createDataFrame([(text,)], "x string").select(T.cipher_ratio(F.col("x")).alias("r")).first().r == ratio


@pytest.mark.parametrize("text", ["", "   ", "too short", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 %% ++ ==", " ".join(["qwrtpq", "zxcvbn", "plkjhg", "mnbvcx"] * 6)])
def test_unreadable(spark, text):
    assert spark.createDataFrame([(text,)], "x string").select(T.garble_check(F.col("x")).alias("r")).first().r is not None


HEADER = "root int, dose_mg string, dose_form_code string, dose_form_label string, volume_ml string, container string"


def test_blank_headers(spark):
    """Table values, then the first active ingredient, then names of components; stage amounts are no volumes; properties override."""
    headers = spark.createDataFrame([(k, None, None, None, "4" if k == 4 else None, None) for k in range(1, 7)], HEADER)
    info = spark.createDataFrame([(1, "180", "Solution", "6R Vial"), (4, "1 mg/mL", "Lyophilised powder", "pfs 1 mL")], "root int, dose_strength string, dose_form string, packaging_system string")
    made = spark.createDataFrame([(2, 1, "Excipient", "80 mg/mL"), (2, 2, "Active", "180 mg/mL"), (3, 1, "Active", "5 mg"), (3, 2, "Active", "7 mg/mL")], "root int, ord int, component_function string, amount_per_unit string")
    parts = spark.createDataFrame([(2, "Syringe, 1 mL"), (3, "Glass vial"), (3, "Rod for PFS"), (5, None)], "root int, name string")
    props = spark.createDataFrame([(1, "nominalVolume", "2.00"), (1, "fillVolume", "2.37"), (3, "fillVolume", "2.37"), (4, "fillVolume", "9"), (4, "unitStrength", "360"), (5, "nominalVolume", " ")], "root int, parameter string, value string")
    out = B.backfill_header(headers, made, parts, props, info)
    assert {r.root: tuple(r)[1:] for r in out.collect()} == {
        1: ("180", "S.INJ", "Solution for Injection", "2.00", "Vial"),
        2: ("180", "S.INJ", "Solution for Injection", None, "Syringe"),
        3: (None, None, None, "2.37", "PFS"),
        4: ("360", "P.S.INJ", "Powder for Solution for Injection", "4", "PFS"),
        5: (None,) * 5,
        6: (None,) * 5,
    }


def test_methods(spark):
    """Analyst and date before a technique go, references meet without their version, blank experiments aren't named."""
    rows = [
        (1, "EXP-2", "SoloVPE", "P-1 V1.0"), (1, "EXP-1", "SoloVPE", "P-1 V2.0"), (1, " ", "SoloVPE", "P-1"), (1, "EXP-3", "gosekmx_17Apr2026_VisibleParticles", "ARM-1"),
        (2, "EXP-1 Attachment A01", "MFI", None), (2, "EXP-2", "Compendial", "Q-1"), (2, None, "Compendial", "P-500488-E-B"),
    ]
    methods = spark.createDataFrame(rows, "request_id int, eln_id string, test_description string, method_reference string")
    hints = (("P-500488", "pH"),)
    out = R.methods_rollup(methods, hints).orderBy("request_id", "number").collect()
    assert [(r.request_id, r.technique, r.method_reference, r.eln_ids, r.confident) for r in out if r.request_id == 1] == [(1, "Protein content", "P-1", "EXP-1, EXP-2", True), (1, "VisibleParticles", "ARM-1", "EXP-3", True)]
    results = spark.createDataFrame([(2, "Compendial", "pH value", "-", None, "S1", None), (2, "Compendial", "something else", None, None, "S1", "1"), (2, "MFI", "count", None, None, "S2", " ")], "request_id int, technique string, result_name string, units string, analyte_name string, sample_id string, reported_value string")
    flags = R.result_flags(results, methods, hints=hints).filter("request_id = 2").collect()
    assert sorted((r.rule_no, r.severity, r.message) for r in flags) == [
        (1, "warn", "method reference missing for Sub-Visible Particles - MFI (EXP-1 Attachment A01)"),
        (2, "warn", "ambiguous technique: Compendial (EXP-2)"),
        (3, "warn", "value missing: Sub-Visible Particles - MFI / count / S2"),
        (3, "warn", "value missing: pH / value [-] / S1"),
        (4, "warn", "ambiguous technique: Compendial"),
        (5, "info", "third-party result: Sub-Visible Particles - MFI (EXP-1 Attachment A01)"),
    ]


def test_batches(spark):
    """What can't be decoded warns; what is absent informs."""
    info = spark.createDataFrame([("BA259821", "5", "urn:unit:nope"), ("BAX000584", None, "urn:unit:nope")], "root string, batch_size string, batch_size_unit string")
    info = info.selectExpr("*", *[f"string(null) as {c}" for c in ("dose_strength", "dose_strength_unit", "density", "density_unit")])
    stages = spark.createDataFrame([("BAX000584", "Filling", True, "500", "urn:unit:nope"), ("BAX000584", "Filling", True, None, "urn:unit:nope")], "root string, unit_operation string, confident boolean, amount string, amount_unit string")
    flags = B.batch_flags(info, spark.createDataFrame([("BA259821",)], "root string"), spark.createDataFrame([("BAX000584", "substance")], "root string, kind string"), stages)
    assert sorted((r.root, r.rule_no, r.severity) for r in flags.collect()) == [("BA259821", 1, "warn"), ("BA259821", 6, "info"), ("BA259821", 7, "info"), ("BAX000584", 5, "info"), ("BAX000584", 8, "warn")]


def test_restored_versions(spark):
    """History only grows, and restores of one section don't share a number."""
    versions = spark.createDataFrame([(1, "purpose", 1, "<p>Original</p>"), (1, "purpose", 2, "<p>Second</p>"), (1, "scope", 1, "<p>s</p>")], "run_id int, section_key string, version_num int, html string")
    wanted = spark.createDataFrame([(1, "purpose", 2, 1), (1, "purpose", 1, 2), (1, "purpose", 99, 3), (1, "scope", 1, 4)], "run_id int, section_key string, version_num int, at int")
    new, bad = records.restore_versions(versions, wanted, "at")
    assert sorted((r.section_key, r.version_num, r.html, r.label) for r in new.collect()) == [("purpose", 3, "<p>Second</p>", "Restored v2"), ("purpose", 4, "<p>Original</p>", "Restored v1"), ("scope", 2, "<p>s</p>", "Restored v1")]
    assert [(r.section_key, r.version_num) for r in bad.collect()] == [("purpose", 99)]
