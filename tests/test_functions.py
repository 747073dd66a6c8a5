"""Single rules on tiny frames."""

import pytest
from pyspark.sql import functions as F

from parchment.functions import clean, ids
from parchment.functions import text as T


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("given, wanted", [
    ("0.20", "0.20"), ("5.8", "5.8"), ("177.456", "177.46"), ("0.21345", "0.21"), ("3,111", "3.11"), (".85", "0.85"), ("-.5", "-0.5"), ("12", "12"), ("clear", "clear"), ("", ""), (None, ""), ("< 0.5", "< 0.5"), ("99.999", "100"), ("1,5", "1.5"), ("-0.001", "0"),
])
def test_round_value(spark, given, wanted):
    assert one(spark, clean.round_value(F.col("x")), x=given) == wanted


@pytest.mark.parametrize("given, wanted", [("P-500488-E-B V8.0", "P-500488-E-B"), ("ARM-19-01273, V 3.0", "ARM-19-01273"), ("A (v2)", "A"), ("plain", "plain"), (None, "")])
def test_strip_version(spark, given, wanted):
    assert one(spark, clean.strip_version(F.col("x")), x=given) == wanted


def test_ids(spark):
    assert one(spark, ids.request_id(F.col("x")), x="CMC-10352")["short"] == "10352"
    assert one(spark, ids.request_id(F.col("x")), x="none") is None
    assert tuple(one(spark, ids.batch_id(F.col("x"), "nest-"), x="bax000584")) == ("BAX000584", "nest-BAX000584", "nest")
    assert tuple(one(spark, ids.batch_id(F.col("x")), x="BA259821-08")) == ("BA259821", "BA259821", "manual")
    assert one(spark, ids.batch_label(F.col("b"), F.col("l")), b="B1", l="1001707466") == "1001707466 (B1)"
    assert one(spark, ids.safe_segment(F.col("x")), x=" a/b  c ") == "a-b-c"
    assert one(spark, ids.humanize_key(F.col("x")), x="some_KEY-part") == "Some KEY part"
    assert one(spark, ids.given_name(F.col("x")), x="Doe, Jane M") == "Jane"
    assert one(spark, ids.format_bytes(F.col("x")), x=1536) == "1.5 KB"


def test_terms_and_mojibake(spark):
    assert one(spark, clean.translate_terms(F.col("x")), x="Dichte_ViskositÃ¤t") == "Density_Viscosity"
    assert one(spark, clean.translate_terms(F.col("x")), x="Farbenlehre") == "Farbenlehre"
    assert one(spark, clean.fix_mojibake(F.col("x")), x="Ã alone €") == "Ã alone €"
    assert one(spark, clean.fix_mojibake(F.col("x")), x=None) is None


def test_techniques(spark):
    assert tuple(one(spark, clean.technique(F.col("h"), F.col("p")), h="Compendial", p="pH value")) == ("pH", True)
    assert tuple(one(spark, clean.technique(F.col("h"), F.col("p")), h="Compendial", p="other")) == ("Compendial", False)
    assert tuple(one(spark, clean.technique(F.col("h"), F.col("p")), h="MFI", p=None)) == ("Sub-Visible Particles - MFI", True)
    assert one(spark, clean.leaf_label(F.col("s"), F.col("a"), F.col("p")), s=10.0, a=None, p="x") == ">=10 um"
    assert one(spark, clean.parameter_label(F.col("t"), F.col("p"), F.col("u"), F.col("a")), t="pH", p="pH value", u="-", a="x") == "value — x [-]"


def test_batch_names(spark):
    parts = clean.batch_name_parts(F.col("x"))
    assert tuple(one(spark, parts, x="X-423 360 mg S.INJ 2 mL Vial")) == ("360", "S.INJ", "Solution for Injection", "2", "Vial")
    assert one(spark, clean.title_line(parts), x="X-423 360 mg S.INJ 2 mL Vial") == "360 mg S.INJ 2 mL in Vial"
    assert tuple(one(spark, parts, x=None)) == ("", "", "", "", "")
    assert one(spark, clean.mg_per_unit(F.col("c"), F.col("v")), c="180 mg/mL", v="2.00") == "360 mg"
    assert one(spark, clean.mg_per_unit(F.col("c"), F.col("v")), c="x", v="2") == ""
    assert tuple(one(spark, clean.amount_text(F.col("v"), F.col("u")), v="500", u="http://qudt.org/vocab/unit/MilliL")) == ("500 mL", True)
    assert one(spark, clean.component_class(F.col("n"), F.col("r"), "nest-"), n="Glass vial", r="nest-1") is None
    assert one(spark, clean.component_class(F.col("n"), F.col("r"), "nest-"), n="Glass vial", r="x") == "packaging"


CLEAN = "The requirements of this standard shall be used for each device and the test data are provided in the annex."


@pytest.mark.parametrize("text, check", [(CLEAN, None), ("short", "short"), (None, "short"), ("1 2 3 4 5 6 7 8 9 10 11 12 13 14", "letters"), ("zq xw " * 10, "words"), ("The of A>B C:D E<F to in " * 3, "pattern")])
def test_garble_check(spark, text, check):
    assert one(spark, T.garble_check(F.col("x")), x=text) == check


def test_cipher_ratio(spark):
    assert one(spark, T.cipher_ratio(F.col("x")), x=CLEAN) == 0.0
    assert one(spark, T.cipher_ratio(F.col("x")), x="H?=>JI of <KD9J?ED a b c d e f g h i") > 0.1
    assert one(spark, T.cipher_ratio(F.col("x")), x="H?=>JI") == 0.0


def test_blocks_and_captions(spark):
    blocks = one(spark, T.split_blocks(F.col("x")), x="one\ntwo\n\n three\nFigure 3 — cap\nmore\nTable 14\nrest\nTable 15 lists")
    assert blocks == ["one\ntwo", "three", "Figure 3 — cap\nmore", "Table 14\nrest\nTable 15 lists"]
    assert one(spark, T.figure_number(F.col("x")), x="Figure 3 - a") == "3" and one(spark, T.figure_number(F.col("x")), x="Figure 3 shows") is None
    assert one(spark, T.table_ref(F.col("x")), x="Table E.1 (continued)") == "E.1" and one(spark, T.table_ref(F.col("x")), x="Table 14 lists") is None
    assert one(spark, T.formula_number(F.col("x")), x="a = b (12)") == "12" and one(spark, T.formula_number(F.col("x")), x="see (12)") is None
    refs = one(spark, T.mentions(F.col("x")), x="see Figure 3, table a.1 and Formula (2); Figure 3")
    assert [tuple(r) for r in refs] == [("figure", "3"), ("table", "A.1"), ("formula", "2")]


def test_titles(spark):
    assert one(spark, T.structural_id(F.col("x")), x="Annex B (informative)") == "annex:b"
    assert one(spark, T.structural_id(F.col("x")), x="4.3.1 General") == "sec:4.3.1"
    assert one(spark, T.structural_id(F.col("x")), x="Table A.6 x") == "table:a.6"
    assert one(spark, T.normalized_title(F.col("x")), x=" Annex A (informative)General — ") == "annex a (informative) general"
    assert one(spark, T.contents_line(F.col("x")), x="4.1 General ........ 12").asDict() == {"number": "4.1", "level": 2, "title": "4.1 General", "printed_page": 12}
    assert one(spark, T.contents_line(F.col("x")), x="Foreword ........ iv")["printed_page"] == 0
    assert one(spark, T.contents_line(F.col("x")), x="no entry") is None
    assert one(spark, T.heading_number(F.col("x")), x="4 General requirements") == "4"
    for bad in ("901 N. Glebe Road", "4 lower case", "5.1 12.5", "4 Dots ........ 3", "ab"):
        assert one(spark, T.heading_number(F.col("x")), x=bad) is None


def test_metrics_and_cells(spark):
    assert tuple(one(spark, T.text_metrics(F.col("x")), x="One. Two! Three")) == (15, 3, 1)
    assert tuple(one(spark, T.text_metrics(F.col("x")), x="")) == (0, 0, 0)
    assert tuple(one(spark, T.text_metrics(F.col("x")), x="a|b|c"))[2] == 3
    cells = one(spark, T.cell_subblocks(F.col("x"), ["Purpose", "Scope"]), x="Purpose | a | b | Scope: | c")
    assert [tuple(c) for c in cells] == [("Purpose", "a\nb"), ("Scope", "c")]
