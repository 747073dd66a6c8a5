"""Cleaning of measured values, labels, units and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import blank_to_null, text_of

# Unit addresses of the public QUDT vocabulary. Others are given by the caller.
UNITS = {
    "http://qudt.org/vocab/unit/L": "L",
    "http://qudt.org/vocab/unit/MilliL": "mL",
    "http://qudt.org/vocab/unit/GM": "g",
    "http://qudt.org/vocab/unit/MilliGM": "mg",
    "http://qudt.org/vocab/unit/KiloGM": "kg",
    "http://qudt.org/vocab/unit/MilliGM-PER-MilliL": "mg/mL",
    "http://qudt.org/vocab/unit/GM-PER-MilliL": "g/mL",
    "http://qudt.org/vocab/unit/MilliMOL-PER-L": "mM",
    "http://qudt.org/vocab/unit/MOL-PER-L": "M",
    "http://qudt.org/vocab/unit/MicroGM-PER-MilliL": "µg/mL",
    "http://qudt.org/vocab/unit/MicroGM": "µg",
    "http://qudt.org/vocab/unit/NanoM": "nm",
    "http://qudt.org/vocab/unit/MicroM": "um",
    "http://qudt.org/vocab/unit/DEG_C": "°C",
    "http://qudt.org/vocab/unit/PERCENT": "%",
    "http://qudt.org/vocab/unit/NTU": "NTU",
    "http://qudt.org/vocab/unit/MilliPA-SEC": "mPa*s",
    "http://qudt.org/vocab/unit/N": "N",
}

#: Manufacturing reports print micrometres with their sign.
BATCH_UNITS = {**UNITS, "http://qudt.org/vocab/unit/MicroM": "µm"}

# Technique names, and what tells an ambiguous header's techniques apart.
TECHNIQUES = {"MFI": "Sub-Visible Particles - MFI", "PS20": "Polysorbate 20", "SoloVPE": "Protein content", "Visible Particles": "Visible Particles"}
AMBIGUOUS = "Compendial"
PARAMETER_HINTS = (("ph", "pH"), ("clarity", "Clarity and Opalescence"), ("opalesc", "Clarity and Opalescence"), ("ntu", "Clarity and Opalescence"), ("suspension", "Clarity and Opalescence"))

# German terms and their English ones.
TERMS = {
    "Sichtbare Partikel": "Visible Particles",
    "Osmolalität": "Osmolality",
    "Viskosität": "Viscosity",
    "Trübung": "Turbidity",
    "Färbung": "Coloration",
    "Aussehen": "Appearance",
    "Reinheit": "Purity",
    "Konzentration": "Concentration",
    "Löslichkeit": "Solubility",
    "Bewertung": "Assessment",
    "Klarheit": "Clarity",
    "Gehalt": "Content",
    "Dichte": "Density",
    "Farbe": "Color",
}

# Words that mark packaging, containers in the order they are looked for, and dose form codes.
PACKAGING = ("vial", "syringe", "stopper", "crimp", "cap")
CONTAINERS = {"pfs": "PFS", "syringe": "Syringe", "vial": "Vial", "cartridge": "Cartridge"}
DOSE_FORMS = {
    "S.INJ": "Solution for Injection",
    "SINJ": "Solution for Injection",
    "P.S.INJ": "Powder for Solution for Injection",
    "PSINJ": "Powder for Solution for Injection",
    "SOL.F.INJ": "Solution for Injection",
    "P.F.SOL.F.INJ": "Powder for Solution for Injection",
}


def decoded(x: Column, names: dict[str, str]) -> Column:
    """struct(label, confident): the name of an address; an empty one is confidently empty, an unknown one stays raw."""
    raw = text_of(x)
    label = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])[raw] if names else F.lit(None).cast("string")
    return F.struct(F.coalesce(label, raw).alias("label"), (label.isNotNull() | (raw == "")).alias("confident"))


def unit_label(unit: Column, names: dict[str, str] | None = None) -> Column:
    """The unit's name, or the unit as given."""
    return F.coalesce(F.create_map(*[F.lit(v) for kv in (names or UNITS).items() for v in kv])[unit], unit)


def reported_value(text: Column, number: Column, actual_text: Column, actual_number: Column) -> Column:
    """struct(value, source): reported before actual, text before number."""
    value = F.coalesce(text, number.cast("string"), actual_text, actual_number.cast("string"))
    return F.struct(value.alias("value"), F.when(text.isNotNull() | number.isNotNull(), "reported").otherwise("actual").alias("source"))


def strip_version(ref: Column) -> Column:
    """A method reference up to a comma, `` v1`` or ``(v``."""
    return F.coalesce(F.trim(F.regexp_replace(ref, r"(?s)(,|\s+[vV]\s*\d|\s*\([vV]).*$", "")), F.lit(""))


def bound(x: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def fix_mojibake(x: Column) -> Column:
    """UTF-8 read as Latin-1, put right; other text stays as it is."""

    def repaired(v: Column) -> Column:
        latin = ~v.rlike(r"[^\x{0}-\x{ff}]")
        again = F.when(latin, F.try_validate_utf8(F.encode(F.when(latin, v), "ISO-8859-1").cast("string")))
        return F.when(v.contains("Ã") | v.contains("Â"), F.coalesce(again, v)).otherwise(v)

    return bound(x, repaired)


def translate_terms(x: Column, terms: dict[str, str] | None = None) -> Column:
    """German terms in English, the longest first, where no letter stands next to them."""
    words = sorted((terms or TERMS).items(), key=lambda kv: -len(kv[0]))

    def translated(v: Column) -> Column:
        out = v
        for word, english in words:
            out = F.regexp_replace(out, rf"(?iu)(?<![A-Za-zÀ-ÿ])\Q{word}\E(?![A-Za-zÀ-ÿ])", english)
        return out

    # most texts hold neither a term nor misread letters: one look for all of them
    some = x.rlike("(?iu)[ÃÂ]|" + "|".join(rf"\Q{word}\E" for word, _ in words))
    return F.coalesce(F.when(some, bound(fix_mojibake(x), translated)).otherwise(x), F.lit(""))


def technique(header: Column, hint: Column, hints: tuple[tuple[str, str], ...] = PARAMETER_HINTS) -> Column:
    """struct(name, confident): the alias of a header; an ambiguous header is told apart by the first hint found."""
    head, low = text_of(header), F.lower(F.coalesce(hint, F.lit("")))
    found = F.lit(None).cast("string")
    for needle, name in reversed(hints):
        found = F.when(low.contains(needle.lower()), name).otherwise(found)
    alias = F.coalesce(F.create_map(*[F.lit(v) for kv in TECHNIQUES.items() for v in kv])[head], head)
    ambiguous = head == AMBIGUOUS
    return F.struct(F.when(ambiguous & found.isNotNull(), found).otherwise(translate_terms(F.when(ambiguous, head).otherwise(alias))).alias("name"), (~ambiguous | found.isNotNull()).alias("confident"))


def round_value(x: Column) -> Column:
    """Numbers of more than two decimals rounded to two, others in their own form; text stays; null is empty.

    Decimal half-up: a tie of the printed digits goes up, whatever its binary value.
    """
    s = text_of(x)
    number = F.when(s.rlike(r"^-?\d+,\d+$"), F.regexp_replace(s, ",", ".")).otherwise(s)
    is_number = number.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    short = ~number.rlike("[eE]") & ~number.rlike(r"\.\d{3,}$")
    kept = F.when(number.startswith("."), F.concat(F.lit("0"), number)).when(number.startswith("-."), F.concat(F.lit("-0"), F.substring(number, 2, 1 << 20))).otherwise(number)
    rounded = F.round(F.coalesce(number.try_cast("decimal(30,8)"), number.try_cast("double").cast("decimal(30,8)")), 2).cast("decimal(30,2)").cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(rounded, r"0+$", ""), r"\.$", "")
    # most numbers have their form already
    return F.when(s.rlike(r"^-?\d+(\.\d{0,2})?$"), s).when(~is_number, s).when(short, kept).otherwise(F.when(trimmed == "-0", "0").otherwise(trimmed))


def parameter_label(tech: Column, parameter: Column, units: Column, analyte: Column) -> Column:
    """A parameter without its leading technique word, with analyte and unit where not yet said."""
    label, name, unit = text_of(parameter), text_of(analyte), F.coalesce(units, F.lit(""))
    stripped = F.lit(None).cast("string")
    for word in reversed((text_of(tech), F.split(text_of(tech), " ")[0], F.lit("Clarity"), F.lit("pH"))):
        lead = (word != "") & F.startswith(F.lower(label), F.concat(F.lower(word), F.lit(" ")))
        stripped = F.when(lead, F.trim(F.substring(label, F.length(word) + 2, F.lit(1 << 20)))).otherwise(stripped)
    label = F.coalesce(stripped, label)
    with_name = F.when((name != "") & ~F.contains(F.lower(label), F.lower(name)), F.when(label != "", F.concat(label, F.lit(" — "), name)).otherwise(name)).otherwise(label)
    said = F.contains(with_name, F.lit("[")) | F.contains(F.lower(with_name), F.lower(unit))
    bracket = F.concat(F.lit("["), unit, F.lit("]"))
    return translate_terms(F.when((unit != "") & ~said, F.when(with_name != "", F.concat(with_name, F.lit(" "), bracket)).otherwise(bracket)).otherwise(with_name))


def tech_key(x: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), "[^A-Za-z0-9]", ""))


def leaf_label(size: Column, analyte: Column, parameter: Column) -> Column:
    """``>=size um``, else the analyte, else the parameter."""
    plain = size.cast("string")
    trimmed = F.when(plain.contains("."), F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", "")).otherwise(plain)
    return F.when(size.isNotNull(), F.concat(F.lit(">="), trimmed, F.lit(" um"))).when(F.coalesce(analyte, F.lit("")) != "", translate_terms(analyte)).otherwise(translate_terms(F.coalesce(parameter, F.lit(""))))


def amount_text(value: Column, unit: Column, names: dict[str, str] | None = None) -> Column:
    """struct(label, confident): value and decoded unit."""
    v, u = text_of(value), decoded(unit, BATCH_UNITS if names is None else names)
    return F.struct(F.when(v == "", "").otherwise(F.trim(F.concat(v, F.lit(" "), u["label"]))).alias("label"), ((v == "") | u["confident"]).alias("confident"))


def is_packaging(name: Column) -> Column:
    return F.lower(F.coalesce(name, F.lit(""))).rlike("|".join(PACKAGING))


def is_ingredient(function: Column) -> Column:
    """Neither a bulk solution nor packaging."""
    return ~F.lower(F.coalesce(function, F.lit(""))).contains("bulk solution") & ~is_packaging(function)


def component_class(name: Column, ref: Column, intermediate: str, substance: tuple[str, ...] = ()) -> Column:
    """packaging, substance or null: prior-stage intermediates (references with ``intermediate``) are no packaging; references with one of ``substance`` are drug substance."""
    low, r = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(ref, F.lit("")))
    is_substance = low.contains("drug substance") | low.contains("ds lot")
    for hint in substance:
        is_substance = is_substance | r.contains(hint)
    return F.when(~r.contains(intermediate) & is_packaging(low), "packaging").when(is_substance, "substance")


def mg_per_unit(concentration: Column, volume: Column) -> Column:
    """Leading number times volume, as ``360 mg``; empty where a part isn't a number."""
    c = F.regexp_extract(concentration, r"^\s*([\d.]+)", 1).try_cast("double")
    v = (c * volume.try_cast("double")).cast("decimal(24,6)").cast("string")
    return F.coalesce(F.concat(F.regexp_replace(F.regexp_replace(v, "0+$", ""), r"\.$", ""), F.lit(" mg")), F.lit(""))


def batch_name_parts(name: Column) -> Column:
    """struct of dose_mg, dose_form_code, dose_form_label, volume_ml, container read from a batch name; empty where absent."""
    s = F.coalesce(name, F.lit(""))
    code = F.upper(F.regexp_extract(s, r"(?i)\b(P\.?S\.?INJ|S\.?INJ|SOL\.?F\.?INJ|P\.?F\.?SOL\.?F\.?INJ)\b", 1))
    labels = F.create_map(*[F.lit(v) for kv in DOSE_FORMS.items() for v in kv])
    box = F.regexp_extract(s, r"(?i)\b(PFS|Vial|Cartridge|Syringe)\b", 1)
    shown = F.when((box == F.upper(box)) | (F.upper(box) == "PFS"), F.upper(box)).otherwise(F.initcap(box))
    return F.struct(
        F.regexp_extract(s, r"(?i)(\d+(?:\.\d+)?)\s*mg\b", 1).alias("dose_mg"), code.alias("dose_form_code"),
        F.when(code == "", "").otherwise(F.coalesce(labels[code], labels[F.regexp_replace(code, r"\.", "")], code)).alias("dose_form_label"),
        F.regexp_extract(s, r"(?i)(\d+(?:\.\d+)?)\s*mL\b", 1).alias("volume_ml"), shown.alias("container"),
    )


def title_line(parts: Column) -> Column:
    """The recurring header line of a batch, without what is blank."""
    words = F.array(
        F.when(parts["dose_mg"] != "", F.concat(parts["dose_mg"], F.lit(" mg"))), F.nullif(parts["dose_form_code"], F.lit("")),
        F.when(parts["volume_ml"] != "", F.concat(parts["volume_ml"], F.lit(" mL"))), F.when(parts["container"] != "", F.concat(F.lit("in "), parts["container"])),
    )
    return F.array_join(F.array_compact(words), " ")


def first_filled(*values: Column, placeholder: str = "____") -> Column:
    """The first value that isn't blank, else a blank to fill in."""
    return F.coalesce(*[blank_to_null(v) for v in values], F.lit(placeholder))


def cap_text(x: Column, most: int = 180_000, marker: str = "\n\n[MANUAL TRUNCATED]") -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit(marker))).otherwise(x)


def strip_control(x: Column) -> Column:
    return F.regexp_replace(x, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def doc_title(answer: Column, metadata: Column, filename: Column) -> Column:
    stem = F.regexp_replace(F.element_at(F.split(filename, "/"), -1), r"\.[^.]*$", "")
    return F.coalesce(blank_to_null(answer), blank_to_null(metadata), stem)
