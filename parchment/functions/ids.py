"""Identifier expressions: normal forms, keys and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(x: Column | str) -> Column:
    """Trimmed text, null where nothing is left: an empty string and a null mean the same in the warehouse."""
    return F.nullif(F.trim(F.col(x) if isinstance(x, str) else x), F.lit(""))


def text_of(x: Column | str) -> Column:
    """Trimmed text, empty for null."""
    return F.coalesce(F.trim(F.col(x) if isinstance(x, str) else x), F.lit(""))


def request_id(raw: Column, query_prefix: str = "", display_prefix: str = "") -> Column:
    """struct(short, display, query) from the first run of three or more digits, with the caller's prefixes; null where there is none."""
    short = F.regexp_substr(raw, F.lit(r"\d{3,}"))
    return F.when(short.isNotNull(), F.struct(short.alias("short"), F.concat(F.lit(display_prefix), short).alias("display"), F.concat(F.lit(query_prefix), short).alias("query")))


def batch_id(raw: Column, registered_prefix: str = "") -> Column:
    """struct(short, query, registration): ``BAX`` ids are registered and take the prefix, other ``BA`` ids are manual."""
    short = F.upper(F.regexp_substr(raw, F.lit(r"(?i)\bBA[A-Z]?\d{4,}\b")))
    nest = short.startswith("BAX")
    return F.when(short.isNotNull(), F.struct(short.alias("short"), F.when(nest, F.concat(F.lit(registered_prefix), short)).otherwise(short).alias("query"), F.when(nest, "nest").otherwise("manual").alias("registration")))


def last_segment(x: Column, separators: str = "_-") -> Column:
    """Text after the last separator; the whole text where that would be empty."""
    return F.coalesce(F.regexp_substr(x, F.lit(f"[^{separators}]+$")), x)


def timepoint(sample: Column) -> Column:
    return F.regexp_substr(sample, F.lit("^(Day[0-9]+|[0-9]+M)"))


def storage(sample: Column) -> Column:
    return F.regexp_substr(sample, F.lit("[0-9]+C$"))


def batch_label(batch: Column, lot: Column) -> Column:
    """``lot (batch)`` where the lot is a number of five or more digits, else the batch."""
    return F.when(F.trim(lot).rlike(r"^\d{5,}$"), F.concat(F.trim(lot), F.lit(" ("), batch, F.lit(")"))).otherwise(batch)


def component_lot(ref: Column) -> Column:
    """Digits at the end of a component reference; empty where the reference has another form."""
    return F.coalesce(F.regexp_extract(ref, r"(?i)urn:batch:[^:]+[-:](\d{4,})\b", 1), F.lit(""))


def component_batch(ref: Column) -> Column:
    return F.coalesce(F.upper(F.regexp_substr(ref, F.lit(r"(?i)\bBA[A-Z]?\d{4,}\b"))), F.lit(""))


def experiment_id(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"entityId=([^&\s]+)", 1), F.lit(""))


def object_key(prefix: Column, run_id: Column, kind: Column, filename: Column, folder: Column | None = None) -> Column:
    """``prefix/run/kind/name`` from the last part of the file name; ``folder`` stands for kind where given."""
    name = F.element_at(F.split(F.regexp_replace(filename, r"\\", "/"), "/"), -1)
    place = kind if folder is None else F.coalesce(F.nullif(folder, F.lit("")), kind)
    part = lambda c: F.nullif(F.regexp_replace(c, "^/+|/+$", ""), F.lit(""))
    return F.concat_ws("/", part(prefix), run_id.cast("string"), part(place), name)


def safe_segment(x: Column) -> Column:
    """Only letters, digits, dot, underscore and single dashes; ``unknown`` where nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "[^A-Za-z0-9._-]+", "-"), "-{2,}", "-")
    return F.coalesce(F.nullif(F.regexp_replace(clean, r"^[-.]+|[-.]+$", ""), F.lit("")), F.lit("unknown"))


def archive_key(prefix: str, kind: Column, process: Column, ident: Column, variant: Column, ext: str) -> Column:
    """A key of safe segments under ``prefix``."""
    return F.concat(F.lit(prefix.rstrip("/") + "/"), F.concat_ws("/", safe_segment(kind), safe_segment(process)), F.lit("/"), F.concat_ws("_", safe_segment(ident), safe_segment(variant)), F.lit("." + ext.lstrip(".")))


def output_stem(name: Column, most: int = 40) -> Column:
    return F.rtrim(F.substring(sanitized_filename(name), 1, most))


def sanitized_filename(name: Column, most: int = 120) -> Column:
    return F.substring(F.regexp_replace(F.trim(F.regexp_replace(name, r'[\\/:*?"<>|\x00-\x1f]', "_")), r"\s+", "_"), 1, most)


def given_name(full: Column) -> Column:
    """The given name of ``Family, Given`` or ``Given Family``."""
    parts = F.split(F.trim(full), r"\s*,\s*")
    return F.when(F.size(parts) > 1, F.split(F.element_at(parts, 2), r"\s+")[0]).otherwise(F.split(F.trim(full), r"\s+")[0])


def format_bytes(n: Column) -> Column:
    """``n B``, or KB, MB, GB with one decimal."""
    size = lambda k, unit: F.concat(F.format_string("%.1f", (n / float(1 << (10 * k))).cast("double")), F.lit(unit))
    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, size(1, " KB")).when(n < 1 << 30, size(2, " MB")).otherwise(size(3, " GB"))


def humanize_key(key: Column) -> Column:
    """``some_key-part`` as ``Some key part``; the rest of each word keeps its case."""
    words = F.trim(F.regexp_replace(key, r"[_\-.]+", " "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1 << 30))


def elapsed_ms(start: Column, end: Column) -> Column:
    return F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))


def progress(percent: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), percent))
