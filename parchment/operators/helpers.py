"""Ordered-set helpers that several operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions.ids import blank_to_null
from parchment.tables import saved

from .scans import PLACES, running


def nulls_last(*columns: str) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


def keep_first(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def first_filled_by(column: str, order: Column | str) -> Column:
    """Aggregate: the first value in order that isn't blank."""
    value = blank_to_null(column)
    return F.min_by(value, F.when(value.isNotNull(), order if isinstance(order, Column) else F.col(order)))


def ordered_list(value: Column, order: Column, separator: str = ", ") -> Column:
    """Aggregate: values joined in order; null where there are none."""
    pairs = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))))
    return F.nullif(F.array_join(pairs["v"], separator), F.lit(""))


def asof_last(items: DataFrame, marks: DataFrame, keys: Sequence[str], at: str, mark_at: str, take: Sequence[str], width: float = PLACES) -> DataFrame:
    """Each item with the columns ``take`` of the last mark at or before it within the keys; null before the first.

    Items and marks are laid on one line and the last mark is carried on, from slice to slice of ``width`` places;
    marks without a place are left out, items without one find none.
    """
    mark = F.struct(*[F.col(c) for c in take])
    marks = marks.filter(F.col(mark_at).isNotNull()).select(*keys, F.col(mark_at).alias("_at"), F.lit(0).alias("_kind"), *([F.col("ord")] if "ord" in marks.columns else [F.lit(0).alias("ord")]), mark.alias("_mark"))
    own = items.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(0).alias("ord"), F.struct(*items.columns).alias("_item"))
    line = marks.unionByName(own, allowMissingColumns=True)
    carried = running(line, keys, ["_at", "_kind", "ord"], "_mark", "_last", "last", width).filter("_kind = 1").withColumn("_last", F.when(F.col("_at").isNotNull(), F.col("_last")))
    return carried.select("_item.*", *[F.col(f"_last.{c}").alias(c) for c in take])


def contains_join(needles: DataFrame, needle: str, texts: DataFrame, text: str, size: int = 3) -> DataFrame:
    """(needle, text): distinct pairs of which the text contains the needle; an empty one is in none.

    For short texts (ids, words).  A needle is looked up by the one of its runs of ``size`` characters (a shorter one: by
    itself) that the fewest texts hold, and compared in full where they meet: what many texts share is no key.
    """
    runs = lambda c, n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    own = needles.select(F.col(needle).alias("_needle")).filter("_needle <> ''").distinct()
    least = own.agg(F.min(F.length("_needle"))).first()[0] or size
    own = own.select("_needle", F.explode(F.when(F.length("_needle") < size, F.array("_needle")).otherwise(F.array_distinct(runs(F.col("_needle"), size)))).alias("_run"))
    held = texts.select(F.col(text).alias("_text")).filter("_text <> ''").distinct()
    held = held.select("_text", F.explode(F.array_distinct(F.concat(*[runs(F.col("_text"), n) for n in range(min(least, size), size + 1)]))).alias("_run")).join(own.select("_run").distinct(), "_run", "left_semi")
    often = held.groupBy("_run").agg(F.count("*").alias("_n"))
    rarest = own.join(often, "_run", "left").groupBy("_needle").agg(F.min_by("_run", F.struct(F.coalesce("_n", F.lit(0)), "_run")).alias("_run"))
    return rarest.join(held, "_run").filter(F.contains("_text", F.col("_needle"))).select(F.col("_needle").alias(needle), F.col("_text").alias(text))


def gap_groups(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: float, name: str = "group_no") -> DataFrame:
    """Number the runs of items whose start is within ``gap`` of all ends so far."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_new", F.coalesce((F.col(start) - reach > gap).cast("int"), F.lit(1))).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), y1 - y0)


def _box(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")]


def intersection(a: str = "a_", b: str = "b_") -> Column:
    ax0, ay0, ax1, ay1 = _box(a)
    bx0, by0, bx1, by1 = _box(b)
    return area(F.greatest(ax0, bx0), F.greatest(ay0, by0), F.least(ax1, bx1), F.least(ay1, by1))


def iou(a: str = "a_", b: str = "b_") -> Column:
    both = intersection(a, b)
    union = area(*_box(a)) + area(*_box(b)) - both
    return F.when(union > 0, both / union).otherwise(0.0)


#: Boxes of a page's cell, about; cells of a page along a side at most.
CELL_BOXES, CELLS = 16, 256
#: Cells along a side at most for boxes that hang together: one box a cell, so that boxes reach over whole cells.
CLUSTER_CELLS = 64


def _cell(value: Column, low: str, wide: str) -> Column:
    return F.greatest(F.lit(0), F.least(F.col("_n") - 1, F.floor((value - F.col(low)) / F.col(wide) * F.col("_n")))).cast("int")


def _grid(b: DataFrame, keys: Sequence[str], most: int, each: int) -> DataFrame:
    names = [f"_k{i}" for i in range(len(keys))]
    page = b.groupBy(*keys).agg(F.min("x0").alias("_x"), F.min("y0").alias("_y"), F.max("x1").alias("_w"), F.max("y1").alias("_h"), F.least(F.lit(most), F.ceil(F.sqrt(F.count("*") / each))).cast("int").alias("_n"))
    return page.select(*[F.col(c).alias(n) for c, n in zip(keys, names)], "_x", F.greatest(F.col("_w") - F.col("_x"), F.lit(1e-300)).alias("_w"), "_y", F.greatest(F.col("_h") - F.col("_y"), F.lit(1e-300)).alias("_h"), "_n")


def _celled(df: DataFrame, page: DataFrame, keys: Sequence[str], p: str) -> DataFrame:
    names = [f"_k{i}" for i in range(len(keys))]
    both = df.join(page, [df[c] == page[n] for c, n in zip(keys, names)]).drop(*names)
    across = lambda lo, hi, low, wide: F.explode(F.sequence(_cell(F.col(lo), low, wide), F.greatest(_cell(F.col(lo), low, wide), _cell(F.col(hi), low, wide))))
    both = both.withColumn("_cx", across("x0", "x1", "_x", "_w")).withColumn("_cy", across("y0", "y1", "_y", "_h"))
    return both.select(*keys, "_cx", "_cy", "_x", "_w", "_y", "_h", "_n", *[F.col(c).alias(f"{p}{c}") for c in df.columns if c not in keys])


def _met(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    joined = a.join(b.drop("_x", "_w", "_y", "_h", "_n"), [*keys, "_cx", "_cy"])
    begins = (_cell(F.greatest("a_x0", "b_x0"), "_x", "_w") == F.col("_cx")) & (_cell(F.greatest("a_y0", "b_y0"), "_y", "_h") == F.col("_cy"))
    touch = (F.greatest("a_x0", "b_x0") <= F.least("a_x1", "b_x1")) & (F.greatest("a_y0", "b_y0") <= F.least("a_y1", "b_y1"))
    return joined.filter(begins & touch).drop("_cx", "_cy", "_x", "_w", "_y", "_h", "_n")


def meeting(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs of boxes on the same page (``keys``) that overlap or touch.

    A page of many boxes is a grid of cells, as many as its boxes need: boxes meet by page and cell in a hash join,
    and a pair counts in the one cell where its overlap begins.
    """
    page = _grid(b, keys, CELLS, CELL_BOXES)
    return _met(_celled(a, page, keys, "a_"), _celled(b, page, keys, "b_"), keys)


def hanging(padded: DataFrame, boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, a, b): links by which the boxes (id) hang together as by all pairs of ``padded`` and ``boxes`` that meet.

    A box that reaches over a cell on all sides meets every padded box in it, so the others there are linked to one
    such box; pairs are looked for only in cells without one.
    """
    page = _grid(boxes, keys, CLUSTER_CELLS, 1)
    own, wide = _celled(boxes, page, keys, "b_"), _celled(padded, page, keys, "a_")
    at = [*keys, "_cx", "_cy"]
    over = [(_cell(F.col(f"b_{c}0"), f"_{c}", w) < F.col(f"_c{c}")) & (_cell(F.col(f"b_{c}1"), f"_{c}", w) > F.col(f"_c{c}")) for c, w in (("x", "_w"), ("y", "_h"))]
    hubs = saved(own.filter(over[0] & over[1]).groupBy(*at).agg(F.min("b_id").alias("hub")), "hubs")
    stars = wide.join(hubs, at).select(*keys, F.col("a_id").alias("a"), F.col("hub").alias("b")).distinct()
    pairs = _met(wide.join(hubs, at, "left_anti"), own.join(hubs, at, "left_anti"), keys).filter("a_id < b_id").select(*keys, F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return stars.unionByName(pairs).filter("a <> b")


def rect_join(a: DataFrame, b: DataFrame, keys: Sequence[str], share: float | None = None) -> DataFrame:
    """Pairs of boxes on the same page (``keys``) with overlap; ``share``: of a's area, more than this."""
    joined, own = meeting(a, b, keys), area(*_box("a_"))
    out = joined.withColumn("overlap", intersection()).withColumn("share", F.when(own > 0, F.col("overlap") / own).otherwise(0.0)).filter("overlap > 0")
    return out if share is None else out.filter(F.col("share") > share)
