"""What every order of the text filters removes: a recursive query over prefixes of filters.

Each document becomes a mask of the filters it fails; documents of one part and mask are one cell.  The recursion
extends every prefix by the letters not in it, meets the mask cells and carries the bits applied so far; a level's
rows say which cells its last filter removes, which it would have removed again, and which it leaves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import saved

#: Limits of the filters: fewest words, least share of distinct words and largest share of capitals in percent, marks.
WORDS, DISTINCT, CAPITALS, MARKS = 200, 50, 2, "[#$%&*|]"
_ROWS = "spark.sql.cteRecursionRowLimit"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_filters(text: Column) -> dict[str, Column]:
    """Whether a text fails A (few words), B (few distinct ones), C (capitals), D (marks)."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), 0)
    capitals = F.length(text) - F.length(F.translate(text, _UPPER, ""))
    return {
        "A": F.size(words) < WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT * F.size(words),
        "C": 100 * capitals > CAPITALS * F.length(text),
        "D": text.rlike(MARKS),
    }


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit k: fails the k-th letter of ABCDE), n, good and toxic documents, in a written table.

    E fails where a smaller doc_id has the same text: copies are counted by part, mask and text before they meet, so
    a text that a third of all rows share is a few rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    fails = text_filters(text)
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(fails.values())), F.lit(0))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), mask.alias("mask"), F.unhex(F.sha2(text, 256)).alias("text"))
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = slim.join(marked, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    group = ["part", "mask", "text", "good", "toxic"]
    rows = known.groupBy(*group, "doc_id").agg(F.count("*").alias("n"))
    # rows without an id come after all others and precede none
    copies = rows.groupBy(*group).agg(F.sum("n").alias("n"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("loose"))
    lowest = copies.groupBy("text").agg(F.min("low").alias("lowest"))
    met = copies.join(lowest, "text").withColumn("new", F.when(F.col("lowest").isNull(), F.col("loose")).when(F.col("low") == F.col("lowest"), F.col("first")).otherwise(0))
    e = 1 << len(fails)
    both = met.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("new").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(e)).alias("mask"), (F.col("n") - F.col("new")).alias("n")))).alias("x"))
    cells = both.filter("x.n > 0").groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))
    return saved(cells, "mask-cells")


def prefix_steps(cells: DataFrame, letters: Sequence[str]) -> DataFrame:
    """part, prefix and its last filter's counts, for every prefix of every order, in a written table."""
    spark = cells.sparkSession
    names = spark.createDataFrame([(x, 1 << k) for k, x in enumerate(letters)], "letter string, bit int").coalesce(1)
    steps = spark.sql(
        """WITH RECURSIVE steps AS (
        SELECT part, mask, n, good, toxic, CAST('' AS STRING) AS prefix, 0 AS applied, 0 AS bit FROM {cells}
        UNION ALL
        SELECT s.part, s.mask, s.n, s.good, s.toxic, concat(s.prefix, l.letter), s.applied | l.bit, l.bit FROM steps s JOIN {names} l ON s.applied & l.bit = 0)
        SELECT part, prefix, mask, n, good, toxic, mask & (applied & ~bit) = 0 AS here, mask & bit <> 0 AS fails, mask = bit AS only, mask & applied = 0 AS stays FROM steps WHERE bit > 0""",
        cells=cells, names=F.broadcast(names),
    )
    total = lambda what, n="n": F.sum(F.when(what, F.col(n)).otherwise(0))
    here, fails = F.col("here"), F.col("fails")
    counts = [total(F.col("stays")), total(here & fails), total(~here & fails), total(F.col("only")), total(here & fails, "good"), total(here & fails, "toxic")]
    before = spark.conf.get(_ROWS)
    try:  # the recursion is as large as the parts' cells times the prefixes
        spark.conf.set(_ROWS, "-1")
        return saved(steps.groupBy("part", "prefix").agg(*[c.alias(n) for c, n in zip(counts, _COUNTS)]), "prefix-steps")
    finally:
        spark.conf.set(_ROWS, before)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters ABCDE and step, with counts within the part.

    ``docs``: doc_id, text, source; ``labels``: doc_id, quality, toxic; other columns are left out.  A null text is
    empty, a null source the part of the empty string; rows without an id are never smaller than others, so each passes
    E unless a row with an id has its text; of repeated rows with one id none is smaller; labels of a repeated id count if any
    says so; null labels say nothing and those without an id belong to no row; an empty table gives no rows.  Whole texts are read.
    """
    letters = "ABCDE"
    found = prefix_steps(mask_cells(docs, labels), letters)
    last = F.substring("prefix", -1, 1)
    orders = found.filter(F.length("prefix") == len(letters)).select(F.col("prefix").alias("filter_order")).distinct()
    # at most 120 orders of five steps
    wanted = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step")).withColumn("prefix", F.expr("substring(filter_order, 1, step)"))
    rows = found.join(F.broadcast(wanted), "prefix").withColumn("letter", last)
    shapley = rows.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return rows.join(shapley, ["part", "letter"]).select("part", "filter_order", F.col("step").cast("int").alias("step"), *[F.col(c).cast("long").alias(c) for c in _COUNTS], "shapley")
