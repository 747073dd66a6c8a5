"""Comparison, counting and hashing of datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.tables import saved

from .helpers import asof_last
from .scans import PLACES, running


def row_counts(pack: dict[str, DataFrame]) -> DataFrame:
    """D21. Rows of each relation."""
    out = None
    for name, df in pack.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 of a row's columns in name order, as JSON."""
    return F.sha2(F.to_json(F.struct(*sorted(columns or df.columns)), {"ignoreNullFields": "false"}), 256)


def content_hash(df: DataFrame, keys: list[str]) -> DataFrame:
    """D22. One hash of each key's rows, whatever their order; equal rows count each time.

    Row hashes are cut into four numbers each and summed, so no group is gathered; the sums and the count are hashed.
    """
    h = df.withColumn("_h", row_hash(df))
    parts = [F.sum(F.conv(F.substring("_h", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(4)]
    return h.groupBy(*keys).agg(F.sha2(F.concat_ws(",", F.count("*").cast("string"), *parts), 256).alias("content_hash"), F.count("*").alias("n_rows"))


def dataset_diff(expected: DataFrame, actual: DataFrame, keys: list[str], soft: tuple[str, ...] = ()) -> DataFrame:
    """G3. Differences by position: (keys, column, expected, actual, severity); missing rows are hard, ``soft`` columns soft."""
    columns = [c for c in expected.columns if c not in keys]
    e = expected.select(*keys, F.struct(*[F.col(c).cast("string").alias(c) for c in columns]).alias("e"))
    a = actual.select(*keys, F.struct(*[F.col(c).cast("string").alias(c) for c in columns]).alias("a"))
    both = e.join(a, keys, "full")
    row = F.when(F.col("e").isNull() | F.col("a").isNull(), F.array(F.struct(F.lit("(row)").alias("column"), F.when(F.col("e").isNotNull(), "present").otherwise("missing").alias("expected"), F.when(F.col("a").isNotNull(), "present").otherwise("missing").alias("actual"), F.lit("hard").alias("severity"))))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"e.{c}").alias("expected"), F.col(f"a.{c}").alias("actual"), F.lit("soft" if c in soft else "hard").alias("severity")) for c in columns])
    differing = F.filter(cells, lambda x: ~x["expected"].eqNullSafe(x["actual"]))
    return both.select(*keys, F.explode(F.coalesce(row, differing)).alias("d")).select(*keys, "d.*")


def multiset_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """G3. Rows only in one of the two, as often as they are; with the side they are on."""
    return expected.exceptAll(actual).withColumn("side", F.lit("expected")).unionByName(actual.exceptAll(expected).withColumn("side", F.lit("actual")))


def _longest_rise(pdf):
    """The rows of a block that keep their order: a longest run of growing places."""
    from bisect import bisect_left

    pdf = pdf.sort_values("e_rank")
    ends, tails, before = [], [], []
    for k, place in enumerate(pdf["a_rank"].tolist()):
        n = bisect_left(ends, place)
        before.append(tails[n - 1] if n else -1)
        ends[n : n + 1], tails[n : n + 1] = [place], [k]
    kept, k = [False] * len(pdf), tails[-1]
    while k >= 0:
        kept[k], k = True, before[k]
    return pdf.assign(kept=kept)


def heading_changes(expected: DataFrame, actual: DataFrame, key: str, width: float = PLACES) -> DataFrame:
    """G3. Headings (key, ord, title) of two versions told apart: (key, title, change, e_ord, a_ord), change being kept, moved, deleted or inserted.

    Titles that occur once on both sides are anchors; a longest run of them in one order is kept, the others have
    moved.  Titles that repeat are kept where both sides have them between the same kept anchors, as often as they
    do.  Anchors fall into blocks that no heading has left (the first n places hold the first n headings); only
    blocks of more than one are looked at as a whole.  Null titles are left out.
    """
    e, a = (df.filter("title is not null").select(key, "title", F.col("ord").cast("long").alias(f"{s}_ord")) for df, s in ((expected, "e"), (actual, "a")))
    once = lambda df, s: df.groupBy(key, "title").agg(F.min(f"{s}_ord").alias(f"{s}_ord"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    # each step reads its rows twice, so the one before is a written table
    line = saved(once(e, "e").join(once(a, "a"), [key, "title"]).withColumn("_one", F.lit(1)), "anchors")
    for s in "ea":
        line = saved(running(line, [key], [f"{s}_ord", "title"], "_one", f"{s}_rank", "sum", width), "ranks")
    line = saved(running(line, [key], ["e_rank"], "a_rank", "_most", "max", width).withColumn("_end", (F.col("_most") == F.col("e_rank")).cast("int")), "places")
    line = running(line, [key], ["e_rank"], "_end", "_ends", "sum", width).withColumn("block", F.col("_ends") - F.col("_end"))
    # a heading in its own place, with all before it before it, is a block by itself
    line = line.withColumn("_alone", (F.col("e_rank") == F.col("a_rank")) & (F.col("_end") == 1)).select(key, "title", "e_ord", "a_ord", "e_rank", "a_rank", "block", "_alone")
    blocks = line.filter("not _alone").drop("_alone")
    found = blocks.groupBy(key, "block").applyInPandas(_longest_rise, f"{', '.join(f'`{n}` {t}' for n, t in blocks.dtypes)}, kept boolean")
    anchors = saved(found.unionByName(line.filter("_alone").drop("_alone").withColumn("kept", F.lit(True))).select(key, "title", "e_ord", "a_ord", "kept"), "kept-anchors")
    # repeats: the k-th of a title between two kept anchors on either side
    kept = anchors.filter("kept").withColumn("_one", F.lit(1))
    kept = saved(running(kept, [key], ["e_ord", "title"], "_one", "gap", "sum", width), "gaps")

    def placed(df: DataFrame, s: str) -> DataFrame:
        rest = df.join(anchors.select(key, "title"), [key, "title"], "left_anti").withColumn("_row", F.monotonically_increasing_id())
        marks = kept.select(key, F.col(f"{s}_ord").alias("_place"), "gap")
        inside = asof_last(rest.withColumn("_own", F.col(f"{s}_ord")), marks, [key], "_own", "_place", ["gap"], width).withColumn("gap", F.coalesce("gap", F.lit(0)))
        return inside.withColumn("_k", F.row_number().over(Window.partitionBy(key, "gap", "title").orderBy(f"{s}_ord", "_row"))).drop("_own", "_row")

    rest = placed(e, "e").join(placed(a, "a"), [key, "gap", "title", "_k"], "full")
    change = F.when(F.col("a_ord").isNull(), "deleted").when(F.col("e_ord").isNull(), "inserted").otherwise("kept")
    return anchors.select(key, "title", F.when(F.col("kept"), "kept").otherwise("moved").alias("change"), "e_ord", "a_ord").unionByName(rest.select(key, "title", change.alias("change"), "e_ord", "a_ord"))


def cell_similarity(expected: DataFrame, actual: DataFrame, key: str, value: str, least: float = 0.98) -> DataFrame:
    """G4. Multiset Dice ``2 n(A and B) / (n(A) + n(B))`` of the values of each key, and whether it reaches ``least``.

    An upper bound of a sequence ratio: the order of values isn't compared.
    """
    count = lambda df, name: df.groupBy(key, value).agg(F.count("*").alias(name))
    both = count(expected, "n_e").join(count(actual, "n_a"), [key, value], "full").fillna(0, ["n_e", "n_a"])
    out = both.groupBy(key).agg((2 * F.sum(F.least("n_e", "n_a"))).alias("common"), F.sum(F.col("n_e") + F.col("n_a")).alias("total"))
    return out.select(key, (F.col("common") / F.col("total")).alias("similarity"), (F.col("common") / F.col("total") >= least).alias("equal"))


def ordered_similarity(expected: DataFrame, actual: DataFrame, key: str, value: str, order: list[str], least: float = 0.98) -> DataFrame:
    """G4. Share of the cells of each key that keep their order, ``2 kept / (n expected + n actual)``, 1 where nothing is expected, and whether it reaches ``least``.

    ``order``: the first column is a number.  What is kept is told by ``heading_changes``: a longest run of the cells
    that occur once, and repeats between the same ones of these, in whatever order they have there.  Null cells are alike.
    """

    def numbered(df: DataFrame) -> DataFrame:
        rows = df.select(key, *order, F.coalesce(F.col(value).cast("string"), F.lit("\0")).alias("title"), F.lit(1).alias("_one"))
        return saved(running(rows, [key], order, "_one", "_no", "sum").select(key, F.col("_no").alias("ord"), "title"), "numbered")

    changes = heading_changes(numbered(expected), numbered(actual), key)
    counts = changes.groupBy(key).agg(F.count_if(F.col("change") == "kept").alias("kept"), F.count("e_ord").alias("n_e"), F.count("a_ord").alias("n_a"))
    similarity = F.when(F.col("n_e") == 0, 1.0).otherwise(2 * F.col("kept") / (F.col("n_e") + F.col("n_a")))
    return counts.select(key, similarity.alias("similarity"), (similarity >= least).alias("equal"))


def audit_record(ids: DataFrame, counts: DataFrame, hashes: DataFrame, flags: DataFrame) -> DataFrame:
    """K12. One struct a request: display and query id, rows, content hash and number of flags."""
    n = flags.groupBy("request_id").agg(F.count("*").alias("n_flags"))
    out = ids.join(counts, "request_id", "left").join(hashes, "request_id", "left").join(n, "request_id", "left")
    return out.select("request_id", F.struct("display", "query", F.coalesce("n", F.lit(0)).alias("rows"), "content_hash", F.coalesce("n_flags", F.lit(0)).alias("flags")).alias("record"))
