"""Sharding by sampled splitters: shards of near equal bytes, in DataFrame functions only.

Records are ordered by a hash of their text and, within equal texts, by a hash of their row.  A sample
in which a record's chance grows with its size gives quantile boundaries; each record finds its range by
binary search; ranges that come out overfull are sampled again and subdivided, so a text that makes up
a third of all rows is cut like any other stretch.  Exact byte sums of the ranges then place every
record on the line from 0 to the total, which is cut into equal shards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import saved

#: Ranges for each shard at least, rows a range aims at, ranges at most, sampled keys for each range.
RANGES_PER_SHARD, RANGE_ROWS, RANGES, OVERSAMPLE = 16, 500_000, 32_768, 8
#: A range is overfull beyond so many times the mean; rounds of subdivision at most.
OVERFULL, ROUNDS = 2.0, 4
_LOW = -(1 << 63)


def _array(values, dtype: str = "i8") -> Column:
    return F.lit(np.asarray(values, dtype=dtype))


def _range_of(splitters: list[tuple[int, int]]) -> Column:
    """Number of splitters at or below the key (h, r), by binary search."""
    if not splitters:
        return F.lit(0)
    n = len(splitters)
    first, second = _array([a for a, _ in splitters]), _array([b for _, b in splitters])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])

    def step(lo: Column, p: Column) -> Column:
        a, b = F.get(first, lo + p - 1), F.get(second, lo + p - 1)
        return F.when((lo + p <= n) & ((a < F.col("h")) | ((a == F.col("h")) & (b <= F.col("r")))), lo + p).otherwise(lo)

    return F.aggregate(steps, F.lit(0), step)


def _quantiles(sample: list[tuple[int, int, float]], parts: int) -> list[tuple[int, int]]:
    """Boundaries that cut the weighted sample into ``parts``; the second part of a key counts only inside one text."""
    sample = sorted(sample)
    if not sample or parts < 2:
        return []
    total, out, so_far = sum(w for *_, w in sample), [], 0.0
    for h, r, w in sample:
        if so_far + w > (len(out) + 1) * total / parts:
            while len(out) + 1 < parts and so_far + w > (len(out) + 1) * total / parts:
                out.append((h, r))
        so_far += w
    return out


def _whole_texts(splitters: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Splitters moved to the start of their text, but inside a text with several of them."""
    splitters = sorted(set(splitters))
    texts: dict[int, int] = {}
    for h, _ in splitters:
        texts[h] = texts.get(h, 0) + 1
    return sorted({(h, r if texts[h] > 1 else _LOW) for h, r in splitters} | {(h, _LOW) for h, n in texts.items() if n > 1})


def _sampled(rows: DataFrame, per_byte: float, seed: int) -> list[tuple[int, int, float]]:
    """(h, r, weight in bytes) of records drawn with chance size * per_byte."""
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(per_byte))
    drawn = rows.filter(F.pmod(F.xxhash64("uid", "r", F.lit(seed)), F.lit(1 << 40)) < chance * float(1 << 40))
    return [tuple(x) for x in drawn.select("h", "r", (F.col("size") / chance).alias("w")).collect()]


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Place every record in one of ``shards`` shards with near equal bytes.

    ``docs``: doc_id and text; other columns are left out.  A record's size is its text's UTF-8 bytes plus
    1; a null text has no bytes (its crc32 is 0).  Equal texts lie together and share a shard unless they
    are more than 1/200 of one.  Repeated rows and null ids are records of their own; an empty table gives
    no rows.  Returns doc_id, size, text_crc32, law (``bytes``), shard, slot (from 0 without gaps) and
    grown_shard (null: the law doesn't depend on the number of shards).
    """
    text = F.col("text").cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"), F.xxhash64(text, F.isnull(text)).alias("h"), F.monotonically_increasing_id().alias("uid"))
    rows = saved(rows.withColumn("r", F.xxhash64("doc_id", "uid")), "records")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = int(min(RANGES, max(RANGES_PER_SHARD * shards, n // RANGE_ROWS)))
    splitters = _quantiles(_sampled(rows, ranges * OVERSAMPLE / max(1, total), 1), ranges)
    splitters = _whole_texts(splitters)
    for again in range(ROUNDS + 1):
        stats = rows.withColumn("range", _range_of(splitters)).groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
        mean = total / max(1, ranges)
        over = [r["range"] for r in stats if r["n"] > 1 and r["bytes"] > OVERFULL * mean]
        if again == ROUNDS or not over:
            break
        inside = rows.withColumn("range", _range_of(splitters)).filter(F.array_contains(_array(over, "i4"), F.col("range")))
        found = _sampled(inside, OVERSAMPLE / mean, 2 + again)
        before = len(splitters)
        parts = sum(-int(-r["bytes"] // mean) for r in stats if r["range"] in set(over))
        more = _quantiles(found, max(2, parts))
        splitters = sorted(set(splitters) | set(_whole_texts(more)))
        if len(splitters) == before or len(splitters) > 2 * RANGES:
            break
        ranges = max(ranges, len(splitters) + 1)
    if len(splitters) + 1 > len(stats) or again:  # the sums of the final ranges
        stats = rows.withColumn("range", _range_of(splitters)).groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    in_range = {r["range"]: (r["bytes"], r["n"]) for r in stats}
    sums = np.array([in_range.get(k, (0, 0)) for k in range(len(splitters) + 1)], "i8")
    base = np.concatenate([np.zeros((1, 2), "i8"), sums.cumsum(axis=0)])[:-1]
    order = Window.partitionBy("range").orderBy("h", "r", "uid")
    group = Window.partitionBy("range", "h")
    line = (
        rows.withColumn("range", _range_of(splitters))
        .withColumn("to", F.get(_array(base[:, 0]), "range") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("at", F.get(_array(base[:, 1]), "range") + F.row_number().over(order) - 1)
        .withColumn("from", F.col("to") - F.col("size"))
        .withColumn("text_from", F.min("from").over(group))
        .withColumn("text_to", F.max("to").over(group))
    )
    together = (F.col("text_to") - F.col("text_from")) * (200 * shards) <= total
    middle = F.when(together, F.col("text_from") + F.col("text_to")).otherwise(F.col("from") + F.col("to"))
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(2 * max(1, total))))
    placed = saved(line.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), "at"), "placed")
    firsts = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("at").alias("first")).collect()}
    first = _array([firsts.get(k, 0) for k in range(shards)])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.get(first, "shard")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
