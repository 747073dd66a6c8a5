"""Connected components on tables, by contracting the edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.tables import saved, spread_join

#: Edges that one task finishes; more are contracted first.
SMALL = 16_384


def _finish(keys: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The smallest node that each node of a few edges reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[tuple, tuple] = {}

        def find(k: tuple) -> tuple:
            while up.setdefault(k, k) != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        kinds = {}
        for batch in batches:
            kinds = {c: batch.schema.field(c).type for c in keys}
            of = list(zip(*(batch.column(c).to_pylist() for c in keys))) if keys else [()] * batch.num_rows
            for key, a, b in zip(of, batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = find((*key, a)), find((*key, b))
                up[max(a, b, key=lambda x: x[-1])] = min(a, b, key=lambda x: x[-1])
        if up:
            nodes = list(up)
            columns = [pa.array([n[k] for n in nodes], kinds[c]) for k, c in enumerate(keys)]
            yield pa.record_batch([*columns, pa.array([n[-1] for n in nodes], pa.int64()), pa.array([find(n)[-1] for n in nodes], pa.int64())], names=[*keys, "node", "component"])

    return run


def _pairs(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    return edges.filter("a <> b").select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, node, component): the smallest node that each node of ``edges`` (a, b: long) reaches, within the keys.

    Nodes without an edge to another node have no row; keys aren't null.  In each round a node joins the neighbour
    that a hash puts first, if that is before itself; edges become edges between what was joined, without loops and
    repeats, and only these go on.  Any edge's later node joins another, so about half of the nodes are left at most
    and the rows fall geometrically.  The last ``SMALL`` edges are finished in one task; then the rounds are read
    backwards.
    """
    keys = list(keys)
    left, rounds = saved(_pairs(edges.select(*keys, F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), keys), "edges"), []
    while left.count() > SMALL:
        place = lambda c, k=len(rounds): F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("node"))
        near = left.unionByName(left.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(*keys, F.col("a").alias("node")).agg(F.min_by("b", place("b")).alias("near"))
        first = F.when(place("near") < place("node"), F.col("near")).otherwise(F.col("node"))
        up = saved(near.select(*keys, "node", first.alias("up")), "joined")
        rounds.append(up)
        for c in ("a", "b"):
            left = saved(spread_join(left, up.select(*keys, F.col("node").alias(c), F.col("up").alias("to")), [*keys, c]).withColumn(c, F.coalesce("to", c)).drop("to"), "moved")
        left = saved(_pairs(left, keys), "edges")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema.fields if f.name in keys)
    labels = saved(left.coalesce(1).mapInArrow(_finish(keys), f"{kinds}{', ' if keys else ''}node long, component long"), "labels")
    if not rounds:
        return labels
    for up in reversed(rounds):
        of = spread_join(up, labels.select(*keys, F.col("node").alias("up"), "component"), [*keys, "up"])
        labels = saved(of.select(*keys, "node", F.coalesce("component", "up").alias("component")), "labels")
    lowest = saved(labels.groupBy(*keys, "component").agg(F.min("node").alias("low")), "lowest")
    return saved(spread_join(labels, lowest, [*keys, "component"]).select(*keys, "node", F.col("low").alias("component")), "labels")
