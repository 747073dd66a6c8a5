"""Components of links that arrive in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.operators.graph import components
from parchment.tables import saved, spread_join


def merged(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """The components once ``edges`` are added to those of ``labels`` (node, component; the component is its smallest node).

    Only the new edges are worked on, between the components of their ends.
    """
    if labels is None:
        return components(edges)
    moved = edges.select("a", "b")
    for c in ("a", "b"):
        moved = saved(spread_join(moved, labels.select(F.col("node").alias(c), "component"), [c]).withColumn(c, F.coalesce("component", c)).drop("component"), "moved")
    new = components(moved)
    kept = spread_join(labels, new.select(F.col("node").alias("component"), F.col("component").alias("low")), ["component"])
    kept = kept.select("node", F.coalesce("low", "component").alias("component"))
    return saved(kept.unionByName(new.join(labels.select("node"), "node", "left_anti")), "components")
