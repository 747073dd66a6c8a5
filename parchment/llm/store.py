"""Helpers of the operators over whole texts; tables that cut lineage are those of ``parchment.tables``."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from parchment.tables import new_path, saved, shared_dir, small, spread_join

__all__ = ["extended", "new_path", "saved", "shared_dir", "slices", "small", "spread_join", "wide"]


def wide(spark: SparkSession, least: int = 1) -> int:
    """Number of shuffle partitions of the session, as an explicit ``repartition`` count."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def extended(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` with more columns."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to ``rows``: whole texts are long, and what a worker makes of them may be longer."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
