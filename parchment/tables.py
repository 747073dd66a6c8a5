"""Tables that cut lineage, in the folder all executors share, and joins that no key can crowd."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that is broadcast at most; share of all rows from which a key is joined by broadcast.
BROADCAST_ROWS, HEAVY = 100_000, 1000
_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, a local session (tests) gets a local folder, a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="parchment-")
        spark.sparkContext.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later passes and lost executors reread files.

    While it is written, Arrow batches hold ``BATCH_ROWS`` rows at most, as whole texts are long; the session's setting is put back.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_BATCH)
    try:
        spark.conf.set(_BATCH, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """A saved table of a few numbers a row, broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def spread_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` (a saved table) with the columns of ``right``, which has one row for each of the keys; without one, nulls.

    A small right side is broadcast.  Otherwise keys with over a thousandth of the left rows, at most ``HEAVY`` of
    them, are joined by broadcast and the others by shuffle, so no key gathers its rows in one task.
    """
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), keys, "left")
    most = left.count() / HEAVY
    heavy = saved(left.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > most).select(*keys), "heavy-keys")
    if heavy.isEmpty():
        return left.join(right, keys, "left")
    hot = left.join(F.broadcast(heavy), keys, "left_semi").join(F.broadcast(right.join(F.broadcast(heavy), keys, "left_semi")), keys, "left")
    return left.join(F.broadcast(heavy), keys, "left_anti").join(right, keys, "left").unionByName(hot)
