"""Scans, snapshots and audit sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pack import scan_pack

__all__ = ["admit_files", "extension", "lower_columns", "read_snapshot", "scan_objects", "scan_pack", "scan_text_media", "scan_warehouse", "write_audit", "write_snapshot"]


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def scan_warehouse(spark: SparkSession, source: str, table: str, partition: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """A1. A relation, read-only, with lower-cased columns.

    ``source`` is a JDBC address (split by ``partition``: column, low, high, parts) or a folder of parquet
    tables.  Filters and columns reach the source either way.
    """
    if source.startswith("jdbc:"):
        reader = spark.read.format("jdbc").option("url", source).option("dbtable", table).options(**options)
        if partition:
            for name, value in zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), partition):
                reader = reader.option(name, value)
        return lower_columns(reader.load())
    return lower_columns(spark.read.parquet(f"{source}/{table}.parquet"))


def scan_objects(spark: SparkSession, path: str, ext: str | None = None) -> DataFrame:
    """A3. Files as rows: key, bytes, size; only the wanted extension."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if ext:
        reader = reader.option("pathGlobFilter", f"*.{ext.lstrip('.')}")
    return reader.load(path).select(F.col("path").alias("key"), F.col("content").alias("bytes"), F.col("length").alias("size"))


def scan_text_media(spark: SparkSession, path: str) -> DataFrame:
    """A4. Whole documents as text; bytes that aren't UTF-8 are replaced."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.col("path").alias("key"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"(\.[^./\\]+)$", 1))


def admit_files(files: DataFrame, accepts: list[str], max_mb: int = 200) -> tuple[DataFrame, DataFrame]:
    """A5. (files of an accepted extension under the size ceiling, the others with the reason)."""
    kinds = [f".{a.lower().lstrip('.')}" for a in accepts]
    reason = F.when(~extension(F.col("filename")).isin(*kinds), "extension").when(F.col("size") > max_mb * (1 << 20), "size").when(F.col("size").isNull() | (F.col("size") <= 0), "empty")
    marked = files.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def write_snapshot(pack: dict[str, DataFrame], path: str) -> None:
    """A6. Every relation of a pack as parquet by run, so that a rebuild queries nothing again; other runs' rows at the path stay."""
    for name, df in pack.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/{name}")


def read_snapshot(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def write_audit(records: DataFrame, path: str) -> None:
    """A7. Append one JSON record a generation."""
    records.write.mode("append").json(path)
