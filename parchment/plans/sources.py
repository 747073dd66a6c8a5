"""Queries of sources and sinks: a given table is written in their form and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.sources import warehouse as W
from parchment.tables import new_path

from . import views as V


def warehouse_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A1."""
    return W.scan_warehouse(spark, sf, "customer").filter("c_nationkey > 5").select("c_custkey", "c_name", "c_nationkey")


def captured_packs(spark: SparkSession, sf: str) -> DataFrame:
    """A2: the customers and orders of a nation are one pack of a row a line; a relation that no pack has is empty."""
    c = V.t(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_name", "c_acctbal")
    o = V.t(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    head, tail = (c.select("c_nationkey").distinct().select("c_nationkey", F.lit(k).alias("part"), F.lit(0).cast("long").alias("no"), F.lit(text).alias("value")) for k, text in ((0, '{"customers": [null'), (4, "]}")))
    middle = head.select("c_nationkey", F.lit(2).alias("part"), "no", F.lit('], "orders": [null').alias("value"))
    rows = lambda df, k, no: df.select("c_nationkey", F.lit(k).alias("part"), F.col(no).cast("long").alias("no"), F.concat(F.lit(", "), F.to_json(F.struct(*df.columns[1:]))).alias("value"))
    lines = head.unionByName(middle).unionByName(tail).unionByName(rows(c, 1, "c_custkey")).unionByName(rows(o, 3, "o_orderkey"))
    path = new_path(spark, "packs")
    lines.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "part", "no").select("c_nationkey", "value").write.partitionBy("c_nationkey").option("compression", "none").text(path)
    pack = W.scan_pack(spark, path, {"customers": "c_custkey long, c_name string, c_acctbal double", "orders": "o_orderkey long, o_orderstatus string, o_totalprice double", "lots": "id long, name string, value double"})
    one = lambda name: pack[name].toDF("id", "name", "value").select(F.lit(name).alias("relation"), "id", "name", "value")
    return one("customers").unionByName(one("orders")).unionByName(one("lots"))


def _text_files(spark: SparkSession, sf: str) -> str:
    """Documents as text files, a folder for each language."""
    path = new_path(spark, "texts")
    V.t(spark, sf, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("lang").option("compression", "none").text(path)
    return path


def object_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """A3: bytes of the files of each language."""
    files = W.scan_objects(spark, _text_files(spark, sf), "txt")
    return files.groupBy(F.regexp_extract("key", "/lang=([^/]+)/", 1).alias("lang")).agg(F.sum("size").alias("size"), F.sum(F.length("bytes").cast("long")).alias("n_bytes"))


def media_texts(spark: SparkSession, sf: str) -> DataFrame:
    """A4: lines and characters of the files of each language, each read whole."""
    files = W.scan_text_media(spark, _text_files(spark, sf) + "/*")
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return files.groupBy(F.regexp_extract("key", "/lang=([^/]+)/", 1).alias("lang")).agg(F.sum(F.length("text").cast("long")).alias("n_chars"), F.sum(lines.cast("long")).alias("n_lines"))


def admitted_files(spark: SparkSession, sf: str) -> DataFrame:
    """A5: parts as files with their type as extension; the sizes are in MB."""
    name = F.concat("p_name", F.lit("."), "p_type")
    ok, bad = W.admit_files(V.t(spark, sf, "part").select("p_partkey", name.alias("filename"), (F.col("p_size").cast("long") - 1) * (1 << 20)).toDF("p_partkey", "filename", "size"), ["economy", "promo", "standard"], max_mb=30)
    return ok.select("p_partkey", F.lit("admitted").alias("verdict")).unionByName(bad.select("p_partkey", F.col("reason").alias("verdict")))


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot of every run, those of open orders written after the others at the same place."""
    path, o = new_path(spark, "snapshot"), V.t(spark, sf, "orders").select((F.col("o_custkey") % 7).alias("run_id"), "o_orderkey", "o_orderstatus")
    for keep in ("run_id < 4", "run_id >= 4", "run_id = 2"):
        W.write_snapshot({"orders": o.filter(keep)}, path)
    return W.read_snapshot(spark, path, ["orders"])["orders"].select(F.col("run_id").cast("long").alias("run_id"), "o_orderkey", "o_orderstatus")


def audit_log(spark: SparkSession, sf: str) -> DataFrame:
    """One record an order, appended in two goes."""
    path, o = new_path(spark, "audit"), V.t(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("what"), "o_orderstatus")
    for status in ("o_orderstatus = 'O'", "o_orderstatus <> 'O'"):
        W.write_audit(o.filter(status), path)
    return spark.read.schema("o_orderkey long, what string, o_orderstatus string").json(path)


QUERIES = {f.__name__: f for f in (warehouse_rows, captured_packs, object_sizes, media_texts, admitted_files, snapshots, audit_log)}
_TEXTS = "SELECT coalesce(lang, 'none') AS lang, coalesce(text, '') AS x FROM documents"
ORACLE_SQL = {
    "warehouse_rows": "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey > 5",
    "captured_packs": "SELECT 'customers' AS relation, CAST(c_custkey AS BIGINT) AS id, c_name AS name, CAST(c_acctbal AS DOUBLE) AS value FROM customer UNION ALL SELECT 'orders', CAST(o_orderkey AS BIGINT), o_orderstatus, CAST(o_totalprice AS DOUBLE) FROM orders JOIN customer ON c_custkey = o_custkey",
    "object_sizes": f"SELECT lang, CAST(sum(octet_length(encode(x)) + 1) AS BIGINT) AS size, CAST(sum(octet_length(encode(x)) + 1) AS BIGINT) AS n_bytes FROM ({_TEXTS}) GROUP BY 1",
    "media_texts": f"SELECT lang, CAST(sum(length(x) + 1) AS BIGINT) AS n_chars, CAST(sum(length(x) - length(replace(x, chr(10), '')) + 1) AS BIGINT) AS n_lines FROM ({_TEXTS}) GROUP BY 1",
    "admitted_files": "SELECT p_partkey, CASE WHEN p_type NOT IN ('ECONOMY', 'PROMO', 'STANDARD') THEN 'extension' WHEN p_size - 1 > 30 THEN 'size' WHEN p_size <= 1 OR p_size IS NULL THEN 'empty' ELSE 'admitted' END AS verdict FROM part",
    "snapshots": "SELECT CAST(o_custkey % 7 AS BIGINT) AS run_id, o_orderkey, o_orderstatus FROM orders",
    "audit_log": "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderpriority AS what, o_orderstatus FROM orders",
}
