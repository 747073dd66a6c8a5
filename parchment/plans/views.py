"""Views of the driver's tables in the shape the operators read; ``SQL`` holds the same views for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchment.tables import BROADCAST_ROWS


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def money(c: str):
    return F.col(c).cast("decimal(18,2)").cast("string")


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Measured results: one row a line of an order."""
    lines = t(spark, sf, "lineitem").join(t(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    n = F.col("l_linenumber")
    name = F.when(F.col("p_type").startswith("ECONOMY"), "ECD").otherwise(F.col("p_type"))
    return lines.select(
        F.col("l_orderkey").alias("request_id"), F.col("l_suppkey").alias("experiment_id"), F.concat(F.lit("S"), n.cast("string")).alias("sample_id"),
        F.when(n % 3 == 0, "12M5C").when(n % 3 == 1, "Day7").otherwise("6M25C").alias("sample_name"), (F.col("l_partkey") % 50).alias("batch_id"), F.col("p_brand").alias("technique"), name.alias("result_name"),
        F.lit(None).cast("string").alias("analyte_name"), n.alias("group_index"), F.when(F.col("l_returnflag") != "R", money("l_extendedprice")).alias("reported_value"), F.lit(None).cast("string").alias("reported_number"),
        money("l_quantity").alias("actual_value"), F.lit(None).cast("string").alias("actual_number"), F.lit("http://qudt.org/vocab/unit/NTU").alias("unit"),
        F.when(F.col("l_linestatus") == "O", "per container").otherwise("per volume").alias("detail_context"), F.col("p_size").alias("size_value"),
    )


def stages(spark: SparkSession, sf: str) -> DataFrame:
    """Batch stages: the lines of an order in a full order of their columns."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    w = Window.partitionBy("l_orderkey").orderBy(*order)
    return t(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("root"), F.row_number().over(w).alias("ord"), F.col("l_quantity").cast("decimal(18,4)").alias("amount"), F.when(F.col("l_returnflag") == "A", F.date_format("l_shipdate", "yyyy-MM-dd")).alias("start_time"),
        F.when(F.col("l_linestatus") == "O", money("l_extendedprice")).alias("density"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).otherwise("").alias("dose_form"),
    )


def pages(spark: SparkSession, sf: str, text: Column | None = None) -> DataFrame:
    """Page texts: a source's documents in order of their id; ``text``: what is taken of a text before texts move.

    Ids are numbered slice by slice and the slices' counts summed up, so that no task sees a whole source; texts join
    their numbers once, which are broadcast where they are few.
    """
    texts = t(spark, sf, "documents").select("doc_id", F.col("text") if text is None else text.alias("text"))
    docs = t(spark, sf, "documents").select("source", "doc_id").withColumn("slice", F.coalesce(F.floor(F.col("doc_id") / 1024), F.lit(-1)))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = docs.groupBy("source", "slice").agg(F.count("*").alias("n")).select(F.col("source").alias("s"), F.col("slice").alias("k"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "slice").orderBy("doc_id")
    numbered = docs.withColumn("n", F.row_number().over(inside)).join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("k")))
    numbers = numbered.select(F.col("doc_id").alias("id"), F.col("source"), (F.col("base") + F.col("n") - 1).cast("int").alias("page_idx"))
    numbers = F.broadcast(numbers) if texts.count() <= BROADCAST_ROWS else numbers
    return texts.join(numbers, F.col("doc_id").eqNullSafe(F.col("id"))).select(F.col("source").alias("doc_id"), "page_idx", "text")


def page_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of pages with captions and references put in."""
    lines = pages(spark, sf).select("doc_id", "page_idx", F.posexplode(F.split("text", "\n")).alias("block_no", "line"))
    p, b = F.col("page_idx").cast("string"), F.col("block_no")
    line = F.when(b % 13 == 5, F.concat("line", F.lit(" see Figure "), p)).otherwise(F.col("line"))
    return lines.select("doc_id", "page_idx", "block_no", F.when(b % 7 == 3, F.concat(F.lit("Figure "), p, F.lit(" — "), line)).when(b % 11 == 4, F.concat(F.lit("Table "), p, F.lit(" — "), line)).when(b % 17 == 6, F.concat(F.lit("a  "), F.substring("line", 1, 12))).otherwise(line).alias("text"))


def outline(spark: SparkSession, sf: str) -> DataFrame:
    """Outline entries made from pages, with a second copy 40 pages on."""
    # blanks stay where letters are picked, so the first three words of what is picked are picked from the first three
    p = pages(spark, sf, F.regexp_replace(F.substring_index("text", " ", 3), r"[^A-Za-z ]", ""))
    k = F.col("page_idx")
    number = F.when(k % 3 == 0, (k / 3 + 1).cast("int").cast("string")).otherwise(F.concat((F.floor(k / 3) + 1).cast("string"), F.lit("."), (k % 3).cast("string")))
    copies = F.array(F.struct((2 * k).alias("ord"), (k + 1).alias("page")), F.struct((2 * k + 1).alias("ord"), (k + 41).alias("page")))
    both = p.select("doc_id", F.when(k % 3 == 0, 1).otherwise(2).alias("level"), F.concat(number, F.lit(" "), "text").alias("title"), F.explode(copies).alias("copy"))
    return both.select("doc_id", "copy.ord", "level", "title", "copy.page")


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes from the first dimensions of the vectors; the label is the page."""
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return t(spark, sf, "embeddings").select(F.lit(1).alias("doc_id"), F.col("label").alias("page_idx"), F.col("vec_id").alias("id"), F.least(e(0), e(2)).alias("x0"), F.least(e(1), e(3)).alias("y0"), F.greatest(e(0), e(2)).alias("x1"), F.greatest(e(1), e(3)).alias("y1"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return t(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("user_id"), status.alias("status"), F.col("o_orderdate").alias("started_at"), F.concat("o_orderpriority", F.col("o_orderkey").cast("string")).alias("title"))


def users(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"))


def versions(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    return t(spark, sf, "conversations").select(F.col("conv_id").alias("run_id"), F.col("role").alias("section_key"), F.row_number().over(w).cast("long").alias("version_num"), F.col("text").alias("html"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "signup", "queued").when(kind.isin("view", "click"), "running").when(kind == "purchase", "complete").otherwise("failed")
    return t(spark, sf, "events").select(F.col("user_id").alias("run_id"), "event_id", status.alias("status"), F.col("ts").cast("timestamp").alias("at"))


SQL = {
    "results": """results AS (SELECT l_orderkey AS request_id, l_suppkey AS experiment_id, 'S' || l_linenumber AS sample_id,
  CASE l_linenumber % 3 WHEN 0 THEN '12M5C' WHEN 1 THEN 'Day7' ELSE '6M25C' END AS sample_name, l_partkey % 50 AS batch_id, p_brand AS technique,
  CASE WHEN starts_with(p_type, 'ECONOMY') THEN 'ECD' ELSE p_type END AS result_name, l_linenumber AS group_index,
  CASE WHEN l_returnflag <> 'R' THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS reported, CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) AS actual,
  CASE WHEN l_linestatus = 'O' THEN 'per container' ELSE 'per volume' END AS detail_context, p_size AS size_value
  FROM lineitem JOIN part ON l_partkey = p_partkey),
sized AS (SELECT *, max(CASE WHEN result_name = 'ECD' THEN size_value END) OVER (PARTITION BY request_id, experiment_id, sample_id, group_index) AS particle_size FROM results),
rows_ AS (SELECT request_id, experiment_id, technique, result_name, sample_id, sample_name, batch_id, detail_context, coalesce(reported, actual) AS reported_value,
  CASE WHEN reported IS NOT NULL THEN 'reported' ELSE 'actual' END AS value_source, 'NTU' AS units, particle_size,
  nullif(regexp_extract(sample_name, '^(Day[0-9]+|[0-9]+M)'), '') AS timepoint, nullif(regexp_extract(sample_name, '[0-9]+C$'), '') AS storage FROM sized WHERE result_name <> 'ECD')""",
    "stages": """stages AS (SELECT l_orderkey AS root, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS ord,
  CAST(l_quantity AS DECIMAL(18,4)) AS amount, CASE WHEN l_returnflag = 'A' THEN strftime(l_shipdate, '%Y-%m-%d') END AS start_time,
  CASE WHEN l_linestatus = 'O' THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS density, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE '' END AS dose_form FROM lineitem)""",
    "pages": "page_text AS (SELECT source AS doc_id, row_number() OVER (PARTITION BY source ORDER BY documents.doc_id) - 1 AS page_idx, text FROM documents)",
    "lines": """page_text AS (SELECT source AS doc_id, row_number() OVER (PARTITION BY source ORDER BY documents.doc_id) - 1 AS page_idx, text FROM documents),
split_lines AS (SELECT doc_id, page_idx, unnest(range(len(l))) AS block_no, unnest(l) AS line FROM (SELECT doc_id, page_idx, string_split(text, chr(10)) AS l FROM page_text)),
seen AS (SELECT doc_id, page_idx, block_no, line, CASE WHEN block_no % 13 = 5 THEN line || ' see Figure ' || page_idx ELSE line END AS l2 FROM split_lines),
page_lines AS (SELECT doc_id, page_idx, block_no, CASE WHEN block_no % 7 = 3 THEN 'Figure ' || page_idx || ' — ' || l2 WHEN block_no % 11 = 4 THEN 'Table ' || page_idx || ' — ' || l2
  WHEN block_no % 17 = 6 THEN 'a  ' || substring(line, 1, 12) ELSE l2 END AS text FROM seen)""",
    "outline": """page_text AS (SELECT source AS doc_id, row_number() OVER (PARTITION BY source ORDER BY documents.doc_id) - 1 AS page_idx, text FROM documents),
entries AS (SELECT doc_id, 2 * page_idx AS ord, CASE WHEN page_idx % 3 = 0 THEN 1 ELSE 2 END AS level,
  (page_idx // 3 + 1) || CASE WHEN page_idx % 3 = 0 THEN '' ELSE '.' || (page_idx % 3) END || ' ' || array_to_string(string_split(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' ')[1:3], ' ') AS title, page_idx + 1 AS page FROM page_text),
outline AS (SELECT * FROM entries UNION ALL SELECT doc_id, ord + 1, level, title, page + 40 FROM entries)""",
    "boxes": """boxes AS (SELECT label AS page_idx, vec_id AS id, least(a, c) AS x0, least(b, d) AS y0, greatest(a, c) AS x1, greatest(b, d) AS y1 FROM
  (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS d FROM embeddings))""",
    "versions": "versions AS (SELECT conv_id AS run_id, role AS section_key, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS version_num, text AS html FROM conversations)",
    "events": """run_events AS (SELECT user_id AS run_id, event_id, CASE WHEN event_type = 'signup' THEN 'queued' WHEN event_type IN ('view', 'click') THEN 'running' WHEN event_type = 'purchase' THEN 'complete' ELSE 'failed' END AS status, ts AS ev_at FROM events)""",
}
