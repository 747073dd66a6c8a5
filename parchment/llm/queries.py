"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    return shard_by_bytes(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import similar_groups

    return similar_groups(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_best_fit

    rows = pack_best_fit(_table(spark, sf_dir, "documents"))
    return rows.select("sequence_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"))


def op10_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import pack_mixture

    pieces = pack_mixture(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import link_vectors

    return link_vectors(_table(spark, sf_dir, "embeddings")).drop("compared")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .contamination import hit_columns, scan_documents

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = hit_columns(scan_documents(docs, _table(spark, sf_dir, "benchmark")))
    listed = F.array_join(F.sort_array("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), "contaminated")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    found = score(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", F.col("toxicity").alias("score"), F.col("toxic").alias("predicted"))


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import example_tools, format_tool_calls, turns_as_calls

    messages = turns_as_calls(_table(spark, sf_dir, "conversations"))
    return format_tool_calls(messages, example_tools(messages))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify, training_sample

    docs = _table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), training_sample(docs))
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align_documents

    return align_documents(_table(spark, sf_dir, "documents"))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_products

    return top_products(_table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit_filters

    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_ngram_jaccard, op3_best_fit_packing, op4_warc, op5_embedding_near_dedup, op6_benchmark_decontamination, op7_toxicity, op8_tool_calls, op9_language_id, op10_mixture_packing, op11_tokenizer_alignment, op12_exact_top_k, op13_filter_audit)}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_REACH = """r(x, y) AS (SELECT x, x FROM nodes UNION SELECT r.x, l.y FROM r JOIN links l ON l.x = r.y)"""
ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)), nodes AS (SELECT doc_id AS x FROM documents), {_REACH}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS m FROM r GROUP BY 1) USING (doc_id)""",
    "op4_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda k: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substring(x, CAST(5 * i + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * k AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '')), '') AS payload_digest,
CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f <> page_id THEN f END AS refers_to FROM d""",
    "op5_embedding_near_dedup": f"""WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
g AS (SELECT *, sqrt(list_dot_product(v, v)) AS z FROM e), links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.z > 0 AND b.z > 0 AND list_dot_product(a.v, b.v) / a.z / b.z >= 0.93),
nodes AS (SELECT vec_id AS x FROM embeddings), {_REACH}, k AS (SELECT x, count(*) AS n FROM links GROUP BY 1), m AS (SELECT x, min(y) AS c FROM r GROUP BY 1)
SELECT m.x AS vec_id, coalesce(n, 0) AS n_links, c AS component_id, m.x = c AS kept, CAST(1 AS DOUBLE) AS recall FROM m LEFT JOIN k ON k.x = m.x""",
    "op6_benchmark_decontamination": f"""WITH iw AS (SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT item_id, least(13, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS g FROM iw WHERE len(w) > 0),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents), ks AS (SELECT DISTINCT k FROM win),
dg AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM dw, ks WHERE len(w) >= k),
h AS (SELECT doc_id, i, dg.k, item_id FROM dg JOIN win ON dg.k = win.k AND dg.g = win.g), pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM h), n AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM h GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op8_tool_calls": """WITH c AS (SELECT a.conv_id, a.turn, a.role, a.text, row_number() OVER (PARTITION BY a.conv_id ORDER BY a.turn) - 1 AS position, n.role AS after_role, p.role AS before_role
FROM conversations a LEFT JOIN conversations n ON n.conv_id = a.conv_id AND n.turn = a.turn + 1 LEFT JOIN conversations p ON p.conv_id = a.conv_id AND p.turn = a.turn - 1),
k AS (SELECT *, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'text' END AS kind, CASE role WHEN 'user' THEN 'call-' || conv_id || '-' || turn WHEN 'assistant' THEN 'call-' || conv_id || '-' || (turn - 1) END AS call_id,
 CASE WHEN role = 'user' THEN CASE WHEN length(text) < 150 THEN 'search' ELSE 'summarise' END END AS name,
 CASE role WHEN 'user' THEN CASE WHEN after_role = 'assistant' THEN 'linked' ELSE 'unanswered' END WHEN 'assistant' THEN CASE WHEN before_role = 'user' THEN 'linked' ELSE 'orphan' END ELSE 'text' END AS status FROM c)
SELECT conv_id, position, kind, call_id, status, CASE WHEN name = 'summarise' THEN ['type: length'] ELSE CAST([] AS VARCHAR[]) END AS errors,
'{' || CASE name WHEN 'search' THEN '"arguments":{"limit":' || (turn + 1) || ',"text":' || CAST(to_json(text) AS VARCHAR) || '},' WHEN 'summarise' THEN '"arguments":{"length":"' || length(text) || '","text":' || CAST(to_json(text) AS VARCHAR) || '},' ELSE '' END
 || CASE WHEN call_id IS NULL THEN '' ELSE '"call_id":"' || call_id || '",' END || CASE WHEN name IS NULL AND text IS NOT NULL THEN '"content":' || CAST(to_json(text) AS VARCHAR) || ',' ELSE '' END || CASE WHEN name = 'summarise' THEN '"errors":["type: length"],' ELSE '' END
 || '"kind":"' || kind || '",' || CASE WHEN name IS NULL THEN '' ELSE '"name":"' || name || '",' END || '"position":' || position || ',"role":"' || role || '","status":"' || status || '"}' AS json FROM k""",
    "op12_exact_top_k": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), n AS (SELECT row_number() OVER () AS k, * FROM e),
s AS (SELECT q.k, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM n q JOIN n c ON q.k <> c.k WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id ASC NULLS LAST) AS INTEGER) AS rank FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op13_filter_audit": f"""WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS f FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') AS w FROM t),
m AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * (length(x) - length(translate(x, '{_UPPER}', ''))) > 2 * length(x))::INT
 + 8 * regexp_matches(x, '[#$%&*|]')::INT + 16 * coalesce(f < doc_id OR (doc_id IS NULL AND f IS NOT NULL), false)::INT AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
p(prefix, applied, bit) AS (SELECT '', 0, 0 UNION ALL SELECT p.prefix || l.letter, p.applied | l.bit, l.bit FROM p JOIN letters l ON (p.applied & l.bit) = 0),
s AS (SELECT part, prefix, sum(CASE WHEN mask & applied = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN here AND fails THEN n ELSE 0 END) AS removed, sum(CASE WHEN NOT here AND fails THEN n ELSE 0 END) AS redundant,
 sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN here AND fails THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN here AND fails THEN toxic ELSE 0 END) AS toxic_lost
 FROM (SELECT *, (mask & (applied - bit)) = 0 AS here, (mask & bit) <> 0 AS fails FROM p, c WHERE bit > 0) GROUP BY 1, 2),
o AS (SELECT prefix AS filter_order, unnest(range(1, 6)) AS step FROM p WHERE length(prefix) = 5)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
 CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, right(prefix, 1)) AS BIGINT) AS shapley FROM o JOIN s ON s.prefix = left(filter_order, CAST(step AS INTEGER))""",
}
