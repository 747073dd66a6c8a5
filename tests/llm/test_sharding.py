import zlib
from collections import defaultdict

from parchment.llm.sharding import shard_by_bytes

SCHEMA = "doc_id long, text string"


def check(rows, out, shards):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in out) == sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in out:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(shards)) and {r.law for r in out} <= {"bytes"}
    return [sizes[k] for k in range(shards)]


def test_sizes_are_near_equal_with_a_hot_text(spark):
    rows = [(k, f"text {k} " * (k % 50 + 1)) for k in range(3000)] + [(9000 + k, "hot " * 40) for k in range(2000)]
    out = shard_by_bytes(spark.createDataFrame(rows, SCHEMA).repartition(3), 8).collect()
    sizes = check(rows, out, 8)
    assert max(sizes) - min(sizes) < 0.03 * sum(sizes) / 8


def test_equal_texts_share_a_shard(spark):
    rows = [(k, f"text {k // 3} " * 5) for k in range(6000)]
    out = shard_by_bytes(spark.createDataFrame(rows, SCHEMA), 8).collect()
    check(rows, out, 8)
    shards = defaultdict(set)
    for r in out:
        shards[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def test_nulls_repeats_and_empty(spark):
    rows = [(1, None), (2, ""), (2, ""), (4, "é" * 10_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as shard", "1 as size")
    check(rows, shard_by_bytes(df, 3).collect(), 3)
    none = spark.createDataFrame([(None, "a"), (None, None)], SCHEMA)
    assert shard_by_bytes(none, 2).count() == 2
    assert shard_by_bytes(spark.createDataFrame([], SCHEMA), 8).collect() == []


def test_one_long_record_and_all_equal(spark):
    rows = [(k, "same") for k in range(500)]
    sizes = check(rows, shard_by_bytes(spark.createDataFrame(rows, SCHEMA), 8).collect(), 8)
    assert max(sizes) - min(sizes) <= 10


def test_query(spark, sf):
    from parchment.llm.queries import QUERIES

    out = QUERIES["op1_sharding"](spark, sf).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, out, 8)
