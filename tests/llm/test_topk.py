import math

import numpy as np
import pytest

import parchment.llm.topk as T

VEC = "vec_id long, embedding array<double>"


def expected(rows, k=5):
    """(query_id, rank, vec_id, score) with whole numbers of any size."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(kept):
        if i is not None and i % 50 == 0:
            found = sorted((-min(2**63 - 1, max(-(2**63), sum(a * b for a, b in zip(q, v)))), j is None, j or 0) for m, (j, v) in enumerate(kept) if m != n)[:k]
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(found)]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()), key=repr)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (50, [-0.3, 0.7]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0]), (6, [1.0, 0.0]), (-50, []), (8, [2.0]), (9, [0.5, 0.5, 9.0])]
    assert found(T.top_products(spark.createDataFrame(rows, VEC).repartition(3))) == expected(rows)


def test_components_of_any_size(spark):
    rows = [(50 * k, [v, 1.0]) for k, v in enumerate((3e7, -3e7, 1e20, 2.5e8, 0.25))] + [(k, [float(k) * 1e6, -2.0]) for k in range(1, 40)]
    assert found(T.top_products(spark.createDataFrame(rows, VEC))) == expected(rows)


@pytest.mark.parametrize("width", [1, 16, 40])
def test_shards_groups_and_blocks(spark, monkeypatch, width):
    """Several shards, groups and blocks; equal vectors tie beyond the fifth place."""
    for name, value in (("SHARD_BYTES", 3000 * width), ("GROUP_BYTES", 90 * width), ("LEAST", 50), ("PILOT", 60), ("QUERIES", 8), ("CANDIDATES", 64)):
        monkeypatch.setattr(T, name, value)
    r = np.random.default_rng(width)
    base = r.normal(size=(60, width))
    rows = [(k, [float(x) for x in base[k % 60] + (r.normal(size=width) * 0.1 if k % 4 else 0)]) for k in range(1500)]
    assert found(T.top_products(spark.createDataFrame(rows, VEC).repartition(4))) == expected(rows)


def test_most_sums_are_given_up(monkeypatch):
    """Beyond the first block of dimensions only a part of the pairs is left."""
    seen = []
    real = T.np.nonzero
    monkeypatch.setattr(T.np, "nonzero", lambda x: (seen.append((x.sum(), x.size)), real(x))[1])
    r = np.random.default_rng(5)
    base = r.normal(size=(200, 64)) * 40
    x = np.floor(np.repeat(base, 20, axis=0) + r.normal(size=(4000, 64)) * 3).T
    best = [T.Best(5, None) for _ in range(10)]
    T.search_shard(x[:, :200:20], list(range(0, 200, 20)), x[:, :2000], np.arange(2000), list(range(2000)), best)
    seen.clear()
    T.search_shard(x[:, :200:20], list(range(0, 200, 20)), x[:, 2000:], np.arange(2000, 4000), list(range(2000, 4000)), best)
    assert seen and sum(n for n, _ in seen) < 0.2 * sum(m for _, m in seen)


def test_empty_table_and_clashing_columns(spark):
    assert T.top_products(spark.createDataFrame([], VEC)).count() == 0
    df = spark.createDataFrame([(0, [1.0], 5, "v", 1.0), (1, [2.0], None, None, None)], f"{VEC}, uid long, v string, score double")
    assert found(T.top_products(df)) == [(0, 1, 1, 131072)]


def test_same_as_sql(spark, same_as_sql):
    same_as_sql("op12_exact_top_k")
