import random

import pytest

import parchment.operators.graph as G
import parchment.tables as S
from parchment.llm.graph import merged


def expected(edges):
    up = {}

    def find(k):
        while up.setdefault(k, k) != k:
            k = up[k]
        return k

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {k: find(k) for k in up}


def given(df):
    rows = df.collect()
    out = {r.node: r.component for r in rows}
    assert len(out) == len(rows)
    return out


def shapes(seed):
    r = random.Random(seed)
    chain = [(k, k + 1) for k in range(100, 160)]
    stars = [(1000, k) for k in range(200, 280)] + [(300, k) for k in range(301, 380)]
    loose = [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(150)]
    return chain + stars + loose + chain[:5] + [(7, 7), (-3, 5)] + [(b, a) for a, b in chain[:9]]


@pytest.mark.parametrize("small, rows", [(16_384, 100_000), (10, 100_000), (3, 0)])
def test_components(spark, monkeypatch, small, rows):
    """Finished at once, by contraction, and with joins that aren't broadcast."""
    monkeypatch.setattr(G, "SMALL", small)
    monkeypatch.setattr(S, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(S, "HEAVY", 20)
    edges = shapes(small)
    assert given(G.components(spark.createDataFrame(edges, "a long, b long"))) == expected(edges)


def test_only_new_edges_are_added(spark, monkeypatch):
    monkeypatch.setattr(G, "SMALL", 20)
    edges = shapes(5)
    random.Random(2).shuffle(edges)
    labels = None
    for at in range(0, len(edges), 150):
        labels = merged(labels, spark.createDataFrame(edges[at : at + 150], "a long, b long"))
    assert given(labels) == expected(edges)


def test_no_edges(spark):
    assert given(G.components(spark.createDataFrame([(1, 1)], "a long, b long"))) == {}
    assert given(G.components(spark.createDataFrame([], "a long, b long"))) == {}


@pytest.mark.parametrize("rows", [0, 100])
def test_spread_join(spark, monkeypatch, rows):
    monkeypatch.setattr(S, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(S, "HEAVY", 4)
    left = [(k, 1 if k % 3 else k) for k in range(60)] + [(99, None)]
    df = S.spread_join(S.saved(spark.createDataFrame(left, "uid long, key long"), "left"), spark.createDataFrame([(1, "one"), (3, "three")], "key long, name string"), ["key"])
    assert sorted((r.uid, r.name) for r in df.collect()) == sorted((u, {1: "one", 3: "three"}.get(k)) for u, k in left)
