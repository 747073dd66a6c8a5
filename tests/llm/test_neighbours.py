import numpy as np
import pytest

import parchment.llm.neighbours as N

VEC = "vec_id long, embedding array<double>, label int"


def made(n, width=16, seed=3, spread=0.1, centres=30):
    r = np.random.default_rng(seed)
    base = r.normal(size=(centres, width))
    return [(k, [float(x) for x in base[k % centres] + r.normal(size=width) * (spread if k % 3 else 0.6)], 0) for k in range(n)]


def truth(rows, threshold=0.93):
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= threshold
    np.fill_diagonal(link, False)
    return link.sum(1)


def found(spark, rows):
    return {r.vec_id: r for r in N.link_vectors(spark.createDataFrame(rows, VEC).repartition(3)).collect()}


def test_cosines_of_any_size_are_in_double_precision(spark):
    rows = [(1, [1e-60, 2e-60], 0), (2, [1e-60, 2e-60], 0), (3, [1e200, 1e200], 0), (4, [1e200, 1.0000000001e200], 0), (5, [2e-60, 4e-60], 0), (6, [-1.0, 0.0], 0), (7, [-1.0, -0.0], 0)]
    out = found(spark, rows)
    assert {k: (r.n_links, r.component_id) for k, r in out.items()} == {**dict.fromkeys(range(1, 6), (4, 1)), 6: (1, 6), 7: (1, 6)}


def test_divided_clusters(spark, monkeypatch):
    """Two centroids for all, so that their clusters are divided by centroids of their own."""
    for name, value in (("BLOCK", 128), ("SHARD", 40), ("CENTROIDS", 2)):
        monkeypatch.setattr(N, name, value)
    rows = made(1200)
    out, n = found(spark, rows), truth(rows)
    got = np.array([out[k].n_links for k, *_ in rows])
    assert (got <= n).all() and got.sum() >= 0.9 * n.sum()
    assert out[0].recall >= 0.9


def test_all_are_compared_where_recall_stays_low(spark, monkeypatch):
    for name, value in (("OVERLAPS", (1,)), ("RECALL", 2.0), ("LEAST", 1.1), ("SHARD", 20), ("BLOCK", 100)):
        monkeypatch.setattr(N, name, value)
    rows = made(500, spread=0.2)
    out = found(spark, rows)
    assert [out[k].n_links for k, *_ in rows] == truth(rows).tolist()


@pytest.mark.parametrize("copies", [1, 40])
def test_the_walk_computes_a_part_of_the_distances(copies):
    """Fewer a query in proportion as a shard grows; hot neighbourhoods are seen whole."""
    share = {}
    for n in (500, 2000):
        r = np.random.default_rng(1)
        base = np.repeat(r.normal(size=(n // copies, 24)), copies, axis=0)
        x = base + r.normal(size=base.shape) * 0.05
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        lists = N.robust_prune(x @ x.T, np.random.default_rng(2))
        width = max(map(len, lists))
        adjacency = np.array([own + [i] * (width - len(own)) for i, own in enumerate(lists)])
        sims, computed = N.range_search(x, x, adjacency, int((x @ x.mean(0)).argmax()), 0.93)
        true = x @ x.T >= 0.93
        assert ((sims >= 0.93) <= true).all() and (sims >= 0.93).sum() >= 0.95 * true.sum()
        share[n] = computed / n / n
    assert share[2000] < 0.6 * share[500] and share[2000] < 0.5


def test_audited_queries_dont_depend_on_what_was_found(spark):
    """A search that found nothing has a recall of 0, as the audit draws vectors with links by comparing blocks."""
    rows = made(600)
    vectors, kind = N.usable(spark.createDataFrame(rows, VEC))
    points = vectors.selectExpr("uid", "shelf", "v", "1L as weight")
    placed = points.selectExpr("*", "array(concat(shelf, '/', uid % 2)) as shards")
    none = spark.createDataFrame([], "uid long, n long")
    drawn = {r.uid for r in N._linked_sample(placed, 0.93, kind).collect()}
    has = dict(zip((k for k, *_ in rows), truth(rows)))
    linked = {r.uid for r in vectors.collect() if has[r.vec_id]}
    assert drawn and drawn <= linked
    assert N._audit(points, placed, none, 0.93, kind) == 0.0
