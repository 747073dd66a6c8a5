"""Exact search of the highest inner products by columnar branch and bound.

Vectors lie in shards, a dimension a row.  A block of queries adds up its products one block of dimensions after
another, those with the largest mass first; after each, a candidate whose sum and remaining mass (the product of
what is left of both norms) can't reach the query's k-th score so far is given up, and the others are moved together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import saved, wide

#: Scores a query; queries are the rows whose id this number divides; factor of the components.
K, EVERY, SCALE = 5, 50, 256
#: Bytes of a shard's and of a query group's vectors; rows of a shard at least, while there are too few tasks; rows of the pilot.
SHARD_BYTES, GROUP_BYTES, LEAST, PILOT = 64_000_000, 16_000_000, 1024, 4096
#: Dimensions of a block; queries and candidates that meet at once; share of pairs left below which they are moved together.
DIMENSIONS, QUERIES, CANDIDATES, DENSE = 16, 64, 8192, 0.2
#: Sums of products below this are exact in double precision.
EXACT = 2.0**52
_ROW = "uid long, vec_id long, wide boolean, v binary"
_FOUND = "query_uid long, query_id long, vec_id long, score long"


def _quantise(scale: int):
    """floor(scale * x) of vectors without null or non-finite components, as 32-bit integers, or doubles where they don't fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uids, ids, wides, out = [], [], [], []
            lists = b.column("embedding")
            for uid, vec_id, x in zip(b.column("uid").to_pylist(), b.column("vec_id").to_pylist(), lists):
                if not x.is_valid or x.values.null_count:
                    continue
                v = x.values.to_numpy(zero_copy_only=False).astype("f8")
                if not np.isfinite(v).all():
                    continue
                with np.errstate(over="ignore"):
                    v = np.clip(np.floor(scale * v), -np.finfo("f8").max, np.finfo("f8").max)
                large = bool(len(v)) and np.abs(v).max() >= 2**31
                uids.append(uid)
                ids.append(vec_id)
                wides.append(large)
                out.append(v.astype("<f8" if large else "<i4").tobytes())
            yield pa.record_batch([pa.array(uids, pa.int64()), pa.array(ids, pa.int64()), pa.array(wides, pa.bool_()), pa.array(out, pa.binary())], names=["uid", "vec_id", "wide", "v"])

    return run


def _matrix(table: pa.Table, dims: int) -> np.ndarray:
    """One row a dimension; shorter vectors are filled up with zeros."""
    out = np.zeros((dims, table.num_rows))
    for k, (large, v) in enumerate(zip(table["wide"].to_pylist(), table["v"].to_pylist())):
        x = np.frombuffer(v, "<f8" if large else "<i4")
        out[: len(x), k] = x
    return out


class Best:
    """The k highest scores of a query, ties by smaller id (null last)."""

    def __init__(self, k: int, floor: int | None):
        self.k, self.floor, self.rows = k, floor, []

    def add(self, scores: list[int], ids: list[int | None]) -> None:
        self.rows = sorted([*self.rows, *((-s, i is None, i or 0) for s, i in zip(scores, ids))])[: self.k]
        if len(self.rows) == self.k and (self.floor is None or -self.rows[-1][0] > self.floor):
            self.floor = -self.rows[-1][0]


def _ordered(queries: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with the dimensions of the largest common mass first."""
    order = np.argsort(-(np.square(queries).sum(axis=1) * np.square(vectors).sum(axis=1)), kind="stable")
    return queries[order], vectors[order]


def _left(x: np.ndarray, edges: list[int]) -> np.ndarray:
    """Norms of what is left after each block of dimensions, a little rounded up."""
    mass = np.add.reduceat(np.square(x), edges, axis=0)
    return np.sqrt(np.cumsum(mass[::-1], axis=0)[::-1] - mass) * (1 + 1e-9) + 1e-9


def search_shard(queries: np.ndarray, own: list[int], vectors: np.ndarray, uids: np.ndarray, ids: list[int | None], best: list[Best]) -> None:
    """Adds to ``best`` what the shard's vectors reach; a query's own row (``own``) takes no part."""
    dims, n = vectors.shape
    most = np.sqrt(np.square(queries).sum(axis=0).max(initial=0) * np.square(vectors).sum(axis=0).max(initial=0)) if dims else 0
    if not most < EXACT:  # whole numbers of any size
        exact = [[int(x) for x in column] for column in vectors.T]
        limit = 2**63 - 1
        for q, (uid, b) in enumerate(zip(own, best)):
            x = [int(y) for y in queries[:, q]]
            scores = [max(-limit - 1, min(limit, sum(map(int.__mul__, x, y)))) for y in exact]
            kept = [k for k in range(n) if uids[k] != uid]
            b.add([scores[k] for k in kept], [ids[k] for k in kept])
        return
    queries, vectors = _ordered(queries, vectors)
    edges = list(range(0, dims, DIMENSIONS))
    for at in range(0, n, CANDIDATES):
        part, part_uids = vectors[:, at : at + CANDIDATES], uids[at : at + CANDIDATES]
        rest = _left(part, edges) if dims else None
        for first in range(0, len(own), QUERIES):
            asked = queries[:, first : first + QUERIES]
            here = slice(first, first + QUERIES)
            least = np.array([-np.inf if b.floor is None else b.floor for b in best[here]])
            asked_rest = _left(asked, edges) if dims else None
            sums = np.zeros((asked.shape[1], part.shape[1]))
            mine = np.array(own[here])[:, None] != part_uids
            who = None
            for k, low in enumerate(edges):
                block = slice(low, low + DIMENSIONS)
                if who is None:
                    sums += asked[block].T @ part[block]
                    alive = mine & (sums + asked_rest[k][:, None] * rest[k] >= least[:, None])
                    if alive.mean() <= DENSE:  # the pairs left are moved together
                        who, what = np.nonzero(alive)
                        total = sums[who, what]
                    continue
                for d in range(low, min(low + DIMENSIONS, dims)):
                    total += asked[d][who] * part[d][what]
                alive = total + asked_rest[k][who] * rest[k][what] >= least[who]
                who, what, total = who[alive], what[alive], total[alive]
            if who is None:
                who, what = np.nonzero(mine & (sums >= least[:, None]))
                total = sums[who, what]
            cuts = np.searchsorted(who, np.arange(asked.shape[1] + 1))
            for q in np.flatnonzero(np.diff(cuts)):
                b, mine_too = best[first + q], slice(cuts[q], cuts[q + 1])
                t, w = total[mine_too], what[mine_too]
                if len(t) > 4 * b.k:  # all that tie with the k-th stay
                    near = t >= -np.partition(-t, b.k - 1)[b.k - 1]
                    t, w = t[near], w[near]
                b.add([int(s) for s in t], [ids[at + j] for j in w])


def _search(k: int, dims: int):
    def run(table: pa.Table) -> pa.Table:
        asks = table.filter(table["is_query"])
        rows = table.filter(pa.compute.invert(table["is_query"]))
        best = [Best(k, f) for f in asks["floor"].to_pylist()]
        own = asks["uid"].to_pylist()
        if own and rows.num_rows:
            search_shard(_matrix(asks, dims), own, _matrix(rows, dims), rows["uid"].to_numpy(), rows["vec_id"].to_pylist(), best)
        out = [(u, q, None if none else i, -s) for u, q, b in zip(own, asks["vec_id"].to_pylist(), best) for s, none, i in b.rows]
        columns = list(zip(*out)) or [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in _FOUND.split(", ")])

    return run


def _met(asks: DataFrame, rows: DataFrame, teams: int, shards: int, k: int, dims: int) -> DataFrame:
    """The k best of each query in each shard: every group of queries meets every shard in a task of its own."""
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n, seed: F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(n)).cast("int")
    columns = ("team", "shard", "is_query", "uid", "vec_id", "wide", "v", "floor")
    asked = asks.withColumn("team", own(teams, 1)).withColumn("shard", each(shards)).withColumn("is_query", F.lit(True)).select(*columns)
    laid = rows.withColumn("shard", own(shards, 2)).withColumn("team", each(teams)).withColumn("is_query", F.lit(False)).withColumn("floor", F.lit(None).cast("long")).select(*columns)
    return asked.unionByName(laid).groupBy("team", "shard").applyInArrow(_search(k, dims), _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_products(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (integer inner product of floor(scale * x)) of each query's k best rows.

    ``vectors``: vec_id and embedding; other columns are left out.  Queries are the rows whose id ``every`` divides;
    their own row isn't compared, another row with the same id or the same vector is.  Vectors that are null or hold
    null or non-finite components take no part; shorter ones are filled up with zeros, an empty one scores 0; rows
    without an id are found, after others of the same score; repeated rows are ranked one by one; scores that a long
    can't hold are the nearest long; an empty table gives no rows.  Nothing is left out by sampling: the pilot (``PILOT``
    rows, any will do) only gives a score that k rows are known to reach.
    """
    spark = vectors.sparkSession
    numbered = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = saved(numbered.mapInArrow(_quantise(scale), _ROW), "quantised")
    asks = rows.filter(F.col("vec_id") % every == 0)
    n, dims = rows.agg(F.count("*"), F.max(F.octet_length("v") / F.when(F.col("wide"), 8).otherwise(4))).first()
    dims, many = int(dims or 0), asks.count()
    per = lambda size: max(1, size // (8 * max(1, dims)))
    teams = max(1, -(-many // per(GROUP_BYTES)))
    shards = max(1, -(-n // per(SHARD_BYTES)), min(-(-wide(spark) // teams), n // LEAST))
    pilot = rows.orderBy(F.xxhash64("uid", F.lit(3)), "uid").limit(PILOT)
    # the pilot meets the queries in smaller groups, so that all tasks are busy
    first = saved(_ranked(_met(asks.withColumn("floor", F.lit(None).cast("long")), pilot, max(teams, min(wide(spark), -(-many // QUERIES) or 1)), 1, k, dims), k), "pilot-scores")
    floors = first.filter(F.col("rank") == k).select(F.col("query_uid").alias("uid"), F.col("score").alias("floor"))
    found = _met(asks.join(floors, "uid", "left"), rows, teams, shards, k, dims)
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
