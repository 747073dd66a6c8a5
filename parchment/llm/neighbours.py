"""Near-duplicate vectors by a robust-pruned flat graph over overlapping cluster shards.

Vectors of a label are assigned to their few nearest centroids, fitted on a bounded sample; clusters that
hold more than a block are divided again, by centroids of their own that tasks fit on samples of them.
Every row is assigned, so shards overlap.  Each block builds a flat graph by robust pruning; the adjacency
lists of a vector are united over its shards.  Every vector is searched in its shards along these lists: a
greedy walk from the medoid, then expansion over all neighbours in range; only distances to nodes that the
walk comes upon are computed.  Links found so are exact (double precision).  A sample of queries is
audited against all rows; if too few links were found the overlap is widened, and if that doesn't help
either, all vectors of a label are compared block by block.

Shards beyond ``BLOCK`` vectors (copies no centroid can part) are split into blocks by hash and every block
is searched from every block, so a hot neighbourhood stays whole in bounded tasks.  Equal vectors are one
vector with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import saved, spread_join

#: Vectors a centroid stands for, centroids of a level in all, sampled vectors a centroid, vectors of a block.
SHARD, CENTROIDS, SAMPLE, BLOCK = 320, 4096, 24, 1024
#: Shards of a vector among the parts of a divided cluster; members of such a cluster in one task.
PARTS, PART_ROWS = 2, 8192
#: Out-degree after pruning and with reverse edges, near and random candidates, pruning factor.
DEGREE, DEGREE_BOTH, NEAR, FAR, ALPHA = 24, 48, 48, 16, 1.2
#: Nodes a greedy walk keeps; how far below the threshold a node is still expanded.
BEAM, SLACK = 24, 0.05
#: Shards of a vector in each attempt; recall that ends the attempts, recall below which all are compared; audited queries.
OVERLAPS, RECALL, LEAST, AUDIT = (3, 6, 12), 0.95, 0.9, 400
#: Shards whose vectors are compared exactly to draw audited queries with links.
AUDIT_SHARDS = 64


def _unit(blobs, kind: str) -> np.ndarray:
    """Rows of length 1, scaled by their largest component first, so that no square over- or underflows."""
    x = np.stack([np.frombuffer(b, kind) for b in blobs]).astype("f8")
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> tuple[DataFrame, str]:
    """uid, vec_id, shelf (label and width) and the vector's bytes, null where the row links nothing; and the bytes' type, as exact as the column's."""
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, shelf = [], []
            for v, label in zip(b.column("embedding").to_pylist(), b.column("label").to_pylist()):
                blob = None
                if v and label is not None and None not in v:
                    x = np.array(v, kind)
                    if np.isfinite(x).all() and x.any():
                        blob = (x + 0).tobytes()  # no negative zeros
                out.append(blob)
                shelf.append(f"{label}/{len(v)}" if blob else None)
            yield pa.record_batch([b.column("uid"), b.column("vec_id"), pa.array(shelf, pa.string()), pa.array(out, pa.binary())], names=["uid", "vec_id", "shelf", "v"])

    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    return saved(rows.mapInArrow(run, "uid long, vec_id long, shelf string, v binary"), "vectors"), kind


def spherical_means(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """At most ``n`` unit centroids of unit rows."""
    c = x[np.random.default_rng(1).permutation(len(x))[:n]]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-30), c)
    return c


def fit_centroids(points: DataFrame, kind: str) -> dict[str, np.ndarray]:
    """Unit centroids for each shelf with more than one shard, by spherical k-means on a bounded sample."""
    large = points.groupBy("shelf").count().filter(F.col("count") > 1.5 * SHARD).orderBy(F.desc("count"), "shelf").limit(CENTROIDS).collect()
    wanted = sum(-(-r["count"] // SHARD) for r in large)
    k = {r["shelf"]: max(2, int(-(-r["count"] // SHARD) * min(1.0, CENTROIDS / max(1, wanted)))) for r in large}
    if not k:
        return {}
    rate = F.create_map(*[F.lit(x) for r in large for x in (r["shelf"], min(1.0, SAMPLE * k[r["shelf"]] / r["count"]))])[F.col("shelf")]
    drawn = points.filter(F.pmod(F.xxhash64("uid", F.lit(5)), F.lit(1 << 30)) < rate * (1 << 30)).select("shelf", "uid", "v").collect()
    own: dict[str, list] = {}
    for r in sorted(drawn, key=lambda r: r["uid"]):
        own.setdefault(r["shelf"], []).append(r["v"])
    return {shelf: spherical_means(_unit(own[shelf], kind), n) for shelf, n in k.items() if len(own.get(shelf, ())) > 1}


def assigned(points: DataFrame, centroids: dict[str, np.ndarray], overlap: int, kind: str) -> DataFrame:
    """Adds shards: the vector's nearest clusters, as sorted strings."""
    shared = points.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shelves, blobs = b.column("shelf").to_pylist(), b.column("v").to_pylist()
            out = [[f"{s}/0"] for s in shelves]
            for s in set(shelves) & set(shared.value):
                c, at = shared.value[s], [i for i, x in enumerate(shelves) if x == s]
                near = np.argsort(-(_unit([blobs[i] for i in at], kind) @ c.T), axis=1, kind="stable")[:, :overlap]
                for i, row in zip(at, near.tolist()):
                    out[i] = sorted(f"{s}/{k}" for k in row)
            yield pa.record_batch([*b.columns, pa.array(out, pa.list_(pa.string()))], names=[*b.schema.names, "shards"])

    return points.mapInArrow(run, f"{', '.join(f'{n} {t}' for n, t in points.dtypes)}, shards array<string>")


def divided(placed: DataFrame, kind: str) -> DataFrame:
    """``placed`` with shards of more than ``BLOCK`` vectors replaced by their parts, so that centroids grow with the input.

    A task fits the centroids of a shard on at most ``SAMPLE`` sampled members a centroid; its members are
    assigned in slices of about ``PART_ROWS``, each with the shard's centroids.
    """
    sizes = placed.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.count("*").alias("m"))
    large = saved(sizes.filter(F.col("m") > BLOCK), "large-shards")
    if large.isEmpty():
        return placed
    k = F.least(F.ceil(F.col("m") / SHARD), F.lit(CENTROIDS)).cast("int")
    members = placed.select("uid", "v", F.explode("shards").alias("shard")).join(large, "shard").withColumn("k", k)
    drawn = members.filter(F.pmod(F.xxhash64("uid", F.lit(8)), F.lit(1 << 30)) * F.col("m") < F.lit(float(SAMPLE << 30)) * F.col("k")).select("shard", "k", "uid", "v")

    def fit(pdf):
        import pandas as pd

        pdf = pdf.sort_values("uid")
        c = spherical_means(_unit(pdf["v"], kind), int(pdf["k"].iloc[0]))
        return pd.DataFrame({"shard": pdf["shard"].iloc[0], "part": range(len(c)), "c": [x.tobytes() for x in c]})

    slices = F.ceil(F.col("m") / PART_ROWS).cast("int")
    centres = drawn.groupBy("shard").applyInPandas(fit, "shard string, part int, c binary")
    centres = saved(centres, "part-centroids").join(large, "shard").select("shard", "part", "c", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    rows = members.select("shard", "uid", "v", F.pmod(F.xxhash64("uid", F.lit(9)), slices).cast("int").alias("slice"))

    def assign(own, parts):
        import pandas as pd

        if not len(own):
            return pd.DataFrame({"uid": pd.Series(dtype="int64"), "shard": pd.Series(dtype="object"), "part": pd.Series(dtype="int32")})
        parts = parts.sort_values("part")
        c = np.stack([np.frombuffer(x, "f8") for x in parts["c"]]) if len(parts) else np.zeros((1, len(np.frombuffer(own["v"].iloc[0], kind))))
        near = np.argsort(-(_unit(own["v"], kind) @ c.T), axis=1, kind="stable")[:, :PARTS]
        return pd.DataFrame({"uid": np.repeat(own["uid"].to_numpy(), near.shape[1]), "shard": own["shard"].iloc[0], "part": near.ravel().astype("i4")})

    found = rows.groupBy("shard", "slice").cogroup(centres.groupBy("shard", "slice")).applyInPandas(assign, "uid long, shard string, part int")
    found = found.groupBy("uid").agg(F.collect_set(F.concat_ws("/", "shard", F.col("part").cast("string"))).alias("parts"))
    names = saved(large.select("shard"), "large-names")
    whole = placed.select("uid", F.explode("shards").alias("shard")).join(names, "shard", "left_anti").groupBy("uid").agg(F.collect_set("shard").alias("whole"))
    none = F.array().cast("array<string>")
    both = placed.drop("shards").join(found, "uid", "left").join(whole, "uid", "left")
    return both.withColumn("shards", F.array_sort(F.concat(F.coalesce("parts", none), F.coalesce("whole", none)))).drop("parts", "whole")


def robust_prune(sims: np.ndarray, rng: np.random.Generator) -> list[list[int]]:
    """Adjacency lists of a block from its similarity matrix: near nodes none of which is much nearer to another kept one."""
    m = len(sims)
    if m == 1:
        return [[]]
    dist = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * sims))
    near = np.argpartition(dist, min(NEAR, m - 1), axis=1)[:, : NEAR + 1]
    far = rng.integers(0, m, (m, FAR))
    lists: list[list[int]] = []
    for i in range(m):
        cand = np.unique(np.concatenate([near[i], far[i]]))
        cand = cand[cand != i]
        cand = cand[np.argsort(dist[i, cand], kind="stable")]
        own: list[int] = []
        d = dist[i, cand]
        while len(cand) and len(own) < DEGREE:
            p = int(cand[0])
            own.append(p)
            keep = ALPHA * dist[p, cand] > d
            keep[0] = False
            cand, d = cand[keep], d[keep]
        # the farthest candidates keep the graph in one piece
        lists.append(list(dict.fromkeys([*own, *far[i, :2].tolist()])))
    for i, own in enumerate([list(x) for x in lists]):
        for j in own:
            if len(lists[j]) < DEGREE_BOTH and i not in lists[j]:
                lists[j].append(i)
    return lists


def build_graph(members: DataFrame, kind: str) -> DataFrame:
    """(uid, near): adjacency lists, united over the blocks a vector lies in."""

    def build(pdf):
        import pandas as pd

        x = _unit(pdf["v"], kind)
        uid = pdf["uid"].to_numpy()
        lists = robust_prune(x @ x.T, np.random.default_rng(len(uid)))
        return pd.DataFrame({"uid": uid, "near": [uid[[j for j in own if j != i]].tolist() for i, own in enumerate(lists)]})

    lists = members.select("shard", "block", "uid", "v").groupBy("shard", "block").applyInPandas(build, "uid long, near array<long>")
    return lists.groupBy("uid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def range_search(queries: np.ndarray, nodes: np.ndarray, adjacency: np.ndarray, medoid: int, threshold: float) -> tuple[np.ndarray, int]:
    """Similarities of every query to the nodes it comes upon (-2 to others), and how many were computed.

    The best ``BEAM`` nodes so far are expanded, and all within ``SLACK`` of the threshold; all queries take a step at a time.
    """
    q, m = len(queries), len(nodes)
    sims, done = np.full((q, m), -2.0), np.zeros((q, m), bool)
    sims[:, medoid] = queries @ nodes[medoid]
    computed = q
    fresh = np.zeros((q, m), bool)
    while True:
        bar = np.partition(sims, m - BEAM, axis=1)[:, m - BEAM] if m > BEAM else np.full(q, -2.0)
        near = sims >= threshold - SLACK
        # a step expands the best few of the beam, and what lies in range
        todo = (sims > -2.0) & ~done & ((sims >= bar[:, None]) | near)
        if not todo.any():
            return sims, computed
        if m > BEAM:
            rank = np.where(todo, sims, -2.0)
            fourth = np.partition(rank, m - 4, axis=1)[:, m - 4]
            todo &= (sims >= fourth[:, None]) | near
        rows, at = np.nonzero(todo)
        done[rows, at] = True
        for i in range(0, len(rows), 100_000):
            fresh[rows[i : i + 100_000, None], adjacency[at[i : i + 100_000]]] = True
        fresh &= sims == -2.0
        rows, at = np.nonzero(fresh)
        fresh[rows, at] = False
        computed += len(rows)
        for i in range(0, len(rows), 50_000):
            r, c = rows[i : i + 50_000], at[i : i + 50_000]
            sims[r, c] = np.einsum("ij,ij->i", queries[r], nodes[c])


def _search_block(pdf, threshold: float, kind: str, exact: bool = False):
    """Links of a block's queries (``exact``: to all of its base, not along the graph): weights of what each links to, counted in the first shard both share, and labels of what hangs together."""
    import pandas as pd

    base, query = pdf[pdf["is_base"]].reset_index(drop=True), pdf[pdf["is_query"]].reset_index(drop=True)
    if not len(base) or not len(query):
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("uid", "n", "low", "computed")})
    xb, xq = _unit(base["v"], kind), _unit(query["v"], kind)
    bu, qu = base["uid"].to_numpy(), query["uid"].to_numpy()
    if exact:
        sims, computed = xq @ xb.T, len(xq) * len(xb)
    else:
        place = {u: i for i, u in enumerate(bu.tolist())}
        lists = [[place[u] for u in own if u in place] for own in base["near"]]
        width = max(1, max(map(len, lists)))
        adjacency = np.array([own + [i] * (width - len(own)) for i, own in enumerate(lists)])
        sims, computed = range_search(xq, xb, adjacency, int((xb @ xb.mean(0)).argmax()), threshold)
        if base["is_query"].all():  # the block whose graph was built by its own products
            computed += len(base) ** 2
    found = (sims >= threshold) & (qu[:, None] != bu[None, :])
    if len(bu) == len(qu) and (bu == qu).all():
        found |= found.T
    names = {s: i for i, s in enumerate(sorted({s for x in pdf["shards"] for s in x}))}
    sb, sq = ([[names[s] for s in x] for x in t["shards"]] for t in (base, query))
    wide = max(map(len, sb + sq))
    sb = np.array([x + [-1] * (wide - len(x)) for x in sb])
    sq = np.array([x + [-2] * (wide - len(x)) for x in sq])
    own = names[pdf["shard"].iloc[0]]
    rows, cols = np.nonzero(found)
    weight, counts = base["weight"].to_numpy(), np.zeros(len(qu), "i8")
    for at in range(0, len(rows), 100_000):
        r, c = rows[at : at + 100_000], cols[at : at + 100_000]
        common = (sq[r][:, :, None] == sb[c][:, None, :]).any(2)
        first = np.where(common, sq[r], 1 << 30).min(1)
        np.add.at(counts, r, np.where(first == own, weight[c], 0))
    big = np.iinfo("i8").max
    lq, lb = qu.astype("i8").copy(), bu.astype("i8").copy()
    while True:
        nq = np.minimum(lq, np.where(found, lb[None, :], big).min(1))
        nb = np.minimum(lb, np.where(found, nq[:, None], big).min(0))
        if (nq == lq).all() and (nb == lb).all():
            break
        lq, lb = nq, nb
    uid, low = np.concatenate([qu, bu]), np.concatenate([lq, lb])
    n = np.concatenate([counts, np.zeros(len(bu), "i8")])
    keep = (n > 0) | (uid != low)
    keep[0] = True
    each = np.zeros(len(uid), "i8")
    each[0] = computed
    return pd.DataFrame({"uid": uid[keep], "n": n[keep], "low": low[keep], "computed": each[keep]})


def _linked_sample(placed: DataFrame, threshold: float, kind: str) -> DataFrame:
    """(uid) of vectors with a link inside one of ``AUDIT_SHARDS`` shards drawn by hash, at most a block of each compared exactly: whatever the search found."""
    sizes = placed.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.count("*").alias("m")).filter("m > 1")
    drawn = saved(sizes.orderBy(F.xxhash64("shard", F.lit(12)), "shard").limit(AUDIT_SHARDS), "audit-shards")
    own = placed.select("uid", "v", F.explode("shards").alias("shard")).join(F.broadcast(drawn), "shard")
    own = own.filter(F.pmod(F.xxhash64("uid", F.lit(13)), F.ceil(F.col("m") / BLOCK)) == 0).select("shard", "uid", "v")

    def linked(pdf):
        x = _unit(pdf["v"], kind)
        sims = x @ x.T
        np.fill_diagonal(sims, -2.0)
        return pdf.loc[(sims >= threshold).any(axis=1), ["uid"]]

    return own.groupBy("shard").applyInPandas(linked, "uid long").distinct()


def _audit(points: DataFrame, placed: DataFrame, counts: DataFrame, threshold: float, kind: str) -> float | None:
    """Share of the true links of at most ``AUDIT`` queries that were found, null if they have none; all rows are compared.

    Half of the queries are drawn by hash from all rows, half from those that an exact comparison of a few blocks
    shows to have links; only where these blocks hold none, from those with links found.
    """
    order = [F.xxhash64("uid", F.lit(11)), "uid"]
    draw = lambda some: points.select("uid", "shelf", "v").join(some.select("uid"), "uid", "left_semi").orderBy(*order).limit(AUDIT // 2).collect()
    linked = draw(_linked_sample(placed, threshold, kind)) or draw(counts.filter("n > 0"))
    drawn = {r["uid"]: r for r in (*points.select("uid", "shelf", "v").orderBy(*order).limit(AUDIT // 2).collect(), *linked)}
    by: dict[str, list] = {}
    for r in drawn.values():
        by.setdefault(r["shelf"], []).append(r)
    queries = points.sparkSession.sparkContext.broadcast({s: ([r["uid"] for r in x], _unit([r["v"] for r in x], kind)) for s, x in by.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for b in batches:
            shelves, blobs, weights, uids = (b.column(c).to_pylist() for c in ("shelf", "v", "weight", "uid"))
            for s in set(shelves) & set(queries.value):
                at = [i for i, x in enumerate(shelves) if x == s]
                ids, x = queries.value[s]
                hit = (x @ _unit([blobs[i] for i in at], kind).T >= threshold) & (np.array(ids)[:, None] != np.array([uids[i] for i in at])[None, :])
                for u, k in zip(ids, (hit * np.array([weights[i] for i in at])[None, :]).sum(1).tolist()):
                    total[u] = total.get(u, 0) + k
        yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["uid", "truth"])

    truth = points.mapInArrow(run, "uid long, truth long").groupBy("uid").agg(F.sum("truth").alias("truth"))
    got = truth.join(counts, "uid", "left").agg(F.sum("truth"), F.sum(F.least("truth", F.coalesce("n", F.lit(0))))).first()
    return got[1] / got[0] if got[0] else None


def _searched(placed: DataFrame, threshold: float, kind: str, exact: bool = False) -> DataFrame:
    """(uid, n, low, computed) of all blocks of the shards."""
    sizes = placed.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = saved(sizes.filter("blocks > 1"), "split-shards")
    if sizes.count() <= 100_000:  # a name and a number each; more are joined by shuffle
        sizes = F.broadcast(sizes)
    members = placed.withColumn("shard", F.explode("shards")).join(sizes, "shard", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    members = saved(members.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(3)), F.col("blocks")).cast("int")), "members")
    whole = members.withColumn("near", F.array().cast("array<long>")) if exact else members.join(saved(build_graph(members, kind), "graph"), "uid")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    as_base = whole.withColumn("from", every).withColumn("to", F.col("block")).withColumn("is_base", F.lit(True)).withColumn("is_query", F.col("from") == F.col("block"))
    as_query = whole.filter("blocks > 1").withColumn("to", every).withColumn("from", F.col("block")).filter("to <> block").withColumn("is_base", F.lit(False)).withColumn("is_query", F.lit(True))
    links = as_base.unionByName(as_query).select("shard", "from", "to", "uid", "weight", "v", "shards", "near", "is_base", "is_query")
    return saved(links.groupBy("shard", "from", "to").applyInPandas(lambda pdf: _search_block(pdf, threshold, kind, exact), "uid long, n long, low long, computed long"), "links")


def link_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept, recall (of the audit) and compared (distances a vector), the last two the same in all rows.

    ``compared`` counts the products that build the graphs and the distances of the searches; the audit adds at most ``AUDIT`` a vector.

    ``vectors``: vec_id, embedding, label; other columns are left out.  Vectors link only when their labels
    are equal and not null and their cosine (of the components as they are, in double precision) reaches
    ``threshold``; null, empty and zero vectors and those with null or non-finite components link with nothing,
    nor do vectors of different widths.  Repeated rows are vectors of their own; component_id is the smallest id
    reached (null if all ids are null); an empty table gives no rows.  Recall is 0.9 or more: below, or where
    the audited vectors have no link to measure it by, all vectors of a label are compared.
    """
    rows, kind = usable(vectors)
    equal = rows.filter("v is not null").groupBy("shelf", F.xxhash64("v", F.lit(1)).alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2"))
    points = saved(equal.agg(F.min("uid").alias("uid"), F.count("*").alias("weight"), F.min_by("v", "uid").alias("v")), "points")
    slim = points.select("uid", "weight", "shelf", "v")
    centroids = fit_centroids(points, kind)
    for overlap in OVERLAPS:
        placed = saved(divided(saved(assigned(slim, centroids, overlap, kind), "assigned"), kind), "placed")
        links = _searched(placed, threshold, kind)
        counts = saved(links.groupBy("uid").agg(F.sum("n").alias("n")), "counts")
        recall = _audit(points, placed, counts, threshold, kind)
        if recall is None or recall >= RECALL or not centroids:
            break
    if recall is None or recall < LEAST:
        links = _searched(slim.withColumn("shards", F.array("shelf")), threshold, kind, exact=True)
        counts = saved(links.groupBy("uid").agg(F.sum("n").alias("n")), "counts")
        recall = 1.0
    compared = links.agg(F.sum("computed")).first()[0] or 0
    compared /= max(1, points.count())
    labels = saved(components(links.select(F.col("uid").alias("a"), F.col("low").alias("b"))), "components")
    reps = points.select("shelf", "h1", "h2", F.col("uid").alias("rep"), "weight")
    keyed = saved(rows.select("uid", "vec_id", "shelf", F.xxhash64("v", F.lit(1)).alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2")), "keyed")
    own = keyed.filter("shelf is not null").join(saved(reps, "reps"), ["shelf", "h1", "h2"]).select("uid", "vec_id", "rep", "weight")
    own = own.join(counts.withColumnRenamed("uid", "rep"), "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    own = saved(own.select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "own")
    lowest = saved(own.groupBy("component").agg(F.min("vec_id").alias("component_id")), "lowest")
    linked = spread_join(own, lowest, ["component"]).select("vec_id", "n_links", "component_id")
    alone = keyed.filter("shelf is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).withColumn("recall", F.lit(float(recall))).withColumn("compared", F.lit(float(compared)))
