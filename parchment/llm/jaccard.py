"""Exact Jaccard join on word shingles with token-combination prefixes.

A text's tokens are the 64-bit hashes of its n distinct five-word shingles, in three classes by how many
texts hold them: one (such a token links nothing), up to ``FREQUENT`` (rare), more (frequent).  Tokens are
ordered by class, then hash.  With J >= 0.8 at most n/5 of a text's tokens are missing in the other, so

* the first common token is within the first n/5 + 1 of both.  If it is rare, it is the key;
* if it is frequent, the r tokens that are not frequent are all missing, and of the runs of k consecutive
  frequent tokens a missing or an added one breaks at most k: an unbroken run is within the first
  kn/5 - kr + 1 of both.  Runs of two tokens are the keys, and where more than ``LONG`` entries share
  such a key, runs of three with their longer prefix.

So a text has at most 3n/5 keys, whatever the groups' sizes, and no link is lost.

Tokens travel by hash range once, to be counted, and only shared ones travel back to their text; what a
task holds for every text alike is counted where it lies.  Candidates are found in rounds: members of a
key that aren't in the component of its first member (strangers) are compared with that member; then each
stranger with eight members of its most crowded key, and with eight times as many, while too many are left;
at last every stranger with all members of all its keys that are in another component, those of crowded
keys block by block inside tasks, which emit likely pairs only.  A bit parity of the sets bounds the overlap from above, and what is left is verified on whole token sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import merged
from .store import saved, spread_join
from .store import small as _small

#: Words of a shingle; similarity in percent (the prefixes below hold from 80 on).
WORDS, PERCENT = 5, 80
#: A token in more texts than this is frequent; a key of two tokens with more entries than this is extended to three.
FREQUENT, LONG = 64, 1024
#: Tokens (and texts) that a task gathers before it hands them on; tokens of a hash range, about; bits of a range's number at most.
GATHERED, GATHERED_TEXTS, RANGE_TOKENS, RANGE_BITS = 2_000_000, 60_000, 1_000_000, 18
#: Growth of the members compared.
MORE = 8
#: Comparisons an entry, on average, from which on few members are met before all; members of a block; smallest keys a member is known by.
EACH, CROWD_BLOCK, FIRST_KEYS = 500, 4096, 16
_P = np.uint64(0x9E3779B97F4A7C15)
_SCATTERED = "bucket long, gathered long, tokens binary, owners binary, heavy binary, uids binary, sizes binary, parity binary"
_RETURNED = "gathered long, tokens binary, owners binary, classes binary, uids binary, sizes binary, parity binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles; with fewer words, of the whole sequence; without any, none."""
    from xxhash import xxh3_64_intdigest as h

    w = text.encode().lower().split() if text else []
    if not w:
        return np.zeros(0, "u8")
    x = np.fromiter(map(h, w), "u8", len(w))
    if len(w) < words:
        total = np.uint64(len(w))
        with np.errstate(over="ignore"):
            for v in x:
                total = total * _P + v
        return _mixed(np.array([total]))
    total = x[: len(x) - words + 1].copy()
    for k in range(1, words):
        total = total * _P + x[k : len(x) - words + 1 + k]
    return np.unique(_mixed(total))


def parity(x: np.ndarray) -> bytes:
    """512 bits: whether an odd number of tokens falls on each; two sets differ in at least as many tokens as bits."""
    return np.packbits((np.bincount((x & np.uint64(511)).astype("i8"), minlength=512) & 1).astype("u1")).tobytes()


def _distinct_texts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uid, doc_id, rep) of all rows, and (uid, text) of one row for each text: the rep."""
    slim = saved(rows.select("uid", "doc_id", F.xxhash64("text", F.lit(1)).alias("h1"), F.xxhash64(F.lit(2), "text", F.length("text")).alias("h2")), "rows")
    copied = slim.groupBy("h1", "h2").agg(F.min("uid").alias("rep"), F.count("*").alias("m")).filter("m > 1").select("h1", "h2", "rep")
    of = spread_join(slim, saved(copied, "copied"), ["h1", "h2"]).select("uid", "doc_id", F.coalesce("rep", "uid").alias("rep"))
    of = saved(of, "rep-of")
    others = _small(of.filter("uid <> rep").select("uid"))
    return of, rows.select("uid", "text").join(others, "uid", "left_anti")


def _scatter(bits: int, frequent: int):
    """Tokens of gathered texts by hash range, with their owners; tokens that alone are frequent here only say so."""

    def flush(uids: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        gathered = uids[0]
        sizes = np.array([len(x) for x in sets], "u4")
        x = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype="u2"), sizes)
        order = np.argsort(x, kind="stable")
        x, owner = x[order] >> np.uint64(32 - bits), owner[order]
        first = np.flatnonzero(np.concatenate([[len(x) > 0], x[1:] != x[:-1]])) if len(x) else np.zeros(0, "i8")
        count = np.diff(np.append(first, len(x)))
        is_heavy = np.repeat(count > frequent, count)
        heavy = x[first[count > frequent]] if len(x) else x
        # the texts' own row passes by the ranges
        rows = [(-1 - gathered, gathered, x[is_heavy].tobytes(), owner[is_heavy].tobytes(), b"", np.array(uids, "i8").tobytes(), sizes.tobytes(), b"".join(parity(s) for s in sets))]
        x, owner = x[~is_heavy], owner[~is_heavy]
        edges = np.arange((1 << bits) + 1, dtype="u8") << np.uint64(32)
        ends, heavy_ends = np.searchsorted(x, edges), np.searchsorted(heavy, edges)
        for b in np.flatnonzero((np.diff(ends) > 0) | (np.diff(heavy_ends) > 0)).tolist():
            i, j, k, m = ends[b], ends[b + 1], heavy_ends[b], heavy_ends[b + 1]
            rows.append((b, gathered, x[i:j].astype("u4").tobytes(), owner[i:j].tobytes(), heavy[k:m].astype("u4").tobytes(), None, None, None))
            if len(rows) == 64:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uids, sets, n = [], [], 0
        for b in batches:
            for uid, text in zip(b.column("uid").to_pylist(), b.column("text")):
                x = shingles(text.as_py())
                uids.append(uid)
                sets.append(x)
                n += len(x)
                if n >= GATHERED or len(uids) == GATHERED_TEXTS:
                    yield from flush(uids, sets)
                    uids, sets, n = [], [], 0
        if uids:
            yield from flush(uids, sets)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 6]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["bucket", "gathered", "tokens", "owners", "heavy", "uids", "sizes", "parity"])


def _classify(pdf, frequent: int):
    """The shared tokens of a hash range, back to where they were gathered."""
    import pandas as pd

    bucket = int(pdf["bucket"].iloc[0])
    if bucket < 0:
        return pdf.assign(classes=[b"\x02" * (len(t) // 8) for t in pdf["tokens"]])[["gathered", "tokens", "owners", "classes", "uids", "sizes", "parity"]]
    parts = [np.frombuffer(t, "u4") for t in pdf["tokens"]]
    x, heavy = np.concatenate(parts), np.unique(np.concatenate([np.frombuffer(t, "u4") for t in pdf["heavy"]]))
    order = np.argsort(x, kind="stable")
    y = x[order]
    first = np.flatnonzero(np.concatenate([[len(y) > 0], y[1:] != y[:-1]])) if len(y) else np.zeros(0, "i8")
    count = np.diff(np.append(first, len(y)))
    kind = np.where(np.isin(y[first], heavy) | (count > frequent), 2, np.where(count > 1, 1, 0)).astype("u1")
    classes = np.empty(len(x), "u1")
    classes[order] = np.repeat(kind, count)
    out, at = {k: [] for k in ("gathered", "tokens", "owners", "classes")}, 0
    for g, part, owners in zip(pdf["gathered"], parts, pdf["owners"]):
        c = classes[at : at + len(part)]
        at += len(part)
        if c.any():
            out["gathered"].append(g)
            out["tokens"].append((part[c > 0].astype("u8") | np.uint64(bucket << 32)).tobytes())
            out["owners"].append(np.frombuffer(owners, "u2")[c > 0].tobytes())
            out["classes"].append(c[c > 0].tobytes())
    return pd.DataFrame(out).assign(uids=None, sizes=None, parity=None)


def prefix_keys(sizes: np.ndarray, owner: np.ndarray, token: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, key, longer key, whether it has one) of sets of ``sizes`` tokens from their shared tokens (1: rare, 2: frequent)."""
    order = np.lexsort((token, kind, owner))
    owner, token, kind = owner[order].astype("i8"), token[order], kind[order]
    shared = np.bincount(owner, minlength=len(sizes))
    common = np.bincount(owner[kind == 2], minlength=len(sizes))
    start = np.concatenate([[0], np.cumsum(shared)])[:-1]
    n = sizes.astype("i8")[owner]
    place = np.arange(len(owner)) - start[owner]  # among the shared tokens, which are behind the others
    missing = n - -(-PERCENT * n // 100)
    single = (place + n - shared[owner] <= missing) & ((kind == 1) | (n == 1))
    # runs of frequent tokens
    run, other = place - (shared - common)[owner], n - common[owner]
    least = lambda k: k * (100 - PERCENT) * n // 100 - k * other
    two = (kind == 2) & (n > 1) & (n <= 6) & (run <= least(2)) & (run + 1 < common[owner])
    three = (kind == 2) & (n >= 6) & (run <= least(3)) & (run + 2 < common[owner])
    at = np.concatenate([np.flatnonzero(single), np.flatnonzero(two), np.flatnonzero(three)])
    where = np.repeat([0, 1, 2], [single.sum(), two.sum(), three.sum()])
    ahead = lambda k: token[np.minimum(at + k, len(token) - 1)]
    pair = _mixed(_mixed(token[at]) * _P + ahead(1))
    key = np.where(where == 0, _mixed(token[at]), pair)
    return owner[at], key, _mixed(pair * _P + ahead(2)), where == 2


def _prefixes(pdf):
    """uid, n, shared (how many tokens other texts hold) and keys of the texts gathered together."""
    import pandas as pd

    own = pdf[pdf["uids"].notna()].iloc[0]
    uids, sizes = np.frombuffer(own["uids"], "i8"), np.frombuffer(own["sizes"], "u4")
    owner = np.concatenate([np.frombuffer(x, "u2") for x in pdf["owners"]])
    token, kind = np.concatenate([np.frombuffer(x, "u8") for x in pdf["tokens"]]), np.concatenate([np.frombuffer(x, "u1") for x in pdf["classes"]])
    who, key, longer, has = prefix_keys(sizes, owner, token, kind)
    order = np.argsort(who, kind="stable")
    who, key, longer, has = who[order], key[order].view("i8"), longer[order].view("i8"), has[order]
    ends = np.searchsorted(who, np.arange(len(uids) + 1))
    bits = np.frombuffer(own["parity"], ">i8").reshape(-1, 8).astype("i8")
    cut = [slice(ends[i], ends[i + 1]) for i in range(len(uids))]
    return pd.DataFrame(
        {
            "uid": uids, "n": sizes.astype("i4"), "shared": np.bincount(owner, minlength=len(uids)).astype("i4"),
            "parity": [bits[i] if cut[i].stop > cut[i].start else None for i in range(len(uids))],
            "keys": [key[c] for c in cut], "longer": [longer[c] for c in cut], "extends": [has[c] for c in cut],
        }
    )


def _index(prefixes: DataFrame) -> DataFrame:
    """(key, uid, n, shared): keys with too many entries are extended."""
    entries = prefixes.select("uid", "n", "shared", F.explode(F.arrays_zip("keys", "longer", "extends")).alias("e")).select(F.col("e.keys").alias("key"), "uid", "n", "shared", "e.longer", "e.extends")
    crowded = entries.filter("extends").groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > LONG).select("key", F.lit(True).alias("crowded"))
    crowded = _small(saved(crowded, "crowded-keys"))
    key = F.when(F.col("crowded") & F.col("extends"), F.col("longer")).otherwise(F.col("key"))
    return saved(entries.join(crowded, "key", "left").select(key.alias("key"), "uid", "n", "shared"), "index")


def _compare_blocks(pdf):
    """Pairs of strangers (is_base false) and members in other components that sizes, shared tokens and parity don't rule out.

    A pair that is known to share a smaller crowded key is left to that key's task.
    """
    import pandas as pd

    base, query = pdf[pdf["is_base"]].reset_index(drop=True), pdf[~pdf["is_base"]].reset_index(drop=True)
    out_a, out_b = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
    if len(base) and len(query):
        key, none = int(pdf["key"].iloc[0]), np.iinfo("i8").max
        firsts = lambda df: np.array([(list(x) + [none] * FIRST_KEYS)[:FIRST_KEYS] for x in df["firsts"]], "i8")
        bits, b_firsts = np.stack(base["parity"].to_numpy()).view("u8"), firsts(base)
        n, shared, component, uid = (base[c].to_numpy("i8") for c in ("n", "shared", "component", "uid"))
        for at in range(0, len(query), 128):
            part = query.iloc[at : at + 128]
            own, q_firsts = np.stack(part["parity"].to_numpy()).view("u8"), firsts(part)
            q_n, q_shared, q_component, q_uid = (part[c].to_numpy("i8")[:, None] for c in ("n", "shared", "component", "uid"))
            total = q_n + n
            fits = (q_component != component) & (100 * np.minimum(q_n, n) >= PERCENT * np.maximum(q_n, n)) & ((100 + PERCENT) * np.minimum(q_shared, shared) >= PERCENT * total)
            differ = np.zeros(total.shape, "i8")
            for k in range(8):
                differ += np.bitwise_count(own[:, k, None] ^ bits[:, k])
            rows, columns = np.nonzero(fits & ((100 + PERCENT) * differ <= (100 - PERCENT) * total))
            for i in range(0, len(rows), 20_000):
                r, c = rows[i : i + 20_000], columns[i : i + 20_000]
                x = q_firsts[r][:, :, None]
                here = ~((x == b_firsts[c][:, None, :]) & (x < key)).any(axis=(1, 2))
                out_a.append(np.minimum(q_uid[r[here], 0], uid[c[here]]))
                out_b.append(np.maximum(q_uid[r[here], 0], uid[c[here]]))
    return pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)}).drop_duplicates()


def _crowd_pairs(entries: DataFrame) -> DataFrame:
    """Pairs (a, b) of strangers and members of crowded keys, block by block of their parities."""
    firsts = entries.groupBy("uid").agg(F.slice(F.array_sort(F.collect_set("key")), 1, FIRST_KEYS).alias("firsts"))
    rows = entries.join(firsts, "uid").withColumn("blocks", F.ceil(F.col("m") / CROWD_BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("uid", F.lit(4)), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    columns = ("key", "i", "j", "is_base", "uid", "n", "shared", "component", "parity", "firsts")
    base = rows.withColumn("i", every).withColumn("j", F.col("own")).withColumn("is_base", F.lit(True)).select(*columns)
    query = rows.filter("component <> main").withColumn("j", every).withColumn("i", F.col("own")).withColumn("is_base", F.lit(False)).select(*columns)
    return base.unionByName(query).groupBy("key", "i", "j").applyInPandas(_compare_blocks, "a long, b long")


def _verified(near: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole token sets reach the similarity."""
    near = saved(near, "near-pairs")
    wanted = _small(saved(near.select(F.col("a").alias("uid")).union(near.select("b")).distinct(), "wanted"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                yield pa.record_batch([part.column("uid"), pa.array([shingles(t.as_py()).view("i8") for t in part.column("text")], pa.list_(pa.int64()))], names=["uid", "tokens"])

    sets = saved(texts.join(wanted, "uid", "left_semi").mapInArrow(tokens, "uid long, tokens array<long>"), "token-sets", "none")
    first = near.join(sets.select(F.col("uid").alias("a"), F.col("tokens").alias("set_a")), "a")
    both = first.join(sets.select(F.col("uid").alias("b"), F.col("tokens").alias("set_b")), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.filter((100 + PERCENT) * common >= PERCENT * (F.size("set_a") + F.size("set_b"))).select("a", "b")


def _open(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Entries of keys whose members aren't all in one component, with their component, the key's first one and its size."""
    if labels is None:
        state = entries.withColumn("component", F.col("uid"))
    else:
        state = entries.join(labels.withColumnRenamed("node", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    keys = state.groupBy("key").agg(F.count("*").alias("m"), F.min("component").alias("low"), F.max("component").alias("high"), F.min_by(F.struct("component", "uid"), F.xxhash64("uid")).alias("main"))
    keys = _small(saved(keys.filter("low <> high").select("key", "m", F.col("main.component").alias("main"), F.col("main.uid").alias("first")), "open-keys"))
    return saved(state.join(keys, "key"), "open-index")


def _linked(index: DataFrame, texts: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(node, component) of the texts that are linked with another."""
    signs = prefixes.filter("parity is not null").select("uid", "parity")
    columns, size, share = ("key", "uid", "n", "shared"), index.count(), 1
    entries, labels = index, None
    while True:
        entries = _open(entries.select(*columns), labels)
        left, most = entries.agg(F.sum(F.when(F.col("component") != F.col("main"), F.col("m"))), F.max("m")).first()
        if not left:
            return labels
        last = share > 1 and (left <= EACH * size or share >= most)
        entries = entries.join(signs, "uid")
        strangers = entries.filter("component <> main")
        if last:  # each stranger with all members; those of crowded keys meet in tasks
            crowded = entries.filter(F.col("m") > FREQUENT)
            strangers, drawn = (df.filter(F.col("m") <= FREQUENT) for df in (strangers, entries))
        elif share == 1:
            drawn = entries.filter("uid = first")
        else:
            row = F.struct("key", "n", "shared", "component", "parity")
            strangers = strangers.groupBy("uid").agg(F.max_by(row, F.struct("m", "key")).alias("r")).select("uid", "r.*")
            drawn = entries.filter(F.pmod(F.xxhash64("uid", F.lit(6)), F.lit(1 << 30)) * F.col("m") < share << 30)
        a, b = (df.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("uid", "n", "shared", "component", "parity")]) for df, x in ((strangers, "a"), (drawn, "b")))
        total = F.col("n_a") + F.col("n_b")
        fits = (100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")) & ((100 + PERCENT) * F.least("shared_a", "shared_b") >= PERCENT * total)
        differ = sum((F.bit_count(F.col("parity_a")[k].bitwiseXOR(F.col("parity_b")[k])) for k in range(1, 8)), F.bit_count(F.col("parity_a")[0].bitwiseXOR(F.col("parity_b")[0])))
        near = a.join(b, "key").filter("component_a <> component_b").filter(fits).filter((100 + PERCENT) * differ <= (100 - PERCENT) * total)
        near = near.select(F.least("uid_a", "uid_b").alias("a"), F.greatest("uid_a", "uid_b").alias("b"))
        near = (near.union(_crowd_pairs(crowded)) if last else near).distinct()
        found = saved(_verified(near, texts), "links")
        labels = merged(labels, found)
        if last:
            return labels
        share *= MORE


def _group(rows: DataFrame) -> DataFrame:
    """uid, doc_id, n_shingles and component of numbered rows (uid, doc_id, text)."""
    of, texts = _distinct_texts(rows)
    size = rows.select(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(min(RANGE_BITS, max(3, np.ceil(np.log2(max(1, size / 6 / RANGE_TOKENS))))))
    frequent = FREQUENT
    returned = texts.mapInArrow(_scatter(bits, frequent), _SCATTERED).groupBy("bucket").applyInPandas(lambda pdf: _classify(pdf, frequent), _RETURNED)
    prefixes = returned.groupBy("gathered").applyInPandas(_prefixes, "uid long, n int, shared int, parity array<long>, keys array<long>, longer array<long>, extends array<boolean>")
    prefixes = saved(prefixes, "prefixes")
    labels = _linked(_index(prefixes), texts, prefixes)
    of = saved(spread_join(of, prefixes.select(F.col("uid").alias("rep"), "n"), ["rep"]), "sizes")
    if labels is None:
        grouped = of.withColumn("component", F.col("rep"))
    else:
        grouped = spread_join(of, labels.withColumnRenamed("node", "rep"), ["rep"]).withColumn("component", F.coalesce("component", "rep"))
    component = F.when(F.col("n") == 0, F.col("uid")).otherwise(F.col("component"))
    return saved(grouped.select("uid", "doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component")), "grouped")


def link_texts(docs: DataFrame) -> DataFrame:
    """One row a document: uid (of the row), doc_id, n_shingles and component (uid of the group).

    ``docs``: doc_id and text; other columns are left out.  Documents without words are groups of their own,
    even equal ones; repeated rows are one group; null ids are kept; an empty table gives no rows.  Whole
    texts are read and no key, group or pair is capped.  Rows are numbered once, in a written table.
    """
    return _group(saved(docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "documents"))


def similar_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id of the group) of every document; see ``link_texts``."""
    grouped = link_texts(docs)
    lowest = saved(grouped.groupBy("component").agg(F.min("doc_id").alias("component_id")), "lowest")
    return spread_join(grouped, lowest, ["component"]).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group stays, with its own columns: the smallest doc_id (null ids last, then the first row)."""
    numbered = saved(docs.withColumn("kept_uid", F.monotonically_increasing_id()), "documents")
    rows = numbered.select(F.col("kept_uid").alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "uid")
    grouped = _group(rows)
    kept = grouped.groupBy("component").agg(F.min(order).alias("k")).select(F.col("k.uid").alias("uid"))
    others = saved(grouped.select("uid").join(kept, "uid", "left_anti").select(F.col("uid").alias("kept_uid")), "dropped")
    return numbered.join(_small(others), "kept_uid", "left_anti").select(*docs.columns)
