import random

import pytest

import parchment.llm.jaccard as J

SCHEMA = "doc_id long, text string"


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    lowest = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            lowest[find(k)] = min(d, lowest.get(find(k), d))
    return sorted(((d, len(sets[k]), lowest.get(find(k))) for k, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(map(tuple, J.similar_groups(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def corpus(seed, n=160):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(r.choice(words) for _ in range(60))
    rows = []
    bases = [[r.choice(words) for _ in range(r.choice([4, 5, 6, 9, 20, 60, 150]))] for _ in range(12)]
    for k in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            w[r.randrange(len(w))] = r.choice(words)
        if r.random() < 0.3:
            w = w[: r.randrange(1, len(w) + 1)]
        if r.random() < 0.3:
            w = passage.split() + w[: r.randrange(len(w))]
        rows.append((k, r.choice([" ", "\n", "\t "]).join(w).upper() if r.random() < 0.2 else " ".join(w)))
    return rows


@pytest.mark.parametrize("seed, frequent, long", [(1, 100, 1024), (2, 3, 5), (3, 8, 20), (4, 1, 2), (5, 1, 1024), (6, 2, 1)])
def test_against_brute_force(spark, monkeypatch, seed, frequent, long):
    monkeypatch.setattr(J, "FREQUENT", frequent)
    monkeypatch.setattr(J, "LONG", long)
    rows = corpus(seed)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(4)) == brute(rows)


@pytest.mark.parametrize("frequent, long, each, block", [(64, 1024, 500, 4096), (5, 30, 0, 16), (8, 30, 500, 16)])
def test_crowds(spark, monkeypatch, frequent, long, each, block):
    """Many mutated copies of one text: pairs near the bound, linked by way of others; middle rounds and small blocks."""
    monkeypatch.setattr(J, "FREQUENT", frequent)
    monkeypatch.setattr(J, "EACH", each)
    monkeypatch.setattr(J, "CROWD_BLOCK", block)
    monkeypatch.setattr(J, "LONG", long)
    r = random.Random(7)
    base = [f"w{r.randrange(300)}" for _ in range(90)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 6])):
            w[r.randrange(len(w))] = f"x{r.randrange(1000)}"
        rows.append((k, " ".join(w)))
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_small_sets_with_frequent_tokens(spark, monkeypatch):
    """Sets of 1 to 12 shingles, where a run of three may not exist."""
    monkeypatch.setattr(J, "FREQUENT", 2)
    monkeypatch.setattr(J, "LONG", 3)
    r = random.Random(3)
    rows = []
    for k in range(240):
        base = [f"b{k % 7}-{i}" for i in range(r.choice([5, 6, 8, 9, 10, 11, 13, 16]))]
        cut = r.choice([0, 0, 0, 1])
        rows.append((k, " ".join(base[cut:] + r.choice([[], [], ["x"], [f"y{k % 3}"]]))))
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_splits_do_not_matter(spark, tmp_path):
    """Passes with other splits and cores number rows alike, as they are numbered once."""
    rows = corpus(9)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "d"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    number, linked = J._group, []
    try:
        J._group = lambda df: (spark.conf.set("spark.sql.files.maxPartitionBytes", "3000"), number(df))[1]
        linked = got(spark.read.parquet(str(tmp_path / "d")))
    finally:
        J._group = number
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert linked == brute(rows)


def test_empty_texts_nulls_and_repeats(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, ""), (5, "a b"), (6, "A  b"), (6, "A  b"), (None, "a b"), (None, "x"), (9, "É a b c d e"), (10, "é a b c d e"), (11, "a b c d e " * 4000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as uid", "2 as rep", "'k' as key", "3L as component")
    assert got(df) == brute(rows)
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_keep_one(spark):
    rows = [(3, "a b c d e f", "x"), (2, "a b c d e f", "y"), (5, "", "x"), (6, None, "x"), (None, "a b c d e f", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in J.keep_one(df).collect()) == [2, 5, 6]
    assert J.keep_one(df).columns == df.columns


@pytest.mark.parametrize("extended", [False, True])
def test_prefixes_of_linked_sets_share_a_key(extended):
    import numpy as np

    r = np.random.default_rng(1)
    pairs = 0
    for _ in range(3000):
        n = int(r.integers(1, 40))
        x = np.unique(r.integers(0, 1 << 40, n).astype("u8"))
        y = np.unique(np.concatenate([x[r.random(len(x)) < 0.93], r.integers(0, 1 << 40, int(r.integers(0, 3))).astype("u8")]))
        both = len(np.intersect1d(x, y))
        if not both or 100 * both < 80 * (len(x) + len(y) - both):
            continue
        pairs += 1
        share = r.choice([0.0, 0.1, 0.9])
        rare = {int(t) for t in np.union1d(x, y) if r.random() < share}
        keys = []
        for s in (x, y):
            held = np.array([t for t in s if t in x and t in y or int(t) % 2], "u8")
            kind = np.array([1 if int(t) in rare else 2 for t in held], "u1")
            _, key, longer, has = J.prefix_keys(np.array([len(s)], "u4"), np.zeros(len(held), "u2"), held, kind)
            keys.append(set(np.where(has & extended, longer, key).tolist()))
        assert keys[0] & keys[1]
    assert pairs > 500
