import re
from collections import Counter
from itertools import permutations

import parchment.llm.filter_audit as A

DOC, LABEL = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def expected(docs, labels):
    """Every order run over the documents one by one."""
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    fails = []
    for i, t, s in docs:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        e = t in first and (i is None or first[t] < i)
        tests = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": e}
        fails.append((s or "", {k for k, v in tests.items() if v}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order):
                gone = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                again = sum(x in f[1] and bool(f[1] & set(order[:step])) for f in own)
                out[part, "".join(order), step + 1] = (len(left), len(gone), again, sum(f[1] == {x} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone))
                shapley[part, x] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


LONG = " ".join(f"w{k}" for k in range(300))
DOCS = [
    (1, LONG, "a"), (2, LONG, "a"), (2, LONG, "b"), (3, LONG + " $5", "a"), (4, None, None), (5, "", ""), (6, "Few Words", "b"), (7, "few words", "b"), (8, "é" * 60 + " A", "b"),
    (None, LONG, "a"), (None, "only once", "c"), (None, "only once", "c"), (9, "x " * 100_000, "c"), (10, LONG.upper(), None), (11, "tab\tand\x0bline\nblank", "c"), (12, "a\xa0b", "c"), (12, "a\xa0b", "c"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, 1), (6, 1, 1), (99, 1, 1), (None, 1, 1), (10, 1, 0)]


def test_every_order(spark):
    df = A.audit_filters(spark.createDataFrame(DOCS, DOC).repartition(3), spark.createDataFrame(LABELS, LABEL))
    assert found(df) == expected(DOCS, LABELS)


def test_the_limit_of_the_recursion_is_put_back(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    A.audit_filters(spark.createDataFrame(DOCS, DOC), spark.createDataFrame(LABELS, LABEL))
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


def test_many_parts_exceed_no_limit_of_rows(spark):
    """More recursion rows than a session's limit allows."""
    docs = [(k, f"text {k} $", f"part {k % 40}") for k in range(400)]
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        df = A.audit_filters(spark.createDataFrame(docs, DOC), spark.createDataFrame([], LABEL))
        assert df.count() == 40 * 600
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], LABEL)
    assert A.audit_filters(spark.createDataFrame([], DOC), none).count() == 0
    docs = spark.createDataFrame([(1, "one", "s", 3, "m", 1)], f"{DOC}, n int, mask string, good int")
    assert found(A.audit_filters(docs, none)) == expected([(1, "one", "s")], [])


def test_same_as_sql(same_as_sql):
    assert len(same_as_sql("op13_filter_audit")) % 600 == 0
