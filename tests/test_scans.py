"""Running values, folds, medians and components over sliced keys, against plain loops."""

import datetime as dt
import random

import pytest

from parchment.operators import compare as C
from parchment.operators import graph as G
from parchment.operators import layout as L
from parchment.operators import outline as O
from parchment.operators import records as R
from parchment.operators import scans as S
from parchment.operators.helpers import asof_last, contains_join


def made(seed, n=400):
    r = random.Random(seed)
    return [(r.choice([1, 1, 1, 2, None]), r.choice([r.randrange(60), None]), k, r.choice([None, r.randrange(1000)])) for k in range(n)]


@pytest.mark.parametrize("how", ["last", "max", "min"])
@pytest.mark.parametrize("width", [1, 7, 1000])
def test_running(spark, how, width):
    rows = made(3)
    out = S.running(spark.createDataFrame(rows, "key int, place int, no int, v int").repartition(5), ["key"], ["place", "no"], "v", "got", how, width)
    expected, so_far = {}, {}
    for key, place, no, v in sorted(rows, key=lambda x: (x[1] is None, x[1] or 0, x[2])):
        old = so_far.get(key)
        so_far[key] = old if v is None else v if old is None or how == "last" else max(old, v) if how == "max" else min(old, v)
        expected[no] = so_far[key]
    assert {r.no: r.got for r in out.collect()} == expected
    assert out.columns == ["key", "place", "no", "v", "got"]


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_next_greater(spark, width):
    rows = [(k, p, no) for k, p, no, _ in made(4) if p is not None]
    out = S.next_greater(spark.createDataFrame(rows, "key int, page int, no int"), ["key"], "page", "next", width).collect()
    assert {r.no: r.next for r in out} == {no: min((q for j, q, _ in rows if j == k and q > p), default=None) for k, p, no in rows}


@pytest.mark.parametrize("width", [2, 10_000])
def test_asof_over_slices(spark, width):
    items = spark.createDataFrame([(1, p) for p in (0, 1, 5, 30, 31, 99)] + [(2, 4), (1, None)], "d int, p int")
    marks = spark.createDataFrame([(1, 1, 0, "a"), (1, 5, 1, "b"), (1, 5, 2, "c"), (1, 31, 3, "e"), (2, 5, 0, "x"), (1, None, 9, "nowhere")], "d int, page int, ord int, name string")
    out = asof_last(items, marks, ["d"], "p", "page", ["name"], width)
    assert sorted(((r.d, r.p, r.name) for r in out.collect()), key=str) == sorted([(1, 0, None), (1, 1, "a"), (1, 5, "c"), (1, 30, "c"), (1, 31, "e"), (1, 99, "e"), (2, 4, None), (1, None, None)], key=str)


def at(s):
    return None if s is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


@pytest.mark.parametrize("seconds", [5, 100, 10**6])
def test_run_state_over_slices(spark, seconds):
    """One run has most events; each slice's map is applied to the state the slice meets."""
    r = random.Random(5)
    names = [*R.TRANSITIONS, "unknown", None]
    rows = [(r.choice([1, 1, 1, 2, 3]), k, r.choice(names[:4] * 3 + names), r.choice([r.randrange(300), None if k % 50 == 0 else r.randrange(300)])) for k in range(500)]
    df = spark.createDataFrame([(a, b, c, at(d)) for a, b, c, d in rows], "run_id int, event_id int, status string, at timestamp").repartition(4)
    state, bad = R.run_state(df, ["at", "event_id"], seconds)
    now, rejected = {}, []
    for run, _, status, t in sorted(rows, key=lambda x: (x[3] is None, x[3] or 0, x[1])):
        s = now.get(run, "")
        if status in (("queued", "running") if s == "" else R.TRANSITIONS[s]):
            now[run] = status
        else:
            now.setdefault(run, "")
            rejected.append((run, status, s, at(t)))
    assert {x.run_id: x.status for x in state.collect()} == now
    assert sorted(map(str, map(tuple, bad.collect()))) == sorted(map(str, rejected))


@pytest.mark.parametrize("width", [3, 20, 10_000])
def test_edits_over_slices(spark, width):
    r = random.Random(6)
    rows, now = [], {}
    for k in range(300):
        key = r.choice(["a", "a", "a", "b", "c"])
        n = now.get(key, {"a": 4}.get(key, 0))
        named = r.choice([n, n, n, n + 1, n - 1, None])
        now[key] = n + (named == n)
        rows.append((1, key, k, named, f"h{k}"))
    r.shuffle(rows)
    current = spark.createDataFrame([(1, "a", 4)], "run_id int, section_key string, revision long")
    ok, bad = R.apply_edits(current, spark.createDataFrame(rows, "run_id int, section_key string, ord int, revision long, html string").repartition(3), width)
    now, accepted, rejected = {"a": 4}, [], []
    for _, key, k, named, html in sorted(rows, key=lambda x: x[2]):
        n = now.get(key, 0)
        if named == n:
            now[key] = n + 1
            accepted.append((key, html, n + 1))
        else:
            rejected.append((key, k, named, n))
    assert sorted((x.section_key, x.html, x.version_num) for x in ok.collect()) == sorted(accepted)
    assert sorted(map(str, ((x.section_key, x.ord, x.expected, x.actual) for x in bad.collect()))) == sorted(map(str, rejected))


def test_upper_medians(spark):
    r = random.Random(7)
    rows = [(k, r.choice([None, r.randrange(6)])) for k in range(6) for _ in range(r.randrange(1, 12))]
    out = {x.k: x.m for x in S.upper_medians(spark.createDataFrame(rows, "k int, v int"), ["k"], "v", "m").collect()}
    by = {}
    for k, v in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    assert out == {k: sorted(v)[len(v) // 2] for k, v in by.items()}


@pytest.mark.parametrize("small", [10_000, 20])
def test_components_within_keys(spark, monkeypatch, small):
    monkeypatch.setattr(G, "SMALL", small)
    r = random.Random(8)
    edges = [(r.choice("xy"), r.randrange(80), r.randrange(80)) for _ in range(90)] + [("z", k, k + 1) for k in range(60)]
    up = {}

    def find(k):
        while up.setdefault(k, k) != k:
            k = up[k]
        return k

    for key, a, b in edges:
        if a != b:
            a, b = find((key, a)), find((key, b))
            up[max(a, b)] = min(a, b)
    out = G.components(spark.createDataFrame(edges, "page string, a long, b long"), ["page"]).collect()
    assert {(x.page, x.node): x.component for x in out} == {k: find(k)[1] for k in up}
    assert G.components(spark.createDataFrame([], "page string, a long, b long"), ["page"]).columns == ["page", "node", "component"]


def test_clusters_of_a_crowded_page(spark):
    r = random.Random(9)
    boxes = [(1, r.choice([0, 0, 0, 1]), k, x := r.uniform(0, 900), y := r.uniform(0, 900), x + r.choice([2, 8, 30]), y + r.choice([5, 20])) for k in range(250)] + [(1, 2, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 2, 40.0, 0.0, 50.0, 10.0)]
    kept = [b for b in boxes if b[5] - b[3] > 3 and b[6] - b[4] > 3]
    up = {b[1:3]: b[1:3] for b in kept}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(kept):
        for b in kept[:i]:
            if a[1] == b[1] and a[3] - 30 <= b[5] and b[3] - 30 <= a[5] and a[4] - 30 <= b[6] and b[4] - 30 <= a[6]:
                x, y = find(a[1:3]), find(b[1:3])
                up[max(x, y)] = min(x, y)
    out = L.cluster_boxes(spark.createDataFrame(boxes, "doc_id int, page_idx int, id long, x0 double, y0 double, x1 double, y1 double")).collect()
    assert {(x.page_idx, x.id): x.cluster for x in out} == {k: find(k)[1] for k in up}


def test_pages_over_slices(spark):
    entries = spark.createDataFrame([(1, k, p, 0) for k, p in enumerate([3, None, 9, 2, None, 11, 4])], "doc_id int, ord int, page_idx int, printed_page int")
    offsets, n = spark.createDataFrame([], "doc_id int, offset int"), spark.createDataFrame([(1, 20)], "doc_id int, n_pages int")
    assert [r.page for r in O.monotone_pages(entries, offsets, n, width=2).orderBy("ord").collect()] == [4, 4, 10, 10, 10, 12, 12]


def test_texts_with_a_needle(spark):
    """Any length of needle; runs that nearly every text holds are no help and no harm."""
    r = random.Random(11)
    texts = ["".join(r.choice("aaab") for _ in range(r.randrange(0, 12))) for _ in range(60)] + ["né", "xaaaax", None]
    needles = ["a", "ab", "aab", "aaabaa", "bbbb", "é", "zzz", "", "xaaaax", "xaaaaxx", None]
    out = contains_join(spark.createDataFrame([(x,) for x in needles * 2], "n string"), "n", spark.createDataFrame([(x,) for x in texts], "t string"), "t").collect()
    assert sorted((x.n, x.t) for x in out) == sorted({(n, t) for n in needles for t in texts if n and t and n in t})


def longest(places):
    best = []
    for p in places:
        best.append(1 + max((b for q, b in zip(places, best) if q < p), default=0))
    return max(best, default=0)


@pytest.mark.parametrize("width", [3, 10_000])
def test_heading_changes(spark, width):
    """What keeps its order is as long as can be; every heading of both sides has one change; repeats stay where they are."""
    r = random.Random(12)
    e, a = [], []
    for doc in "xyz":
        own = [f"h{k}" for k in range(40)]
        new = [h for h in own if r.random() > 0.1]
        for _ in range({"x": 0, "y": 3, "z": 40}[doc]):
            new.insert(r.randrange(len(new)), new.pop(r.randrange(len(new))))
        for k in range(3):
            new.insert(r.randrange(len(new)), f"new {k}")
        e += [(doc, k, h) for k, h in enumerate(own)] + [(doc, 900, "Notes"), (doc, -1, "Notes"), (doc, 950, None)]
        a += [(doc, 10 * k, h) for k, h in enumerate(new)] + [(doc, 9000, "Notes"), (doc, -10, "Notes"), (doc, 9001, "Notes")]
    rows = C.heading_changes(spark.createDataFrame(e, "doc string, ord int, title string"), spark.createDataFrame(a, "doc string, ord int, title string"), "doc", width).collect()
    assert sorted((x.doc, x.e_ord) for x in rows if x.e_ord is not None) == sorted((d, k) for d, k, t in e if t)
    assert sorted((x.doc, x.a_ord) for x in rows if x.a_ord is not None) == sorted((d, k) for d, k, t in a if t)
    for doc in "xyz":
        there = {t: k for d, k, t in a if d == doc}
        both = [there[t] for d, k, t in e if d == doc and t in there and t != "Notes"]
        own = [x for x in rows if x.doc == doc]
        kept = sorted((x.e_ord, x.a_ord) for x in own if x.change == "kept" and x.title != "Notes")
        assert len(kept) == longest(both) and [p for _, p in kept] == sorted(p for _, p in kept)
        assert {x.title for x in own if x.change == "deleted"} == {t for d, _, t in e if d == doc and t and t not in there}
        assert {x.title for x in own if x.change == "inserted"} == {"new 0", "new 1", "new 2", "Notes"}
        assert sorted((x.e_ord, x.a_ord) for x in own if x.title == "Notes" and x.change == "kept") == [(-1, -10), (900, 9000)]
    assert not [x for x in rows if x.doc == "x" and x.change == "moved"]


@pytest.mark.parametrize("width", [3, 10_000])
def test_tables_stitched_over_pages(spark, width):
    """The latest page counts, on one page the ref captioned first; a ref's latest table is the one to go on from; two empty pages end all."""
    T = "doc_id int, page_idx int, id int, ref string, x0 double, x1 double, near_figure boolean"
    named = [(1, 0, 1, "b", 0.0, 50.0, False), (1, 0, 2, "a", 0.0, 50.0, False), (1, 1, 3, None, 0.0, 35.0, False), (1, 2, 4, None, 30.0, 50.0, False), (1, 3, 5, None, 0.0, 40.0, True), (1, 4, 6, None, 30.0, 50.0, False), (1, 7, 7, None, 30.0, 50.0, False)]
    r = random.Random(13)
    rows = named + [(2, r.randrange(60), k, r.choice([None, None, "3", "4", "5"]), x := r.uniform(0, 50), x + r.choice([0, 10, 60]), r.random() < 0.1) for k in range(120)]
    expected, last = {}, {}
    for d, p, k, ref, x0, x1, near in sorted(rows, key=lambda t: t[:3]):
        own = last.setdefault(d, {})
        if ref is None and not near and x1 > x0:
            best = -1
            for other, (q, a, b) in own.items():
                if 1 <= p - q <= 2 and (min(b, x1) - max(a, x0)) / (x1 - x0) >= 0.5 and q > best:
                    best, ref = q, other
        if ref is not None:
            own[ref] = (p, x0, x1)
        expected[d, k] = ref
    out = {(x.doc_id, x.id): x.stitched_ref for x in L.stitch_table_pages(spark.createDataFrame(rows, T), width).collect()}
    assert out == expected
    # page 2 goes on from "a", as the latest table of "b" is page 1's, which it doesn't cover by half
    assert [out[1, k] for k in range(1, 8)] == ["b", "a", "b", "a", None, "a", None]


def test_every_table_of_a_ref_may_go_on(spark, sf):
    """The query: a table that its ref's latest table doesn't cover goes on from an earlier one, up to two pages back."""
    from parchment.plans import layouts, records

    rows = layouts.blocks(spark, sf).select("doc_id", "block_no", "what", "number", "x0", "x1", "italic").orderBy("doc_id", "block_no").collect()
    every, latest = {}, {}
    for b in rows:
        for expected, alone in ((every, False), (latest, True)):
            ref = str(b.number) if b.what < 3 else None
            back = [(p, *expected.get((b.doc_id, p), (None, 0.0, 0.0))) for p in (b.block_no - 1, b.block_no - 2)]
            if ref is None and not b.italic:
                for n, (p, r, x0, x1) in enumerate(back):
                    if r and not (alone and n and r == back[0][1]) and (min(x1, b.x1) - max(x0, b.x0)) / (b.x1 - b.x0) >= 0.5:
                        ref = r
                        break
            expected[b.doc_id, b.block_no] = (ref, b.x0, b.x1)
    out = {(x.doc_id, x.id): x.stitched_ref for x in records.stitched_tables(spark, sf).collect()}
    assert out == {k: v[0] for k, v in every.items()}
    assert sum(v[0] is not None for v in every.values()) > sum(v[0] is not None for v in latest.values())


@pytest.mark.parametrize("width", [3, 10_000])
def test_every_table_of_the_last_pages(spark, width):
    """As above with several tables a page: a ref's tables count side by side, the latest page first, then the ref captioned first."""
    T = "doc_id int, page_idx int, id int, ref string, x0 double, x1 double, near_figure boolean"
    named = [(1, 0, 1, "b", 0.0, 50.0, False), (1, 0, 2, "a", 0.0, 50.0, False), (1, 1, 3, None, 0.0, 35.0, False), (1, 2, 4, None, 30.0, 50.0, False), (1, 2, 5, "c", 0.0, 9.0, False), (1, 2, 6, "c", 60.0, 69.0, False), (1, 3, 7, None, 0.0, 9.0, False), (1, 6, 8, None, 0.0, 9.0, False)]
    r = random.Random(14)
    rows = named + [(2, r.randrange(60), k, r.choice([None, None, "3", "4", "5"]), x := r.uniform(0, 50), x + r.choice([0, 10, 60]), r.random() < 0.1) for k in range(160)]
    expected, there, first = {}, [], {}
    for d, p, k, ref, x0, x1, near in sorted(rows, key=lambda t: t[:3]):
        if ref is not None:
            first.setdefault((d, ref), k + p * 1000)
        elif not near and x1 > x0:
            ref = min(((-q, first[d, o], o) for e, q, o, a, b in there if e == d and 1 <= p - q <= 2 and (min(b, x1) - max(a, x0)) / (x1 - x0) >= 0.5), default=(None,))[-1]
        if ref is not None:
            there.append((d, p, ref, x0, x1))
        expected[d, k] = ref
    out = {(x.doc_id, x.id): x.stitched_ref for x in L.stitch_table_pages(spark.createDataFrame(rows, T), width, every=True).collect()}
    assert out == expected
    # page 2 goes on from "b" of page 0, whose table of page 1 covers a quarter; page 3 from the first of two tables of "c"
    assert [out[1, k] for k in range(1, 9)] == ["b", "a", "b", "b", "c", "c", "c", None]
