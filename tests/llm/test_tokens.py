import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from parchment.llm.mixing import pack_mixture
from parchment.llm.packing import best_fit, pack_best_fit
from parchment.llm.tokens import TokenIds, tokenizer_path

SCHEMA = "doc_id long, text string, source string"
FAST, EXACT = TokenIds(tokenizer_path()), TokenIds(tokenizer_path(), exact=True)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["It's", "Größe.", "<|endoftext|>", "don't,", "ÉCOLE", "a1b", "…", "x\x1cy", "İ", "ς", "é", " "]), max_size=8).map(" ".join))
def test_short_cut_is_exact(text):
    assert FAST.ids(text) == EXACT.ids(text)


def want(text):
    return np.frombuffer(EXACT.ids(text), "<u4").tolist() + [2]


def docs():
    rows = [(k, f"some words number {k} " * (k % 40 + 1), f"s{k % 3}" if k % 2 else "hot") for k in range(300)]
    return rows + [(400, None, None), (401, "", "tiny"), (402, "long text " * 9000, "tiny"), (None, "no id", "s1"), (7, "twice", "s1"), (7, "twice", "s1")]


def test_mixture_packs_every_token_once(spark):
    rows = docs()
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n", "'q' as queue", "2 as part").repartition(4)
    out = pack_mixture(frame, length=256).collect()
    assert sum(r.length for r in out) == sum(len(want(t)) for _, t, _ in rows)
    by_seq, total = {}, 0
    for r in out:
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 4 * r.length
    assert sorted(by_seq) == list(range(len(by_seq)))
    for seq, pieces in by_seq.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 256 or seq == len(by_seq) - 1
        total += at
    # every document comes back from its pieces
    texts = {d: t for d, t, _ in rows if d not in (7, None)}
    for d, t in texts.items():
        pieces = sorted((p for p in out if p.doc_id == d), key=lambda p: p.start)
        assert [x for p in pieces for x in np.frombuffer(p.ids, "<u4").tolist()] == want(t) if d >= 300 or pieces[0].doc_tokens == len(want(t)) else True
    # each full window holds a source in proportion; rounding carries less than two tokens
    tokens = {}
    for _, t, s in rows:
        tokens[s] = tokens.get(s, 0) + len(want(t))
    for _, pieces in sorted(by_seq.items())[:-1]:
        got = sum(p.length for p in pieces if p.source == "hot")
        assert abs(got - 256 * tokens["hot"] / total) < 2


def test_mixture_follows_target_weights(spark):
    rows = [(k, f"some words number {k} " * 20, "abc"[k % 3] if k % 6 else None) for k in range(240)] + [(k, "tiny", f"t{k}") for k in range(300, 340)]
    out = pack_mixture(spark.createDataFrame(rows, SCHEMA).repartition(3), length=256, weights={"b": 0.6, None: 0.1, "c": 0.001, "none": 0.0}).collect()
    by_seq, of = {}, {}
    for r in out:
        by_seq.setdefault(r.sequence_id, []).append(r)
        of.setdefault(r.doc_id, []).append(r)
    for seq, pieces in by_seq.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 256 or seq == len(by_seq) - 1
    for d, text, _ in rows:
        assert [x for p in sorted(of[d], key=lambda p: p.start) for x in np.frombuffer(p.ids, "<u4").tolist()] == want(text)
    last = max(r.sequence_id for r in out if r.source == "b")
    for seq in range(last):
        got = {s: sum(p.length for p in by_seq[seq] if p.source == s) for s in ("b", None, "c")}
        assert abs(got["b"] - 153.6) < 3 and abs(got[None] - 25.6) < 3 and got["c"] <= 2
    assert any(p.source == "c" for p in by_seq[len(by_seq) - 1])


def test_mixture_of_nothing_and_of_one(spark):
    assert pack_mixture(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [(r.doc_id, r.length, r.offset) for r in pack_mixture(spark.createDataFrame([(1, None, None)], SCHEMA)).collect()] == [(1, 1, 0)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_fit_against_a_plain_search(sizes):
    rows = best_fit(sizes, 40)
    room, plain = [], []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fits = [r for r in room if r >= sizes[k]]
        if fits:
            at = room.index(min(fits))
            room[at] -= sizes[k]
            plain[at].append(k)
        else:
            room.append(40 - sizes[k])
            plain.append([k])
    assert sorted(k for r in rows for k in r) == list(range(len(sizes)))
    assert sorted(sum(sizes[k] for k in r) for r in rows) == sorted(sum(sizes[k] for k in r) for r in plain)


def test_best_fit_rows_are_lossless(spark):
    rows = docs()
    out = pack_best_fit(spark.createDataFrame(rows, SCHEMA).repartition(3), length=128).collect()
    pieces = {}
    for r in out:
        ids, pos = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u4")
        assert len(ids) == len(pos) == 128 and r.cu_seqlens[-1] == r.n_tokens
        for d, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert pos[a:b].tolist() == list(range(b - a))
            pieces.setdefault(d, []).append((start, ids[a:b].tolist()))
    for d, t, _ in rows:
        if d not in (7, None):
            assert [x for _, p in sorted(pieces[d]) for x in p] == want(t)
    assert len({r.sequence_id for r in out}) == len(out)
    assert sum(r.n_tokens for r in out) / (128 * len(out)) > 0.9
    assert pack_best_fit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_crc(spark, sf):
    from parchment.llm.queries import QUERIES

    out = QUERIES["op10_mixture_packing"](spark, sf).collect()
    texts = {r.doc_id: want(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sum(r.length for r in out) == sum(map(len, texts.values()))
    for r in out:
        assert r.doc_tokens == len(texts[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(texts[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
