import hashlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

import parchment.llm.alignment as A
from parchment.llm.tokens import tokenizer_path

DOC = "doc_id long, text string"
ODD = [None, "", " ", "  a", "a  ", "\n  b", "a\n  b \n", "a\r  b", "x \r\n y", "x\xa0  b", "日本語 テキスト", "<|endoftext|> <s> x </s>", "▁a", "a▁", "don't I'll", "1234  56", "\x00a\x1f b", "é́", "a​b", "x" * 3000, " ".join(["word"] * 3000)]


@pytest.fixture(scope="module")
def own():
    return A.encoders(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def plain(own, text):
    """n_a, n_b, digest and links of one text, token by token."""
    if not text:
        return 0, 0, 0, "", []
    a, b, raw = own.a.encode(f" {text}", add_special_tokens=False).ids, own.b.encode(text), f" {text}".encode()
    token_bytes = own.a_bytes.to_pylist(), own.b_bytes.to_pylist()
    if any(b"".join(x[i] for i in ids) != raw for x, ids in zip(token_bytes, (a, b))):
        return 0, 0, 0, "", []
    spans = []
    for ids, lengths in zip((a, b), token_bytes):
        at, out = 0, []
        for i in ids:
            out.append((i, at, at := at + len(lengths[i])))
        spans.append(out)
    links, j = [], 0
    for i, low, high in spans[0]:
        while spans[1][j][2] <= low:
            j += 1
        k = j
        while k < len(b) and spans[1][k][1] < high:
            links.append((i, spans[1][k][0]))
            k += 1
    ends = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
    shown = [{e: [] for e in ends} for _ in spans]
    for side, out in zip(spans, shown):
        at = iter(ends)
        to = next(at)
        for i, _, e in side:
            out[to].append(str(i))
            to = next(at, None) if e == to else to
    groups = ";".join(f"{','.join(shown[0][e])}|{','.join(shown[1][e])}" for e in ends)
    return len(a), len(b), len(ends), hashlib.sha256(groups.encode()).hexdigest(), links


def expected(own, rows):
    found = [(i, *plain(own, t)) for i, t in rows]
    count = Counter(x for f in found for x in f[-1])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return Counter((i, a, b, g, len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x), d) for i, a, b, g, d, x in found)


def given(df):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_odd_texts_and_batches(spark, own, monkeypatch):
    """Repeated rows, null ids and texts that a tokenizer doesn't give back, over many small batches."""
    monkeypatch.setattr(A, "GATHERED", 500)
    rows = list(enumerate(ODD)) + [(None, "again and again"), (3, "  a"), (3, "  a")]
    assert given(A.align_documents(spark.createDataFrame(rows, DOC).repartition(3))) == expected(own, rows)


def test_documents(spark, sf, own):
    from parchment.llm.queries import op11_tokenizer_alignment

    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    assert given(op11_tokenizer_alignment(spark, sf)) == expected(own, rows)


def test_chunks_are_encoded_alike(own):
    for text in filter(None, ODD):
        ids = own.ids(own.chunks(text))
        if all(a for a, _ in ids):
            assert np.frombuffer(b"".join(a for a, _ in ids), "i4").tolist() == own.a.encode(f" {text}", add_special_tokens=False).ids
            assert np.frombuffer(b"".join(b for _, b in ids), "i4").tolist() == own.b.encode(text)


def test_empty_table_and_clashing_columns(spark):
    assert A.align_documents(spark.createDataFrame([], DOC)).count() == 0
    rows = [(1, "one two", 7, "x", 2), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, f"{DOC}, batch long, pair string, code int")
    assert sorted(r.doc_id for r in A.align_documents(df).collect()) == [1, 2]
