"""Tokens of two tokenizers aligned by their byte ends, and how often each pair of ids is linked.

A batch of texts is one Arrow pipeline: lists of ids are flattened with their parents' indices, token lengths
are summed within each document, an Acero outer hash join on (document, end) lays both tokenizers' ends on one
line, and ``Table.group_by`` counts the linked id pairs of the batch.  Spark sums the partial counts, finds each
B id's highest one and joins them back to the batches.

An interval between two neighbouring ends lies in one A and one B token, and two overlapping tokens share one
such interval: the line's rows are the links.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import saved
from .tokens import _byte_letters, tokenizer_path

#: Characters of texts that a batch gathers (a longer text is a batch of its own), and chunks that each of a worker's two memos keeps the ids of.
GATHERED, MEMO = 2_000_000, 300_000
#: Blanks and what follows them: neither tokenizer joins a letter to a blank behind it.  Texts with other blanks are one chunk.
_CHUNK, _ODD = re.compile("[ \t\n\v\f]*[^ \t\n\v\f]+|[ \t\n\v\f]+"), re.compile("[\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_ROW = "batch long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary, code int, pair long, links long"
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Encoders:
    """Ids of a chunk by both tokenizers, their tokens' bytes, and whether those are the chunk's own."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        back = {letter: byte for byte, letter in _byte_letters().items()}
        pieces = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = pa.array([bytes(back[c] for c in p) if all(c in back for c in p) else p.encode() for p in pieces], pa.large_binary())
        self.b_bytes = pa.array([self._piece(i) for i in range(self.b.get_piece_size())], pa.large_binary())
        self.lead = len(self.b.encode("x"))
        # a chunk may be cut off where no piece joins a letter to a blank behind it
        self.cuts = not any(re.search("[^ \t\n\v\f][ \t\n\v\f]", p.decode("utf-8", "replace")) for p in self.b_bytes.to_pylist())
        self.memo: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def chunks(self, text: str | None) -> list[str]:
        """The chunks of a blank and the text."""
        if not text:
            return []
        return [f" {text}"] if not self.cuts or _ODD.search(text) else _CHUNK.findall(f" {text}")

    def _packed(self, raw: list[bytes], ids: list[list[int]], token_bytes: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """Ids of each chunk as 32-bit integers, and whether its tokens' bytes are its own."""
        flat = np.fromiter(chain.from_iterable(ids), "i4")
        ends = np.zeros(len(ids) + 1, "i8")
        np.cumsum(list(map(len, ids)), out=ends[1:])
        taken, packed, cuts = pc.take(token_bytes, pa.array(flat)), flat.tobytes(), (4 * ends).tolist()
        at, whole = np.frombuffer(taken.buffers()[1], "i8", len(flat) + 1)[ends], taken.buffers()[2]
        if (np.diff(at) == list(map(len, raw))).all() and memoryview(whole)[: at[-1]] == b"".join(raw):
            same = np.ones(len(raw), bool)
        else:
            same = np.array([whole[i:j].to_pybytes() == x for i, j, x in zip(at[:-1].tolist(), at[1:].tolist(), raw)], bool)
        return [packed[i:j] for i, j in zip(cuts, cuts[1:])], same

    def ids(self, chunks: list[str]) -> list[tuple]:
        """(A ids, B ids) of each chunk as 32-bit integers, empty ones if their bytes aren't its own."""
        memo, older = self.memo, self.older
        known = [memo.get(c) or older.get(c) for c in chunks]
        new = [c for c, k in zip(chunks, known) if not k]
        if new:
            raw = [c.encode() for c in new]
            a, same_a = self._packed(raw, [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)], self.a_bytes)
            b, same_b = self._packed(raw, [ids[self.lead :] for ids in self.b.encode([f"x{c}" for c in new], num_threads=1)], self.b_bytes)
            found = list(zip(a, b)) if (same := same_a & same_b).all() else [(x, y) if z else (b"", b"") for x, y, z in zip(a, b, same.tolist())]
            each = iter(found)
            known = [k or next(each) for k in known]
        if len(memo) >= MEMO:  # what is used again stays in the younger one
            self.memo, self.older = {}, memo
        self.memo.update((c, ids) for c, ids in zip(chunks, known) if len(c) <= 32)
        return known


_open: dict[tuple[str, str], Encoders] = {}


def encoders(a_path: str, b_path: str) -> Encoders:
    """Both tokenizers, once for each Python worker."""
    if (a_path, b_path) not in _open:
        _open[a_path, b_path] = Encoders(a_path, b_path)
    return _open[a_path, b_path]


def _ends(lists: pa.ListArray, doc: pa.Array, lengths: pa.Array, before: pa.Array, name: str) -> pa.Table:
    """(doc, end, token): the byte end of each token in its document."""
    token = pc.list_flatten(lists)
    parent = pc.take(doc, pc.list_parent_indices(lists))
    end = pc.subtract(pc.cumulative_sum(pc.take(lengths, token)), pc.take(before, parent))
    return pa.table({"doc": parent, "end": end, name: token})


def _joined(values: pa.Array, parent: np.ndarray, n: int, separator: str) -> pa.Array:
    """Strings joined by parent; parents ascend and each has at least one, or none at all."""
    offsets = np.searchsorted(parent, np.arange(n + 1)).astype("i8")
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, values), separator)


def align_batch(texts: list[str | None], own: Encoders) -> tuple[dict[str, list], pa.Table]:
    """Columns of the texts, and (code, pair, links) of the batch's id pairs; ``codes`` and ``times`` of a text refer to them."""
    flat, counts = [], []
    for text in texts:
        found = own.chunks(text)
        flat += found
        counts.append(len(found))
    coded = pa.array(flat, pa.string()).dictionary_encode()
    known = own.ids(coded.dictionary.to_pylist())
    code, doc = coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(texts)), counts)
    lost = np.zeros(len(texts), bool)
    lost[doc[np.array([not a for a, _ in known], bool)[code]]] = True
    kept = ~lost[doc]
    code, doc = pa.array(code[kept]), pa.array(doc[kept])
    size = np.array([0 if not t or gone else 1 + len(t.encode()) for t, gone in zip(texts, lost)], "i8")
    before = pa.array(np.cumsum(size) - size)
    sides = []
    for k, lengths in enumerate((own.a_bytes, own.b_bytes)):
        found = [ids[k] for ids in known]
        offsets = np.concatenate([[0], np.cumsum(list(map(len, found))) // 4]).astype("i4")
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(found), "i4")))
        sides.append(_ends(pc.take(lists, code), doc, pc.cast(pc.binary_length(lengths), pa.int64()), before, "ab"[k]))
    line = sides[0].join(sides[1], ["doc", "end"], join_type="full outer", use_threads=False).combine_chunks()
    line = line.take(pc.sort_indices(pc.add(pc.take(before, line["doc"]), line["end"])))
    has_a, has_b = (line[c].is_valid().to_numpy() for c in "ab")
    both, parent, n = has_a & has_b, line["doc"].to_numpy(), len(texts)
    group = np.cumsum(both) - both
    ids = {c: line[c].combine_chunks() for c in "ab"}
    shown = [_joined(pc.cast(ids[c].filter(pa.array(has)), pa.string()), group[has], int(both.sum()), ",") for c, has in (("a", has_a), ("b", has_b))]
    groups = _joined(pc.binary_join_element_wise(*shown, "|"), parent[both], n, ";").to_pylist()
    per_doc = lambda where: np.bincount(parent[where], minlength=n).tolist()
    pair = pc.bit_wise_or(pc.shift_left(pc.cast(pc.fill_null_backward(ids["a"]), pa.int64()), 32), pc.cast(pc.fill_null_backward(ids["b"]), pa.int64())).dictionary_encode()
    mine = pa.table({"doc": line["doc"], "code": pair.indices}).group_by(["doc", "code"], use_threads=False).aggregate([([], "count_all")]).sort_by("doc")
    total = mine.group_by("code", use_threads=False).aggregate([("count_all", "sum")])
    cut = np.searchsorted(mine["doc"].to_numpy(), np.arange(n + 1)).tolist()
    codes, times = mine["code"].to_numpy().astype("<u4"), mine["count_all"].to_numpy().astype("<u4")
    columns = {
        "n_a": per_doc(has_a), "n_b": per_doc(has_b), "n_groups": per_doc(both), "n_links": np.bincount(parent, minlength=n).tolist(),
        "groups_sha256": [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups],
        "codes": [codes[i:j].tobytes() for i, j in zip(cut, cut[1:])], "times": [times[i:j].tobytes() for i, j in zip(cut, cut[1:])],
    }
    return columns, pa.table({"code": total["code"].cast(pa.int32()), "pair": pc.take(pair.dictionary, total["code"]), "links": total["count_all_sum"]})


def _aligner(a_path: str, b_path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def row(batch: int, n: int, columns: dict) -> pa.RecordBatch:
        kinds = {"groups_sha256": pa.string(), "codes": pa.binary(), "times": pa.binary(), "code": pa.int32()}
        names = [c.split()[0] for c in _ROW.split(", ")]
        return pa.record_batch([pa.array([batch] * n, pa.int64()) if c == "batch" else pa.array(columns[c], kinds.get(c, pa.int64())) if c in columns else pa.nulls(n, kinds.get(c, pa.int64())) for c in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, first = encoders(a_path, b_path), TaskContext.get().partitionId() << 33

        def flush(no: int) -> Iterator[pa.RecordBatch]:
            columns, pairs = align_batch(texts, own)
            for i in range(0, len(texts), 1000):
                part = {"doc_id": doc_ids[i : i + 1000]} | {k: v[i : i + 1000] for k, v in columns.items()}
                yield row(first + no, len(part["doc_id"]), part)
            for b in pairs.to_batches(max_chunksize=50_000):
                yield row(first + no, b.num_rows, {c: b.column(c).to_numpy() for c in pairs.column_names})
            pa.default_memory_pool().release_unused()

        doc_ids, texts, n, no = [], [], 0, 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                doc_ids.append(doc_id)
                texts.append(text.as_py())
                n += len(texts[-1] or "")
                if n >= GATHERED:
                    yield from flush(no)
                    doc_ids, texts, n, no = [], [], 0, no + 1
        if doc_ids:
            yield from flush(no)

    return run


def _counted(left: pa.Table, right: pa.Table) -> pa.Table:
    """The texts of a batch with their links' counts (right: code, total, best)."""
    n = right.num_rows
    total, best = np.zeros(n, "i8"), np.zeros(n, "i8")
    at = right["code"].to_numpy()
    total[at], best[at] = right["total"].to_numpy(), right["best"].to_numpy()
    sums, hits = [], []
    for codes, times in zip(left["codes"].to_pylist(), left["times"].to_pylist()):
        c, t = np.frombuffer(codes, "<u4"), np.frombuffer(times, "<u4").astype("i8")
        sums.append(int((t * total[c]).sum()))
        hits.append(int((t * best[c]).sum()))
    return left.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"]).append_column("n_best", pa.array(hits, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64())).append_column("groups_sha256", left["groups_sha256"])


def aligned_batches(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Texts (code is null) and id pairs of the batches, in a written table."""
    paths = a_path or tokenizer_path("byte_bpe_50k.json"), b_path or tokenizer_path("piece_bpe_32k.model")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return saved(rows.mapInArrow(_aligner(*paths), _ROW), "aligned")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, total, best): links of every id pair (A id << 32 | B id) in all texts, and whether that is its B id's highest.

    The highest counts are one row a B id, so at most its vocabulary.
    """
    counts = rows.filter("code is not null").groupBy("pair").agg(F.sum("links").alias("total")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    counts = saved(counts, "pair-counts")
    highest = counts.groupBy("b").agg(F.max("total").alias("most"))
    return counts.join(F.broadcast(highest), "b").select("pair", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))


def align_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    ``docs``: doc_id and text; other columns are left out.  Null and empty texts, and texts that either tokenizer
    doesn't give back byte by byte, have no tokens: zeros and an empty digest.  Repeated rows and null ids are rows
    of their own and each counts; tied pairs are all best; an empty table gives no rows.  Whole texts are read; a
    batch holds ``GATHERED`` characters or one longer text.
    """
    rows = aligned_batches(docs, a_path, b_path)
    pairs = rows.filter("code is not null").select("batch", "code", "pair").join(pair_counts(rows), "pair").select(F.col("batch").alias("of"), "code", "total", "best")
    texts = rows.filter("code is null").select("batch", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times")
    return texts.groupBy("batch").cogroup(pairs.groupBy("of")).applyInArrow(_counted, _OUT)
