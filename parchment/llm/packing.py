"""Best-fit-decreasing packing into rows of token ids, task by task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import slices
from .tokens import token_ids, tokenizer_path

ROWS = "sequence_id long, n_tokens int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, ids binary, positions binary"


class Capacities:
    """Multiset of the room left in open rows; a segment tree finds the least room that suffices."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room of ``need`` or more, and that room."""
        i = need + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.leaves
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of indexes of ``sizes``: longest first, each into the fullest row that holds it."""
    open_rows, rows = Capacities(length), []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        found = open_rows.take(sizes[k])
        if found is None:
            rows.append([])
            found = len(rows) - 1, length
        rows[found[0]].append(k)
        open_rows.put(found[1] - sizes[k], found[0])
    return rows


def pack_best_fit(docs: DataFrame, tokenizer: str | None = None, length: int = 2048, end_id: int = 2, pad_id: int = 0, group_tokens: int = 4_000_000) -> DataFrame:
    """Pack whole documents into rows of exactly ``length`` ids.

    ``docs``: doc_id and text; other columns are left out.  Documents longer than a row are cut into
    full rows and one rest, losslessly.  Each task packs groups of about ``group_tokens`` tokens, so
    nothing is shuffled and memory is bounded.  A row holds padded ids and positions that restart in
    each segment (both little-endian unsigned 32 bit), the documents and offsets of its segments and
    their cumulative lengths from 0.  A null or empty text is its end id alone; null and repeated ids
    stay rows of their own; an empty table gives no rows.
    """
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = token_ids(path), np.array([end_id], dtype="<u4").tobytes()
        number, pieces, held = TaskContext.get().partitionId() << 40, [], 0

        def flush():
            nonlocal number, pieces, held
            rows = best_fit([len(p[2]) // 4 for p in pieces], length)
            for at in range(0, len(rows), 2048):
                cols: list[list] = [[] for _ in range(7)]
                for row in rows[at : at + 2048]:
                    parts = [pieces[k] for k in row]
                    sizes = [len(p[2]) // 4 for p in parts]
                    n = sum(sizes)
                    pos = np.zeros(length, "<u4")
                    pos[:n] = np.concatenate([np.arange(s, dtype="<u4") for s in sizes])
                    full = b"".join(p[2] for p in parts) + np.full(length - n, pad_id, "<u4").tobytes()
                    for c, v in zip(cols, (number, n, [p[0] for p in parts], [p[1] for p in parts], [0, *np.cumsum(sizes).tolist()], full, pos.tobytes())):
                        c.append(v)
                    number += 1
                kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["sequence_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", "ids", "positions"])
            pieces, held = [], 0

        for b in slices(batches, 1000):
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                x = ids.ids(text.as_py()) + end
                for at in range(0, len(x), 4 * length):
                    pieces.append((doc, at // 4, x[at : at + 4 * length]))
                held += len(x) // 4
                if held >= group_tokens:
                    yield from flush()
        if pieces:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ROWS)


def write_packed(rows: DataFrame, path: str) -> None:
    """Write the packed rows as Parquet; one file a task, committed when the task ends."""
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
