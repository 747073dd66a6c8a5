"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens.  In each window every queue is served its share of the window;
what integer rounding keeps back is its deficit and is served later.  With shares in proportion to
the queues' lengths the running total that queue ``s`` has been served after ``g`` tokens is
``floor(A_s g / T) - floor(A_{s-1} g / T)`` (``A``: running sum of queue lengths in queue order,
``T``: all tokens), so the deficit carried over any window, task or partition follows from ``g``
alone: no task waits for another, and all queues run dry together.  Queues too short for two tokens
a window share one queue, so a served total never falls.

With target weights the shares hold until a queue runs dry and are then renormalised, so what a queue is
due is piecewise linear in a virtual time and its phases follow from the queue sums (``Schedule``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import saved, slices
from .tokens import token_ids, tokenizer_path

TOKENS = "part int, row long, doc_id long, source string, n long, lo long, ids binary"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, source string"


class Schedule:
    """Served totals of queues under target weights: token j of a queue is due when its share has reached j + 1/2.

    Windows take tokens in the order they are due, ties by queue, so a queue's deficit is carried on,
    whatever its weight, and no served total falls.
    """

    def __init__(self, lengths: list[int], weights: list[float], window: int):
        self.n, self.window, self.total = np.array(lengths, "f8"), window, sum(lengths)
        self.ends, starts, rates = [], [], []
        done, w, at = np.zeros(len(lengths)), np.array(weights, "f8"), 0.0
        while (left := self.n - done).any():
            rate = np.where(left > 0, w, 0)
            rate = rate if rate.sum() > 0 else left  # weightless queues come when all others are dry
            rate = rate / rate.sum()
            need = np.divide(left, rate, out=np.full(len(left), np.inf), where=rate > 0)
            starts.append(done)
            rates.append(rate)
            at += need.min()
            done = np.where(need <= need.min() * (1 + 1e-12), self.n, np.minimum(self.n, done + rate * need.min()))
            self.ends.append(at)
        self.starts, self.rates, self.known = np.array(starts), np.array(rates), {}

    def _due(self, v: float) -> np.ndarray:
        k = int(np.searchsorted(self.ends, v))
        if k == len(self.ends):
            return self.n.astype("i8")
        due = self.starts[k] + self.rates[k] * (v - (self.ends[k - 1] if k else 0.0))
        if k + 1 < len(self.ends):  # rounding never leads beyond the next phase
            due = np.minimum(due, self.starts[k + 1])
        return np.minimum(np.floor(due + 0.5), self.n).astype("i8")

    def served(self, w: int) -> np.ndarray:
        """Tokens of each queue in the first ``w`` windows."""
        g = min(w * self.window, self.total)
        if g == self.total:
            return self.n.astype("i8")
        if w not in self.known:
            if len(self.known) > 10_000:
                self.known.clear()
            low, high = 0.0, self.ends[-1] + 1
            while (v := (low + high) / 2) not in (low, high):
                low, high = (v, high) if self._due(v).sum() <= g else (low, v)
            out = self._due(low)
            for q in np.flatnonzero(more := self._due(high) - out):
                out[q] += (take := min(int(more[q]), g - int(out.sum())))
                if not take:
                    break
            self.known[w] = out
        return self.known[w]


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """One row a document: ids and end id, and ``lo``, its offset in the queue of its source within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part, row, at = token_ids(path), TaskContext.get().partitionId(), 0, {}
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in slices(batches):
            out = {k: [] for k in ("row", "n", "lo", "ids")}
            for text, source in zip(b.column("text"), b.column("source").to_pylist()):
                x = ids.ids(text.as_py()) + end
                out["row"].append(row)
                out["n"].append(len(x) // 4)
                out["lo"].append(at.get(source, 0))
                out["ids"].append(x)
                at[source] = at.get(source, 0) + len(x) // 4
                row += 1
            k = b.num_rows
            yield pa.record_batch(
                [pa.array([part] * k, pa.int32()), pa.array(out["row"], pa.int64()), b.column("doc_id"), b.column("source"), pa.array(out["n"], pa.int64()), pa.array(out["lo"], pa.int64()), pa.array(out["ids"], pa.binary())],
                names=["part", "row", "doc_id", "source", "n", "lo", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).mapInArrow(run, TOKENS)


def pack_mixture(docs: DataFrame, tokenizer: str | None = None, length: int = 4096, end_id: int = 2, weights: dict[str | None, float] | None = None) -> DataFrame:
    """Pack every document into windows of ``length`` tokens, each window with every source's share.

    ``weights``: target shares of a window by source, at most 1 together; sources that aren't named have the
    rest, by their tokens.  A source that has run dry leaves its share to the others in proportion.
    Without weights the shares are the sources' own lengths.

    ``docs``: doc_id, text, source; other columns are left out.  A null or empty text is its end id
    alone; a null source is a queue of its own; repeated rows and null ids are packed as rows of their
    own.  Every token lies in one piece, windows are full but for the last, and an empty table gives no
    rows.  Returns the pieces with their ids (little-endian unsigned 32 bit).
    """
    spark = docs.sparkSession
    if weights and (min(weights.values()) < 0 or sum(weights.values()) > 1 + 1e-9):
        raise ValueError("weights are shares of a window: none below 0, at most 1 together")
    tokens = saved(tokenized(docs, tokenizer or tokenizer_path(), end_id), "tokens")
    sums = tokens.groupBy("part", "source").agg(F.sum("n").alias("n"))
    sums = saved(sums, "queue-sums")
    total = sums.agg(F.sum("n")).first()[0] or 0
    by_source = sums.groupBy("source").agg(F.sum("n").alias("n"))
    # at most length / 2 queues reach two tokens a window
    large = [tuple(r) for r in by_source.filter(F.col("n") * length >= 2 * total).orderBy(F.desc("n"), "source").limit(length // 2 + 1).collect()] if total else []
    named = {}
    if weights and total:
        given = spark.createDataFrame([(s,) for s in weights], "named string")
        named = dict(tuple(r) for r in by_source.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("named"))).select("source", "n").collect())
        large = [(s, named[s]) for s in weights if s in named] + [x for x in large if x[0] not in named]
    rest = total - sum(n for _, n in large)
    lengths = [n for _, n in large] + ([rest] if rest else [])
    if weights:
        shared, free = len(large), max(0.0, 1.0 - sum(weights.values()))
        others = sum(n for k, n in enumerate(lengths) if k >= len(named)) or 1
        plan = Schedule(lengths, [weights[s] for s, _ in large[: len(named)]] + [free * n / others for n in lengths[len(named) :]], length)
    elif rest and rest * length < 2 * total and len(lengths) > 1:  # the shared queue is itself too short: it joins the longest
        lengths = [lengths[0] + rest, *lengths[1:-1]]
        shared = 0
    else:
        shared = len(large)
    queues = spark.createDataFrame([(s, i) for i, (s, _) in enumerate(large)], "source string, queue int")
    own = sums.join(F.broadcast(queues), sums["source"].eqNullSafe(queues["source"]), "left").select(sums["part"], sums["source"], "n", F.coalesce("queue", F.lit(shared)).alias("queue"))
    before = Window.partitionBy("queue").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1)
    bases = saved(own.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", F.col("source").alias("of"), "queue", "base"), "queue-bases")
    if bases.count() <= 100_000:  # a few MB; beyond, the tables are joined by shuffle
        bases = F.broadcast(bases)
    placed = tokens.join(bases.withColumnRenamed("part", "in_part"), (F.col("part") == F.col("in_part")) & F.col("source").eqNullSafe(F.col("of")))
    plan = plan if weights else None
    ends = [0, *np.cumsum(np.array(lengths, dtype=object)).tolist()] if lengths else [0]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "source"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for b in slices(batches):
            out = []
            for r in b.to_pylist():
                low, high = ends[r["queue"]], ends[r["queue"] + 1]
                own, o, n, ids = high - low, r["base"] + r["lo"], r["n"], r["ids"]

                def served(w, low=low, high=high, q=r["queue"]):
                    if plan:
                        return int(plan.served(w)[q])
                    g = min(w * length, total)
                    return high * g // total - low * g // total

                if plan:  # the last window that begins before the token
                    w, top = 0, -(-total // length)
                    while w < top - 1:
                        half = (w + top) // 2
                        w, top = (half, top) if served(half) <= o else (w, half)
                else:
                    w = max(0, o * total // (own * length) - 1)
                got = served(w + 1)
                while got <= o:
                    w += 1
                    got = served(w + 1)
                at = 0
                while at < n:
                    take = min(n - at, got - o - at)
                    if take > 0:
                        g0, g1 = w * length, min((w + 1) * length, total)
                        first = int((plan.served(w + 1) - plan.served(w))[: r["queue"]].sum()) if plan else low * g1 // total - low * g0 // total
                        out.append((r["doc_id"], at, take, ids[4 * at : 4 * (at + take)], n, w, first + o + at - served(w), r["source"]))
                        at += take
                    if at < n:
                        w += 1
                        got = served(w + 1)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 8, kinds)], names=names)

    return placed.select("doc_id", "source", "n", "lo", "ids", "queue", "base").mapInArrow(cut, PIECES)
