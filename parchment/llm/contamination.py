"""Benchmark decontamination with a generalised suffix automaton of the items' words.

The items are cut into chunks of at most ``CHUNK_WORDS`` words by a Spark job.  One chunk after another
becomes an automaton (131 MB for 200,000 words, measured), is broadcast, scanned for and let go, so the
driver and a worker hold one chunk at a time; the hits are united by document.  While a document's words run through the automaton the
longest matching length is tracked; where it reaches the window, the window's words are hit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .store import extended, saved, slices

#: Words of an item window; words an automaton holds at most.
WINDOW, CHUNK_WORDS = 13, 200_000
#: Bytes that separate words: all below 0x80 but digits and letters; A-Z become a-z.
_TABLE = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of a text; null has none."""
    return text.encode().translate(_TABLE).split() if text else []


class Items:
    """Automaton of some items, and which items' windows end in a state."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        self.window, self.ids, strings = window, {}, []
        for item, text in items:
            w = words(text)
            if w:
                strings.append((item, [self.ids.setdefault(x, len(self.ids) + 1) for x in w]))
        self.auto = SuffixAutomaton()
        paths = [(item, s, self.auto.add(s)) for item, s in strings]
        self.least = min([window, *(len(s) for _, s in strings)], default=window)
        #: items whose window of full length ends in the state that holds it
        self.full: dict[int, set[str | None]] = {}
        #: short items: by state of the whole item, (words, items)
        self.short: dict[int, tuple[int, set[str | None]]] = {}
        link, length = self.auto.link, self.auto.length
        for item, s, _ in paths:
            # the path states may have been split since; the string is walked again
            state = matched = 0
            for k, x in enumerate(s):
                state, matched = self.auto.next[state][x], matched + 1
                while length[link[state]] >= window if link[state] >= 0 else False:
                    state = link[state]
                if k + 1 >= window:
                    self.full.setdefault(state, set()).add(item)
            if len(s) < window:
                while link[state] >= 0 and length[link[state]] >= len(s):
                    state = link[state]
                self.short.setdefault(state, (len(s), set()))[1].add(item)
        #: the nearest state up the suffix links that ends a short item
        self.up: dict[int, tuple[int, ...]] = {}
        if self.short:
            for state in range(len(link)):
                s, found = state, []
                while s > 0:
                    if s in self.short:
                        found.append(s)
                    s = link[s]
                if found:
                    self.up[state] = tuple(found)

    def scan(self, doc: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None], int]:
        """Hit spans (from, to), items with a window in the document, longest match in words."""
        get = self.ids.get
        x = np.fromiter((get(w, 0) for w in doc), "i4", len(doc))
        known = np.concatenate([[0], (x > 0).view("i1"), [0]])
        edge = np.flatnonzero(np.diff(known))
        starts, ends = edge[::2], edge[1::2]
        spans: list[tuple[int, int]] = []
        items: set[str | None] = set()
        longest, moves, link, length, window = 0, self.auto.next, self.auto.link, self.auto.length, self.window
        for a, b in zip(starts[(ends - starts) >= self.least].tolist(), ends[(ends - starts) >= self.least].tolist()):
            state = matched = 0
            for k, symbol in enumerate(x[a:b].tolist(), a + 1):
                to = moves[state].get(symbol)
                while to is None:
                    state = link[state]
                    matched = length[state]
                    to = moves[state].get(symbol)
                state, matched = to, matched + 1
                if matched >= window:
                    s = state
                    while link[s] >= 0 and length[link[s]] >= window:
                        s = link[s]
                    items |= self.full.get(s, ())
                    self._hit(spans, k - window, k)
                for s in self.up.get(state, ()):
                    n, own = self.short[s]
                    if n <= matched:
                        items |= own
                        self._hit(spans, k - n, k)
                longest = max(longest, matched)
        return sorted(spans), items, longest

    @staticmethod
    def _hit(spans: list[tuple[int, int]], a: int, b: int) -> None:
        while spans and spans[-1][1] >= a:
            c, d = spans.pop()
            a, b = min(a, c), max(b, d)
        spans.append((a, b))


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


HITS = "n_words long, spans array<struct<first:long,last:long>>, items array<string>, longest long"


def item_chunks(benchmark: DataFrame, most: int = CHUNK_WORDS) -> tuple[DataFrame, list[int]]:
    """The items (item, text, chunk) and the chunks' numbers; a chunk has at most ``most`` words and one item more.

    Rows without a word are left out.  Items are dealt to as many hash slices as there are chunks, about, and
    cut into chunks along the slice, so no task sees them all.
    """
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("words", F.regexp_count("text", F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))).filter("words > 0")
    total = rows.agg(F.sum("words")).first()[0] or 0
    if total <= most:
        return rows.select("item", "text", F.lit(0).cast("long").alias("chunk")), [0]
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("item", "text"), F.lit(-(-total // most))))
    before = Window.partitionBy("slice").orderBy(F.xxhash64("item", "text"), "item", "text").rowsBetween(Window.unboundedPreceding, -1)
    part = F.floor(F.coalesce(F.sum("words").over(before), F.lit(0)) / most)
    rows = saved(rows.select("item", "text", (F.col("slice") + part * F.lit(1 << 32)).alias("chunk")), "items")
    return rows, sorted(r[0] for r in rows.select("chunk").distinct().collect())


def scan_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every document with n_words, its hit word spans [first, last), the items found and the longest match in words.

    Columns of ``docs`` are kept; those named like the new ones are replaced.  Null and empty texts
    have no words and no hits; repeated rows and null ids are scanned as rows of their own; an empty
    benchmark hits nothing.  Item ids may be of any type and are given as strings; items without an id give
    hits, but aren't among the items found.
    """
    spark = docs.sparkSession
    kept = docs.select(*[c for c in docs.columns if c not in ("n_words", "spans", "items", "longest")])
    chunked, chunks = item_chunks(benchmark)

    def shared(chunk: int):
        own = chunked.filter(F.col("chunk") == chunk).select("item", "text").collect()
        return spark.sparkContext.broadcast(Items([tuple(r) for r in own], window))

    def scanned(df: DataFrame, items) -> DataFrame:
        schema = extended(df, HITS)
        span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = items.value
            for b in slices(batches):
                cols: tuple[list, ...] = ([], [], [], [])
                for text in b.column("text"):
                    w = words(text.as_py())
                    spans, own, longest = found.scan(w)
                    for c, v in zip(cols, (len(w), [{"first": x, "last": y} for x, y in spans], sorted(own - {None}), longest)):
                        c.append(v)
                yield pa.record_batch([*b.columns, *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), span, pa.list_(pa.string()), pa.int64())))], names=[*b.schema.names, "n_words", "spans", "items", "longest"])

        return df.mapInArrow(run, schema)

    if len(chunks) == 1:
        return scanned(kept, shared(chunks[0]))
    # a larger benchmark: one chunk after another is built, scanned for, written and let go; a row's hits are united
    rows = saved(kept.withColumn("row", F.monotonically_increasing_id()), "documents")
    parts = rows.select("row", F.lit(None).cast("array<struct<first:long,last:long>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"), F.lit(0).cast("long").alias("longest"), F.lit(0).cast("long").alias("n_words"))
    for chunk in chunks:
        items = shared(chunk)
        parts = parts.unionByName(saved(scanned(rows.select("row", "text"), items).drop("text").filter("longest > 0 or n_words > 0"), "hits"))
        items.destroy()
    flat = parts.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("raw"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"))
    merged = flat.mapInPandas(_unite, f"row long, {HITS}")
    return rows.join(merged, "row").drop("row")


def _unite(frames):
    for pdf in frames:
        pdf["spans"] = [[{"first": a, "last": b} for a, b in united([(x["first"], x["last"]) for x in raw])] for raw in pdf.pop("raw")]
        yield pdf[["row", "n_words", "spans", "items", "longest"]]


def hit_columns(scanned: DataFrame) -> DataFrame:
    """Add n_hit and contaminated (n_hit > 0 and 20 * n_hit >= n_words)."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"])
    return scanned.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def remove_spans(scanned: DataFrame) -> DataFrame:
    """Add clean_text: the text of contaminated documents without the hit words; other texts stay as they are."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            pdf["clean_text"] = pd.Series([_cut(t, s) if c else t for t, s, c in zip(pdf["text"], pdf["spans"], pdf["contaminated"])], index=pdf.index, dtype=object)
            yield pdf

    return scanned.mapInPandas(run, extended(scanned, "clean_text string"))


def _cut(text: str, spans) -> str:
    raw = text.encode()
    plain, at = raw.translate(_TABLE), 0
    bounds = []
    for w in plain.split():
        a = plain.index(w, at)
        bounds.append((a, a + len(w)))
        at = a + len(w)
    out, at = [], 0
    for s in spans:
        out.append(raw[at : bounds[s["first"]][0]])
        at = bounds[s["last"] - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that aren't contaminated, with their own columns; contaminated ones go.

    Null and empty texts stay, repeated rows are judged alike, an empty table gives no rows.
    """
    return hit_columns(scan_documents(docs, benchmark)).filter(~F.col("contaminated")).select(*docs.columns)
