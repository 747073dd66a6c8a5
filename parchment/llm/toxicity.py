"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

Letters reach the page through a channel that swaps them for look-alikes, repeats them, puts marks
between them or spaces them out.  A suspicious token becomes a lattice of what each character may
have been; a Viterbi search under a character trigram model of the whole corpus picks the likeliest
word.  Words (and their stems) of labelled rows whose share of toxic rows is high are the features;
a text's score is the noisy-or of the features in its restored words.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import held_out
from .store import extended, saved, slices

# What a mark or digit may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "(": "c", "+": "t", "€": "e", "£": "l", "¡": "i", "¢": "c",
}
#: Cost (nats) of a look-alike, of a repeated letter and of a mark between letters.
SWAP, REPEAT, NOISE = 1.0, 0.5, 1.5
#: Cost (nats) above the best way to split spaced letters up to which a place may start a word.
SPLIT = 6.0
#: Bounds: labelled rows learned from, features tried, features kept, entries of a worker's memo.
TRAIN_ROWS, CANDIDATES, FEATURES, MEMO = 60_000, 50_000, 5_000, 400_000
#: A feature needs so many toxic rows that no other explains, and such a share of its rows to be toxic.
LEAST_ROWS, LEAST_SHARE = 4, 0.7
#: Or a share this sure, in rows with so many different sets of the features kept.
SURE_SHARE, DIFFERENT = 0.97, 8
#: Score of a text without a feature; a score from this on means toxic.
FLOOR, THRESHOLD = 0.01, 0.3

_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
#: Classes of characters in the trigram counts: 0 is no letter, the last any other letter.
_CLASS = {c: k for k, c in enumerate(_LETTERS, 1)}
_OTHER = len(_LETTERS) + 1
_BASE = _OTHER + 1
_SPACED = re.compile(r"(?<!\S)(\S(?:\s+\S){2,})(?!\S)")
_AMOUNT = re.compile(r"[(+$€£¢]*[0-9]+[+$€£¢!]*|[(!¡|+]+")
_TRIM = re.compile(r"^[\W_]+|[\W_]+$")


def _class_table() -> np.ndarray:
    table = np.zeros(0x110000, "u1")
    for cp in range(0x3000):
        c = chr(cp)
        if c.isalpha():
            table[cp] = _CLASS.get(c.lower()[:1], _OTHER)
    table[0x3000:] = _OTHER
    return table


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n) of letter trigrams over all texts; grams are at most ``_BASE ** 3`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = _class_table(), np.zeros(_BASE**3, "i8")
        for b in batches:
            for text in b.column("text"):
                if text.is_valid:
                    x = table[np.frombuffer(f" {text.as_py()} ".encode("utf-32-le", "ignore"), "<u4")].astype("i4")
                    if len(x) > 2:
                        g = (x[:-2] * _BASE + x[1:-1]) * _BASE + x[2:]
                        total += np.bincount(g, minlength=_BASE**3)
        k = np.flatnonzero(total)
        yield pa.record_batch([pa.array(k, pa.int64()), pa.array(total[k], pa.int64())], names=["gram", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Restorer:
    """Viterbi over the lattice of a token under the trigram model."""

    def __init__(self, counts: list[tuple[int, int]]):
        tri = np.zeros(_BASE**3)
        for g, n in counts:
            tri[g] = n
        tri = tri.reshape(_BASE, _BASE, _BASE)
        bi, uni = tri.sum(0), tri.sum((0, 1))
        back = (bi + 5 * (uni / max(1.0, uni.sum()))[None, :]) / (bi.sum(1, keepdims=True) + 5) if uni.sum() else np.full((_BASE, _BASE), 1 / _BASE)
        self.cost = -np.log(np.maximum((tri + 5 * back[None]) / (tri.sum(2, keepdims=True) + 5), 1e-9))

    @cached_property
    def costs(self) -> list:
        """``cost`` as lists, which are quicker to read one by one."""
        return self.cost.tolist()

    def starts(self, letters: str) -> list[int]:
        """Where words may start in letters without blanks: a path with a blank there costs at most ``SPLIT`` more than the best."""
        cost, k = self.cost, [_CLASS.get(c, _OTHER) for c in letters]
        n, last = len(k), len(k) - 1
        # of letter i: the class before it, if it goes on a word (0) or starts one (1)
        past = [(k[i - 1] if i else 0, 0) for i in range(n)]
        step = lambda i, s, t: cost[past[i][s], k[i], k[i + 1]] if not t else cost[past[i][s], k[i], 0] + cost[k[i], 0, k[i + 1]]
        ahead, behind = [(np.inf, 0.0)], [tuple(cost[past[last][s], k[last], 0] for s in (0, 1))]
        for i in range(last):
            ahead.append(tuple(min(ahead[i][s] + step(i, s, t) for s in (0, 1)) for t in (0, 1)))
        for i in range(last - 1, -1, -1):
            behind.append(tuple(min(step(i, s, t) + behind[-1][t] for t in (0, 1)) for s in (0, 1)))
        behind.reverse()
        best = behind[0][1]
        return [i for i in range(n) if ahead[i][1] + behind[i][1] <= best + SPLIT]

    def word(self, token: str) -> str:
        """The likeliest letters behind ``token`` (lower case), however long it is."""
        cost = self.costs
        # state: the classes of the last two letters -> (cost, letters as a chain back to the first)
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for c in token:
            letter = c.isalpha()
            options = [(c, 0.0, _CLASS.get(c, _OTHER))] if letter else [(x, SWAP, _CLASS.get(x, _OTHER)) for x in LOOKALIKES.get(c, "")]
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (so_far, word) in states.items():
                row = cost[a][b]
                for x, extra, k in options:
                    value = so_far + extra + row[k]
                    if (b, k) not in new or value < new[b, k][0]:
                        new[b, k] = value, (word, x)
                    if word and word[1] == x:
                        value = so_far + extra + REPEAT
                        if (a, b) not in new or value < new[a, b][0]:
                            new[a, b] = value, word
                if not letter:
                    value = so_far + NOISE
                    if (a, b) not in new or value < new[a, b][0]:
                        new[a, b] = value, word
            states = new
        word = min(((so_far + cost[a][b][0], word) for (a, b), (so_far, word) in states.items()), key=lambda x: x[0], default=(0.0, None))[1]
        out = []
        while word:
            word, x = word
            out.append(x)
        return "".join(reversed(out))


def suspicious(token: str) -> bool:
    """Letters mixed with digits or marks, a letter three times in a row, or look-alikes alone unless they are a number or an amount."""
    if token.isalpha():
        return any(a == b == c for a, b, c in zip(token, token[1:], token[2:]))
    if any(c.isalpha() for c in token):
        return True
    alike = [c for c in token if c in LOOKALIKES]
    return len(alike) > 2 and len(set(alike)) > 1 and not _AMOUNT.fullmatch("".join(alike))


def stems(word: str) -> tuple[str, ...]:
    """A word and its first 4, 5 and 6 letters as features."""
    return (word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) > n))


class Reader:
    """Features of texts; every chunk's are found once and kept in a bounded memo."""

    def __init__(self, restorer: Restorer, known: dict[str, float] | None = None):
        self.restorer, self.known, self.memo = restorer, known, {}
        #: lengths of known words of three letters or more
        self.lengths = sorted({len(k) for k in known or () if not k.endswith("*") and len(k) > 2})

    def _features(self, chunk: str) -> tuple[str, ...]:
        """Of the chunk as written and as restored."""
        plain = _TRIM.sub("", chunk.lower())
        out: list[str] = list(stems(plain)) if plain.isalpha() else []
        core = chunk.lower()
        if suspicious(core.rstrip(".,;:?\"')")):
            for form in {core.rstrip(".,;:?\"')"), plain}:
                if suspicious(form):
                    out += stems(self.restorer.word(form))
        found = dict.fromkeys(f for f in out if f and (self.known is None or f in self.known))
        return tuple(found)

    def _spaced(self, letters: str) -> tuple[str, ...]:
        """Of single letters in a row: known words of three letters or more inside it, as letters near it may be words of their own, and stems where a word may start."""
        if self.known is None:
            return self._features(letters)
        forms = {letters, self.restorer.word(letters)} if suspicious(letters) else {letters}
        found = {p for f in forms for n in self.lengths for a in range(len(f) - n + 1) if (p := f[a : a + n]) in self.known}
        for f in forms:
            heads = {a: own for a in range(len(f) - 4) if (own := [x for x in stems(f[a : a + 7])[1:] if x in self.known])}
            if heads:
                found.update(x for a in self.restorer.starts(f) for x in heads.get(a, ()))
        return tuple(sorted(found))

    def features(self, text: str | None) -> set[str]:
        if not text:
            return set()
        memo, found = self.memo, set()
        if len(memo) > MEMO:
            memo.clear()
        for c in text.split():
            f = memo.get(c)
            if f is None:
                f = self._features(c)
                if len(c) <= 64:
                    memo[c] = f
            if f:
                found.update(f)
        if len(text) > 4:
            for run in _SPACED.findall(text):
                found.update(self._spaced("".join(run.split()).lower()))
        return found

    def score(self, text: str | None) -> float:
        clean = 1.0 - FLOOR
        for f in sorted(self.features(text)):
            clean *= 1.0 - self.known[f]
        return 1.0 - clean


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of at most ``most`` labelled rows that aren't held out, by hash of the id; equal texts once."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic is not null").filter(~held_out("id"))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(most)
    # at most ``most`` ids of 12 bytes
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "id")
    return rows.filter("text is not null").groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("n")).agg(F.max("toxic").alias("toxic"), F.min_by("text", "id").alias("text")).select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[int, int]], dict[str, float]]:
    """Trigram counts of all texts, and the share of toxic rows for each feature kept."""
    spark = docs.sparkSession
    counts = [tuple(r) for r in trigram_counts(docs).collect()]  # at most _BASE ** 3 rows
    restorer = spark.sparkContext.broadcast(Restorer(counts))
    rows = saved(labelled_rows(docs, labels), "labelled-rows")

    def count(batches: Iterator[pa.RecordBatch], known: set[str] | None = None) -> Iterator[pa.RecordBatch]:
        reader, pos, neg = Reader(restorer.value), Counter(), Counter()

        def flush():
            keys = list(dict.fromkeys([*pos, *neg]))
            out = pa.record_batch([pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())], names=["feature", "pos", "neg"])
            pos.clear()
            neg.clear()
            return out

        for b in batches:
            for text, toxic in zip(b.column("text"), b.column("toxic").to_pylist()):
                (pos if toxic else neg).update(reader.features(text.as_py()))
                if len(pos) + len(neg) > 150_000:
                    yield flush()
        yield flush()

    sums = rows.mapInArrow(count, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    share = (F.col("pos") + 0.5) / (F.col("pos") + F.col("neg") + 1)
    kept = sums.filter((F.col("pos") >= LEAST_ROWS) & (share >= LEAST_SHARE)).orderBy(F.desc("pos"), "feature").limit(CANDIDATES)
    shares = {r["feature"]: (r["pos"] + 0.5) / (r["pos"] + r["neg"] + 1) for r in kept.collect()}
    number = spark.sparkContext.broadcast({f: k for k, f in enumerate(shares)})

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(restorer.value, number.value)
        for b in batches:
            yield pa.record_batch([pa.array([sorted(number.value[f] for f in reader.features(t.as_py())) for t in b.column("text")], pa.list_(pa.int32()))], names=["features"])

    # at most TRAIN_ROWS rows, toxic ones only
    found = [r[0] for r in rows.filter("toxic = 1").select("text").mapInArrow(candidates, "features array<int>").collect()]
    return counts, explaining(found, list(shares.items()))


def explaining(rows: list[list[int]], features: list[tuple[str, float]]) -> dict[str, float]:
    """Features that explain the toxic rows: again and again the one in most rows that no other explains yet.

    Words that only keep toxic words company (of a copied text, say) explain nothing more and aren't kept,
    unless the company differs from row to row.
    """
    of: dict[int, set[int]] = {}
    for i, r in enumerate(rows):
        for k in r:
            of.setdefault(k, set()).add(i)
    # worth: rows, much less for a share below 1; a feature's rows only become fewer, so an outdated worth is an upper bound
    worth = lambda n, k: -n * features[k][1] ** 8
    heap = [(worth(len(v), k), k) for k, v in of.items()]
    heapq.heapify(heap)
    left, chosen = set(range(len(rows))), {}
    while heap and len(chosen) < FEATURES:
        _, k = heapq.heappop(heap)
        new = of[k] & left
        if len(new) < LEAST_ROWS:
            continue
        if heap and worth(len(new), k) > heap[0][0]:
            heapq.heappush(heap, (worth(len(new), k), k))
            continue
        chosen[features[k][0]] = features[k][1]
        left -= new
    # a toxic word whose rows hold others too: they are many and differ, while copies hold the same ones
    held = [frozenset(k for k in r if features[k][0] in chosen) for r in rows]
    for k, own in of.items():
        if features[k][0] not in chosen and features[k][1] >= SURE_SHARE and len({held[i] for i in own}) >= DIFFERENT and len(chosen) < FEATURES:
            chosen[features[k][0]] = features[k][1]
    # words that a kept stem covers: they mark no other plain text, but spaced letters are searched for whole words
    for word, share in features:
        if word not in chosen and any(x in chosen for x in stems(word)[1:]):
            chosen[word] = share
    return chosen


def score(docs: DataFrame, labels: DataFrame, model: tuple | None = None) -> DataFrame:
    """Add toxicity (0 to 1), toxic (toxicity >= 0.3) and held_out to every document.

    Only text enters a score.  Null and empty texts get the floor score; without labels nothing is
    toxic.  Whole texts are read; repeated rows and null ids are kept; columns of these three names are
    replaced.
    """
    spark = docs.sparkSession
    counts, known = learn(docs, labels) if model is None else model
    shared = spark.sparkContext.broadcast((Restorer(counts), known))
    rest = docs.select(*[c for c in docs.columns if c not in ("toxicity", "toxic")]).withColumn("held_out", held_out())
    schema = extended(rest, "toxicity double, toxic int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*shared.value)
        for b in slices(batches):
            s = [reader.score(t.as_py()) for t in b.column("text")]
            yield pa.record_batch([*b.columns, pa.array(s, pa.float64()), pa.array([int(x >= THRESHOLD) for x in s], pa.int32())], names=[*b.schema.names, "toxicity", "toxic"])

    return rest.mapInArrow(run, schema)


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that aren't toxic, with their own columns."""
    return score(docs, labels).filter(F.col("toxic") == 0).select(*docs.columns)
