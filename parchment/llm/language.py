"""Language identification by cross-parsing entropy.

A bounded sample of labelled texts gives one suffix automaton a language.  A text is parsed into longest
matches with each automaton: a phrase goes on for as long as the sample holds it, over blanks and word
ends, and the next one starts where it broke.  Phrases are normalised to bits a letter,
``phrases * log2(automaton size) / letters``; the language with the fewest wins.

The automata of all languages are one hashed table of transitions, and many texts take a step at a time,
a symbol each under every language.  A phrase also ends after ``STRETCH`` symbols, so that long texts are
parsed in stretches beside each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .store import extended, slices

#: Bounds of the model: labelled texts learned a language, languages; texts of up to so many characters are learned first.
TRAIN_DOCS, LANGUAGES, TRAIN_LENGTH = 32, 1000, 10_000
#: Symbols of a stretch, stretches parsed beside each other.
STRETCH, BESIDE = 1024, 4096
_MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text leaves 2 by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, n: int = TRAIN_DOCS, most: int = LANGUAGES) -> list[tuple[str, str]]:
    """(lang, text) of at most ``n`` documents for each of the ``most`` commonest languages, by hash of the id.

    Rows that are held out or lack an id, a language or a text aren't learned; longer texts than
    ``TRAIN_LENGTH`` are learned where there aren't enough others.  Whole texts are learned.
    """
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    short = F.length("text") <= TRAIN_LENGTH
    counts = rows.groupBy("lang").agg(F.count_if(short).alias("short"), F.count("*").alias("m")).orderBy(F.desc("m"), "lang").limit(most).collect()
    if not counts:
        return []
    # a few times the wanted number passes the hash; the window sees no more than that
    share = lambda c: F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 16.0 * n / max(1, r[c])))])[F.col("lang")]
    key = F.xxhash64(F.col("doc_id"), F.lit(9))
    near = rows.withColumn("key", key).filter(F.pmod("key", F.lit(1 << 30)) < F.when(short, share("short")).otherwise(share("m")) * (1 << 30))
    order = Window.partitionBy("lang").orderBy(~short, "key", "text")
    chosen = near.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= n).select("lang", "k", "text")
    return [(r["lang"], r["text"]) for r in sorted(chosen.collect(), key=lambda r: (r["lang"], r["k"]))]


@cache
def _letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def symbols(text: str) -> tuple[np.ndarray, int]:
    """Code points of the lower-cased letters with one blank (32) before the text and for what is between letters; and the number of letters."""
    x = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[x]
    x = np.where(letter, x, 32)
    return x[np.concatenate([[True], letter[1:] | letter[:-1]])], int(letter.sum())


def train(sample: list[tuple[str, str]]) -> dict[str, SuffixAutomaton]:
    """One automaton a language over the running text of its sample."""
    texts: dict[str, list[list[int]]] = {}
    for lang, text in sample:
        x, n = symbols(text)
        texts.setdefault(lang, []).append(x.tolist() if n else [])
    return {lang: SuffixAutomaton(own) for lang, own in sorted(texts.items())}


class Parser:
    """Phrases of texts under every language; state ``s`` of a language is ``s`` plus the states of those before it."""

    def __init__(self, models: dict[str, SuffixAutomaton]):
        self.langs, automata = list(models), list(models.values())
        self.bits = np.array([math.log2(max(2, len(m.next))) for m in automata])
        points = sorted({c for m in automata for c in m.next[0]})
        self.code = np.zeros(0x110000, "u2" if len(points) < 65_535 else "u4")
        self.code[points] = np.arange(1, len(points) + 1)
        self.width = len(points) + 1
        self.roots = np.cumsum([0, *(len(m.next) for m in automata)])[:-1]
        #: where a phrase that starts with a symbol leads; the root where no sample has it
        self.first = np.tile(self.roots[:, None], (1, self.width))
        keys, to = [], []
        for k, m in enumerate(automata):
            base = int(self.roots[k])
            for s, moves in enumerate(m.next):
                for c, t in moves.items():
                    keys.append((base + s) * self.width + int(self.code[c]))
                    to.append(base + t)
            for c, t in m.next[0].items():
                self.first[k, self.code[c]] = base + t
        size = 1 << max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - size.bit_length() + 1), size - 1
        self.keys, self.to = np.full(size, -1, "i8"), np.zeros(size, "i4")
        keys, to = np.array(keys, "i8"), np.array(to, "i4")
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]] = keys[free]  # of several, the last one stays
            mine = self.keys[at] == keys
            self.to[at[mine]] = to[mine]
            keys, to, at = keys[~mine], to[~mine], (at[~mine] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view("u8") * _MIX) >> self.shift).astype("i8")

    def _next(self, keys: np.ndarray) -> np.ndarray:
        """Where transitions lead, or -1."""
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.to[at], -1)
        todo = np.flatnonzero((held != keys) & (held >= 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            held, wanted = self.keys[at], keys[todo]
            found = held == wanted
            out[todo[found]] = self.to[at[found]]
            on = ~found & (held >= 0)
            todo, at = todo[on], at[on]
        return out

    def phrases(self, stretches: list[np.ndarray]) -> np.ndarray:
        """Phrases by language and stretch (of codes)."""
        lengths = np.array([len(x) for x in stretches])
        order = np.argsort(-lengths, kind="stable")
        codes = np.zeros((int(lengths.max()), len(stretches)), self.code.dtype)
        for k, i in enumerate(order.tolist()):
            codes[: lengths[i], k] = stretches[i]
        alive = np.searchsorted(-lengths[order], -np.arange(len(codes)), side="left")
        roots = self.roots[:, None]
        state, n = np.tile(roots, (1, len(stretches))), np.zeros((len(self.langs), len(stretches)), "i8")
        for i, d in enumerate(alive.tolist()):
            c = codes[i, :d].astype("i8")
            old = state[:, :d]
            to = self._next((old * self.width + c).ravel()).reshape(old.shape)
            broken = to < 0
            n[:, :d] += broken & (old != roots)
            to = np.where(broken, self.first[:, c], to)
            n[:, :d] += broken & (to == roots)  # an unknown symbol is a phrase
            state[:, :d] = to
        n += state != roots
        out = np.empty_like(n)
        out[:, order] = n
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language and ``second / (best + second)`` of the normalised phrases, of every text."""
        letters, owner, stretches = np.zeros(len(texts), "i8"), [], []
        sums = np.zeros((len(self.langs), len(texts)), "i8")

        def parse():
            if stretches and self.langs:
                np.add.at(sums, (slice(None), np.array(owner)), self.phrases(stretches))
            owner.clear()
            stretches.clear()

        for k, text in enumerate(texts):
            if text:
                x, letters[k] = symbols(text)
                if letters[k]:
                    x = self.code[x]
                    for at in range(0, len(x), STRETCH):
                        owner.append(k)
                        stretches.append(x[at : at + STRETCH])
                        if len(owner) == BESIDE:
                            parse()
        parse()
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        rate = sums * self.bits[:, None] / np.maximum(letters, 1)
        order = np.argsort(rate, axis=0, kind="stable")
        best = np.take_along_axis(rate, order, 0)
        if len(self.langs) > 1:
            score = best[1] / (best[0] + best[1] + (letters == 0))
        else:
            score = np.ones(len(texts))
        return [(self.langs[o], float(s)) if n else ("und", 0.0) for o, s, n in zip(order[0].tolist(), score.tolist(), letters.tolist())]


def identify(docs: DataFrame, sample: list[tuple[str, str]] | None = None) -> DataFrame:
    """Add lang_pred, lang_score and held_out to every document.

    Learns from ``sample`` or from ``training_sample(docs)``; the language, source and id of a row
    never enter its prediction.  Null texts and texts without a letter are ``und`` with score 0, as is
    every row when nothing can be learned.  Whole texts are parsed; of equal rates the first language by
    name wins.  Repeated rows and null ids are kept; columns of these three names are replaced.
    """
    spark = docs.sparkSession
    parser = spark.sparkContext.broadcast(Parser(train(training_sample(docs) if sample is None else sample)))
    kept = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    rest = docs.select(*kept).withColumn("held_out", held_out())
    schema = extended(rest, "lang_pred string, lang_score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2000):
            found = parser.value.predict(b.column("text").cast(pa.string()).to_pylist())
            yield pa.record_batch([*b.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*b.schema.names, "lang_pred", "lang_score"])

    return rest.mapInArrow(run, schema)


def reject_language(docs: DataFrame, accepted: tuple[str, ...] | None = None) -> DataFrame:
    """Documents of an accepted language (by default any that was learned); the others go.

    Null texts and texts without a letter are of none; ties and repeated rows are judged alike; an empty
    table gives no rows.
    """
    found = identify(docs)
    keep = F.col("lang_pred") != "und" if accepted is None else F.col("lang_pred").isin(*accepted)
    return found.filter(keep).select(*docs.columns)
