"""Token ids by a public tokenizer, fast enough for whole corpora.

``tokenizers`` spends most of its time outside the BPE merges.  A word of Latin letters, alone
or followed by one mark, is therefore looked up in a bounded per-worker memo and, on a miss, goes
straight to the tokenizer's own BPE model; everything else goes through ``Tokenizer.encode``.
``exact`` turns the short cut off; tests hold both against each other.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

#: Entries of the memo of one Python worker (about 200 bytes each).
MEMO = 600_000
#: Letters whose lower-casing and NFC form are the same for the library and for Python.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-įĲ-ňŊ-ɏ]+")
_MARKS = frozenset(".,;:!?")
#: Control characters that ``str.split`` takes for blanks and the tokenizer doesn't.
_ODD = re.compile("[\x1c-\x1f]")


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others follow 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(extra)
            extra += 1
    return table


class TokenIds:
    """``ids(text)``: ids of the whole text as little-endian unsigned 32-bit bytes, without special tokens."""

    def __init__(self, path: str, exact: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.exact = exact or not self._word_bpe()
        self.model, self.letters, self.memo = self.tok.model, _byte_letters(), {}
        self.marks = {m: self._encode(m) for m in _MARKS}

    def _word_bpe(self) -> bool:
        """The short cut holds for lower-cased word BPE that drops white space."""
        return getattr(self.tok.model, "end_of_word_suffix", None) == "</w>" and self.tok.encode("Aé B", add_special_tokens=False).ids == self.tok.encode("aé  b", add_special_tokens=False).ids

    def _encode(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        word = word.lower()
        known = self.memo.get(word)
        if known:
            return known
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.model.tokenize(word)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk):
            out = self._word(chunk)
        elif chunk[-1] in _MARKS and _PLAIN.fullmatch(chunk, 0, len(chunk) - 1):
            out = self._word(chunk[:-1]) + self.marks[chunk[-1]]
        else:
            out = self._encode(chunk)
        if len(chunk) <= 64:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[chunk] = out
        return out

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.exact or _ODD.search(text):
            return self._encode(text)
        get, chunk = self.memo.get, self._chunk
        return b"".join([get(c) or chunk(c) for c in text.split()])


_open: dict[tuple[str, bool], TokenIds] = {}


def token_ids(path: str, exact: bool = False) -> TokenIds:
    """One tokenizer for each Python worker."""
    if (path, exact) not in _open:
        _open[path, exact] = TokenIds(path, exact)
    return _open[path, exact]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
