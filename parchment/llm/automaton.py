"""Generalised suffix automaton over any hashable symbols, for bounded reference texts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


class SuffixAutomaton:
    """``next[s]``: transitions; ``link[s]``, ``length[s]``: suffix link and longest string of state ``s``.

    Strings are added one after another from the root, so no substring runs over two of them.
    """

    def __init__(self, strings: Iterable[Sequence] = ()):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        for s in strings:
            self.add(s)

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, symbol, q: int) -> int:
        """Split the strings of ``q`` that end ``p`` + symbol into a state of their own."""
        if self.length[q] == self.length[p] + 1:
            return q
        c = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = c
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = c
            p = self.link[p]
        return c

    def add(self, string: Sequence) -> list[int]:
        """Add a string; the states of its prefixes."""
        last, path = 0, []
        for symbol in string:
            q = self.next[last].get(symbol)
            if q is not None:
                last = self._clone(last, symbol, q)
            else:
                new, p = self._state(self.length[last] + 1, 0, {}), last
                while p >= 0 and symbol not in self.next[p]:
                    self.next[p][symbol] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._clone(p, symbol, self.next[p][symbol])
                last = new
            path.append(last)
        return path

    def phrases(self, string: Sequence) -> int:
        """Number of phrases of the greedy parse of ``string`` into longest matches; an unknown symbol is one phrase."""
        state, n, moves = 0, 0, self.next
        for symbol in string:
            to = moves[state].get(symbol)
            if to is None:
                n += state != 0
                to = moves[0].get(symbol)
                if to is None:
                    n, to = n + 1, 0
            state = to
        return n + (state != 0)
