"""Automata over small alphabets of Python objects: suffix automaton, phrase automaton, delimiter stack."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence

import ahocorasick


class SuffixAutomaton:
    """All factors of a set of sequences; ``add`` extends it by one sequence.

    ``owner``: for each state the one sequence it occurs in, or -2 if it occurs in several
    (after :meth:`settle`).
    """

    __slots__ = ("next", "link", "length", "owner", "shared")

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.owner = [-1], [0], [-1]
        self.shared: list[int] = []

    def add(self, seq: Sequence[Hashable], owner: int = 0) -> None:
        nxt, link, length, own = self.next, self.link, self.length, self.owner
        last = 0
        for c in seq:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                cur = q
            else:
                cur = None if q is not None else len(nxt)
                if cur is not None:
                    nxt.append({}), link.append(0), length.append(length[last] + 1), own.append(-1)
                p = last
                if q is None:
                    while p != -1 and c not in nxt[p]:
                        nxt[p][c] = cur
                        p = link[p]
                    if p == -1:
                        q = 0
                    else:
                        q = nxt[p][c]
                if q and length[q] != length[p] + 1:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q])), link.append(link[q]), length.append(length[p] + 1), own.append(own[q])
                    link[q] = clone
                    old = q
                    q = clone
                    while p != -1 and nxt[p].get(c) == old:
                        nxt[p][c] = clone
                        p = link[p]
                if cur is None:
                    cur = q
                else:
                    link[cur] = q
            last = cur
            own[last] = owner if own[last] in (-1, owner) else -2

    def settle(self) -> None:
        """Hands owners up the suffix links; ``shared`` names for each state its longest suffix state with several owners."""
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True)
        own, link = self.owner, self.link
        for v in order:
            p, o = link[v], own[v]
            if p > 0 and o != -1:
                own[p] = o if own[p] in (-1, o) else -2
        self.shared = [0] * len(own)
        for v in reversed(order):
            self.shared[v] = v if own[v] == -2 else self.shared[link[v]]

    def matching_lengths(self, seq: Sequence[Hashable]) -> list[int]:
        """For each position the length of the longest factor that ends there."""
        out, nxt, link, length, v, n = [], self.next, self.link, self.length, 0, 0
        for c in seq:
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                n += 1
            out.append(n)
        return out


def covered(lengths: Sequence[int], least: int) -> int:
    """Positions covered by matches of at least ``least`` elements."""
    total, at = 0, len(lengths)
    reach = len(lengths)
    for i in range(len(lengths) - 1, -1, -1):
        if lengths[i] >= least and i - lengths[i] + 1 < reach:
            start = i - lengths[i] + 1
            total += min(at, i + 1) - start
            at = reach = start
    return total


class Phrases:
    """A multi-pattern automaton; patterns and texts must be normalised alike by the caller."""

    def __init__(self, phrases: Iterable[tuple[str, object]]) -> None:
        self._a = ahocorasick.Automaton()
        for text, value in phrases:
            self._a.add_word(text, (len(text), value))
        self._a.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, object]]:
        return [(end + 1 - n, end + 1, value) for end, (n, value) in self._a.iter(text)]

    def __contains__(self, text: str) -> bool:
        return next(self._a.iter(text), None) is not None


_CLOSE = {")": "(", "]": "[", "}": "{", "»": "«", "”": "“"}


def left_open(text: str) -> bool:
    """Whether a bracket, quote, emphasis or code fence that ``text`` opens is never closed.

    Closing marks that nothing opened, such as the one of ``1)``, don't count.
    """
    stack: list[str] = []
    for c in text:
        if c in "([{«“":
            stack.append(c)
        elif c in _CLOSE and _CLOSE[c] in stack:
            while stack.pop() != _CLOSE[c]:
                pass
    return bool(stack) or text.count("**") % 2 == 1 or text.count("```") % 2 == 1
