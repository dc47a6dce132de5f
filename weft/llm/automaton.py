"""Suffix automata of sequences of numbers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


class SuffixAutomaton:
    """The generalised suffix automaton of some sequences.

    A state stands for the substrings that end at the same places; the longest has length[state] numbers, the shortest one more
    than length[link[state]]. first[state] is the least place at which they end in the sequence that brought them in.
    """

    def __init__(self, sequences: Iterable[Sequence[int]] = ()):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        for sequence in sequences:
            self.add(sequence)

    def _copy(self, state: int, length: int) -> int:
        self.next.append(self.next[state].copy())
        self.link.append(self.link[state])
        self.length.append(length)
        self.first.append(self.first[state])
        self.link[state] = copy = len(self.link) - 1
        return copy

    def _redirect(self, state: int, number: int, old: int, new: int) -> None:
        goes, link = self.next, self.link
        while state >= 0 and goes[state].get(number) == old:
            goes[state][number] = new
            state = link[state]

    def add(self, sequence: Sequence[int]) -> None:
        goes, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for at, number in enumerate(sequence):
            to = goes[last].get(number)
            if to is not None:  # known from an earlier sequence
                if length[to] > length[last] + 1:
                    copy = self._copy(to, length[last] + 1)
                    self._redirect(last, number, to, copy)
                    to = copy
                last = to
                continue
            new = len(link)
            goes.append({})
            length.append(length[last] + 1)
            first.append(at)
            link.append(0)
            state = last
            while state >= 0 and number not in goes[state]:
                goes[state][number] = new
                state = link[state]
            if state >= 0:
                to = goes[state][number]
                if length[to] > length[state] + 1:
                    copy = self._copy(to, length[state] + 1)
                    self._redirect(state, number, to, copy)
                    to = copy
                link[new] = to
            last = new

    def step(self, state: int, matched: int, number: int) -> tuple[int, int]:
        """State and length of the longest match that ends with number, from those before it."""
        goes, link, length = self.next, self.link, self.length
        while (to := goes[state].get(number)) is None:
            state = link[state]
            if state < 0:
                return 0, 0
            matched = length[state]
        return to, matched + 1
