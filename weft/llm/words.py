"""Words of many texts at once in numpy: places, hashes, and groups of neighbouring words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that are taken at once; longer texts are cut between words.
PIECE = 1 << 21
#: Constants of the hashes: a factor for each place in a word, and one for each word of a group.
_PLACES = 1 << 12
_FACTORS = np.random.default_rng(42).integers(1, 1 << 63, _PLACES, np.uint64) * np.uint64(2) + np.uint64(1)
_NEXT = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Grown:
    """An array that grows at its end, with room to spare so that it is seldom copied."""

    def __init__(self, first: list, dtype: type = np.int64):
        self.room, self.size = np.array(first, dtype), len(first)

    @property
    def held(self) -> np.ndarray:
        return self.room[: self.size]

    def add(self, more: np.ndarray) -> None:
        size = self.size + len(more)
        if size > len(self.room):
            self.room = np.concatenate([self.held, np.empty(size + self.size, self.room.dtype)])
        self.room[self.size : size], self.size = more, size


class Numbering(dict):
    """Numbers of words, a new one for each new word."""

    def __missing__(self, word: bytes | str) -> int:
        self[word] = n = len(self)
        return n


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans: whether a byte belongs to a word. ranges are those that do not."""
    out = np.ones(256, bool)
    for a, b in ranges:
        out[a : b + 1] = False
    return out


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _piece(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = is_word[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    letters = data[inside[1:-1]]
    place = np.arange(len(letters), dtype=np.int32) - np.repeat(first.astype(np.int32), lengths)
    weighed = (letters.astype(np.uint64) + np.uint64(1)) * _FACTORS[place & (_PLACES - 1)]
    return starts, ends, _mixed(np.add.reduceat(weighed, first))


def word_table(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of data (bytes as uint8). Equal words have equal hashes; unlike words rarely do."""
    parts, at = [], 0
    while at < len(data):
        to = min(at + PIECE, len(data))
        while to < len(data) and is_word[data[to]]:  # a word is never cut
            ahead = np.flatnonzero(~is_word[data[to : to + PIECE]])
            to = to + int(ahead[0]) if len(ahead) else min(to + PIECE, len(data))
        starts, ends, hashes = _piece(data[at:to], is_word)
        parts.append((starts + at, ends + at, hashes))
        at = to
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def gram_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every group of width neighbouring words, one for each place that has so many words from it on."""
    if len(hashes) < width:
        return np.empty(0, np.uint64)
    out = hashes[: len(hashes) - width + 1].copy()
    for k in range(1, width):
        out *= _NEXT
        out += hashes[k : len(hashes) - width + 1 + k]
    return _mixed(out)


def groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Neighbouring texts, from and to, of about PIECE bytes in all; a longer text is alone."""
    at, held = 0, 0
    for k, t in enumerate(texts):
        if k > at and held + len(t) > PIECE:
            yield at, k
            at, held = k, 0
        held += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The texts with a line break after each, and where each starts, with the end at last."""
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    return b"".join(t + b"\n" for t in texts), np.concatenate([[0], ends]).astype(np.int64)


def stretches(marked: np.ndarray, least: int) -> list[tuple[int, int]]:
    """From and to of every maximal run of at least least true values."""
    padded = np.zeros(len(marked) + 2, bool)
    padded[1:-1] = marked
    edges = np.flatnonzero(padded[1:] != padded[:-1])
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2]) if b - a >= least]
