"""SentencePiece encoding and decoding by N-best segmentation over the piece lattice."""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import arrow_rows, whole_text
from weft.llm.words import Grown, Numbering

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
N_BEST = 3
#: Added to the least piece score for a character spelled in bytes.
BYTES_PENALTY = -10.0
#: Chunks whose segmentations a task keeps; all are dropped when there are more.
CACHE = 400_000
#: Chunks longer than this are cut out of the numpy batch and searched alone.
LONG = 64
#: Characters of chunks searched in numpy at once: few, so that their tables stay in the cache.
AT_ONCE = 1 << 16
#: A run of spaces with what follows, a piece of text before a space, or one line break: no piece crosses these.
CHUNKS = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20


class Pieces:
    """The inventory of a model file: piece scores, byte pieces and a table for lookups in numpy."""

    def __init__(self, model: str = MODEL):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        ordinary = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        real = [sp.get_score(i) for i in ordinary if sp.get_score(i) > -1e8]
        floor = min(real)
        # user-defined runs of spaces carry no score of their own: they rank after every scored piece
        self.score = {self.text[i]: (sp.get_score(i) if sp.get_score(i) > -1e8 else floor - 1, i) for i in ordinary}
        assert not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.score), "pieces must not cross chunks"
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes_score = floor + BYTES_PENALTY
        self.longest = max(map(len, self.score))
        keys = self._hashes(list(self.score))
        assert len(np.unique(keys)) == len(keys)
        self.values = np.array([s for s, _ in self.score.values()])
        self.ids = np.array([i for _, i in self.score.values()])
        self.tables = []  # each key sits in the first table where its slot was free
        left = np.arange(len(keys))
        while len(left):
            slots = (keys[left] >> np.uint64(64 - _BITS)).astype(np.int64)
            _, first = np.unique(slots, return_index=True)
            table = np.full(1 << _BITS, -1, np.int32)
            table[slots[first]] = left[first]
            self.tables.append(table)
            left = np.delete(left, first)
        self.keys = keys
        self.shared = np.zeros(1 << _BITS, bool)  # slots that more than one key has
        for table in self.tables[1:]:
            self.shared |= table >= 0
        # text of an id that stands alone; None for bytes of longer characters
        self.alone: list[str | None] = [t.replace(SPACE, " ") for t in self.text]
        for b, i in enumerate(self.byte):
            self.alone[i] = chr(b) if b < 128 else None

    @staticmethod
    def _hashes(words: list[str]) -> np.ndarray:
        out = np.zeros(len(words), np.uint64)
        with np.errstate(over="ignore"):
            for k, w in enumerate(words):
                h = np.uint64(0)
                for c in w:
                    h = (h + np.uint64(ord(c) + 1)) * _BASE
                out[k] = h
        return out

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash, or -1."""
        flat = h.ravel()
        slots = (flat >> np.uint64(64 - _BITS)).view(np.int64)
        at = self.tables[0].take(slots)
        some = np.flatnonzero(at >= 0)  # few slots have a key
        other = some[self.keys[at[some]] != flat[some]]
        at[other] = -1
        shared = other[self.shared[slots[other]]]
        for table in self.tables[1:] if len(shared) else ():
            seen = table[slots[shared]]
            right = (seen >= 0) & (self.keys[seen] == flat[shared])
            at[shared[right]] = seen[right]
        return at.reshape(h.shape)

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces joined, byte pieces read as UTF-8, the space put before the text taken off."""
        try:
            text = "".join([self.alone[i] for i in ids])
        except TypeError:  # a byte of a longer character
            text = self._decode_bytes(ids)
        return text[1:] if text.startswith(" ") else text

    def _decode_bytes(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        low, high = self.byte[0], self.byte[255]
        for i in ids:
            if low <= i <= high:
                run.append(i - low)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(self.alone[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)


@lru_cache(2)
def load(model: str = MODEL) -> Pieces:
    return Pieces(model)


def lattice(chunk: str, pieces: Pieces) -> list[list[tuple[int, float, int]]]:
    """For each end position the edges (start, score, piece id; -1 for a character spelled in bytes)."""
    edges: list[list[tuple[int, float, int]]] = [[] for _ in range(len(chunk) + 1)]
    for start in range(len(chunk)):
        for end in range(start + 1, min(len(chunk), start + pieces.longest) + 1):
            if (hit := pieces.score.get(chunk[start:end])) is not None:
                edges[end].append((start, *hit))
            elif end == start + 1:
                edges[end].append((start, pieces.bytes_score, -1))
    return edges


def n_best(chunk: str, pieces: Pieces, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best segmentations (score, ids), best first; equal scores in the order found.

    A forward Viterbi pass gives the best score of every prefix. The backward search then starts at the end of
    the chunk and always extends the partial path whose own score plus that of the best prefix before it is
    highest: the heuristic is exact, so paths leave the heap in order of their whole score. Of equal ones the
    path nearest the start goes first, so equal paths are not all opened. Paths share their tails.
    """
    edges = lattice(chunk, pieces)
    ahead = [0.0] + [-1e300] * len(chunk)
    for end in range(1, len(chunk) + 1):
        ahead[end] = max(ahead[s] + w for s, w, _ in edges[end])
    out: list[tuple[float, tuple[int, ...]]] = []
    count = 0
    heap: list[tuple] = [(-ahead[-1], len(chunk), count, 0.0, None)]
    while heap and len(out) < n:
        _, at, _, tail, path = heapq.heappop(heap)
        if at:
            for start, w, i in edges[at]:
                count += 1
                heapq.heappush(heap, (-(ahead[start] + w + tail), start, count, w + tail, (start, at, i, path)))
            continue
        ids: list[int] = []
        while path:
            start, end, i, path = path
            ids.extend([i] if i >= 0 else [pieces.byte[b] for b in chunk[start:end].encode("utf-8", "surrogatepass")])
        out.append((tail, tuple(ids)))
    return out


def batch_best(chunks: list[str], pieces: Pieces) -> list[tuple[float, tuple[int, ...], float]]:
    """(score, ids, score of the second best or -inf) of many chunks of equal length."""
    scores, seconds, ids, sizes = viterbi(chunks, pieces)
    return [(s, tuple(i.tolist()), t) for s, i, t in zip(scores.tolist(), np.split(ids, np.cumsum(sizes)[:-1]), seconds.tolist())]


def viterbi(chunks: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores, scores of the second best or -inf, ids one after another and ids of each of many chunks of equal length, by Viterbi passes in numpy.

    The second best path uses an edge off the best path; the best path over an edge scores the best prefix
    before it plus the edge plus the best suffix after it, so the largest such sum off the best path is found
    without listing paths. Equal scores keep the longest last piece.
    """
    n, size = len(chunks), len(chunks[0])
    # a row for each place, so that a step over all chunks reads and writes neighbours
    codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, size).T.astype(np.uint64) + np.uint64(1)
    widths = min(size, pieces.longest)
    weight, piece = np.empty((widths + 1, size, n)), np.empty((widths + 1, size, n), np.int32)
    edges = []  # (start, width) that some chunk has; weight and piece are filled there
    h = np.zeros((size, n), np.uint64)
    for width in range(1, widths + 1):
        with np.errstate(over="ignore"):
            h = (h[: size - width + 1] + codes[width - 1 :]) * _BASE
        at = pieces.find(h)
        hit = at >= 0
        some = np.flatnonzero(hit.any(axis=1)) if width > 1 else np.arange(size)
        edges += [(int(start), width) for start in some]
        piece[width, some] = at[some]
        weight[width, some] = np.where(hit[some], pieces.values[at[some]], -np.inf if width > 1 else pieces.bytes_score)
    ahead, back = np.full((size + 1, n), -np.inf), np.zeros((size + 1, n), np.int8)
    ahead[0] = 0
    for start, width in sorted(edges, key=lambda x: (sum(x), x[1])):
        end = start + width
        s = ahead[start] + weight[width, start]
        np.putmask(back[end], s >= ahead[end], width)
        np.maximum(ahead[end], s, out=ahead[end])
    behind = np.full((size + 1, n), -np.inf)
    behind[size] = 0
    for start, width in sorted(edges, reverse=True):
        np.maximum(behind[start], weight[width, start] + behind[start + width], out=behind[start])
    at, path = np.full(n, size), np.full((n, size), -2, np.int32)
    on_path = np.zeros((widths + 1, size, n), bool)
    live, step = np.arange(n), size
    while len(live):
        step -= 1
        width = back[at[live], live].astype(np.int64)
        start = at[live] - width
        at[live] = start
        on_path[width, start, live] = True
        hit = piece[width, start, live]
        path[live, step] = np.where(hit >= 0, pieces.ids[hit], -2 - codes[start, live].astype(np.int32))
        live = live[start > 0]
    second = np.full(n, -np.inf)
    for start, width in edges:
        through = ahead[start] + weight[width, start] + behind[start + width]
        np.putmask(through, on_path[width, start], -np.inf)
        np.maximum(second, through, out=second)
    on = path != -2
    return (ahead[size], second, *_spelled(path[on], on.sum(axis=1), pieces))


def _spelled(ids: np.ndarray, sizes: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """ids and the ids of each chunk, each id of -3 - c replaced by the bytes of the character c."""
    at = np.flatnonzero(ids < 0)
    if not len(at):
        return ids, sizes
    spelled = [[pieces.byte[b] for b in chr(-3 - i).encode("utf-8", "surrogatepass")] for i in ids[at].tolist()]
    times = np.ones(len(ids), np.int64)
    times[at] = list(map(len, spelled))
    out = np.repeat(ids, times)
    out[out < 0] = list(chain.from_iterable(spelled))
    return out, np.add.reduceat(times, np.cumsum(sizes) - sizes)


#: The same chunks are often those of least loss; long ones are not kept.
_n_best = lru_cache(1 << 15)(n_best)


def merge(chunks: list[str], best: list[tuple], pieces: Pieces, n: int) -> list[tuple[float, dict[int, tuple[int, ...]]]]:
    """The n best segmentations of a text as (score, {chunk position: its other ids}), best first.

    Only the n - 1 positions of least loss to their second best can differ from the best: any other change
    costs at least as much as each of those n - 1. Their chunks are searched for their own n best.
    """
    total = sum(map(itemgetter(0), best))
    out: list[tuple[float, dict[int, tuple[int, ...]]]] = [(0.0, {})]
    losses = [s - t for s, _, t in best]
    for _, k in heapq.nsmallest(n - 1, zip(losses, range(len(best)))):
        if best[k][2] == -np.inf:
            continue
        search = _n_best if len(chunks[k]) <= LONG else n_best
        others = [(best[k][0] - s, ids) for s, ids in search(chunks[k], pieces, n) if ids != best[k][1]][: n - 1]
        out += [(loss + more, {**changed, k: ids}) for loss, changed in out for more, ids in others]
        out = heapq.nsmallest(n, out, key=lambda x: x[0])
    return [(total - loss, changed) for loss, changed in out]


def encode(docs: DataFrame, model: str = MODEL, n: int = N_BEST, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_ids, score, n_best, ids_crc32, round_trip, and ids with with_ids) of every whole text.

    A space is put before a text and spaces become U+2581. Scores are the model file's; a character without a
    piece is spelled in bytes. n_best holds the scores of the n best segmentations of the whole text, best first
    (fewer where there are fewer); ids are those of the best, ids_crc32 the checksum of their little-endian
    32-bit values, round_trip whether decoding them gives the text back.

    Null and empty texts have no ids, score 0 and n_best [0]. A text that holds U+2581 itself decodes to a space
    there and has round_trip false. Null ids and repeated rows are kept; an empty table gives an empty result;
    other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        known = Segments(pieces)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            split = [CHUNKS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
            if len(known.number) > CACHE:
                known.clear()
            numbers = known.numbers(list(chain.from_iterable(split)))
            scores, losses = known.scores[numbers], known.losses[numbers]
            packed, sizes = known.of(numbers)
            ends = np.cumsum([0, *map(len, split)])
            offsets = np.r_[0, np.cumsum(sizes)][ends]
            rows = []
            for text, chunks, start, end, low, high in zip(texts, split, ends.tolist(), ends[1:].tolist(), offsets.tolist(), offsets[1:].tolist()):
                few = least(losses[start:end], n - 1)
                best = [known.best(k) for k in numbers[start:end][few].tolist()]
                rest = float(scores[start:end].sum()) - sum(map(itemgetter(0), best))
                most = [rest + s for s, _ in merge([chunks[k] for k in few], best, pieces, n)]
                ids = packed[low:high]
                rows.append((high - low, most[0], most, zlib.crc32(ids), pieces.decode(ids.tolist()) == text))
            types = [pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.int64(), pa.bool_()]
            columns = [pa.array(list(x), t) for x, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            if with_ids:  # lists from one array, not number by number
                columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(packed, pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], NAMES[: 1 + len(columns)])

    arrow_rows(docs.sparkSession, 256)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_ids int, score double, n_best array<double>, ids_crc32 long, round_trip boolean" + (", ids array<int>" if with_ids else ""))


NAMES = ["doc_id", "n_ids", "score", "n_best", "ids_crc32", "round_trip", "ids"]


def least(losses: np.ndarray, n: int) -> list[int]:
    """Places of the n least finite losses, least first; the first of equal ones."""
    out, left = [], losses.copy()
    while len(out) < min(n, len(left)):
        k = int(left.argmin())
        if left[k] == np.inf:
            break
        out.append(k)
        left[k] = np.inf
    return out


class Segments:
    """Best segmentations of chunks, which are numbered as they come: scores, losses to the second best (inf where there is none) and ids."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.number = Numbering()
        self._scores, self._losses = Grown([], float), Grown([], float)
        self._starts, self._sizes, self._ids = Grown([]), Grown([]), Grown([], "<i4")

    scores, losses, starts, sizes, ids = (property(lambda self, x=x: getattr(self, x).held) for x in ("_scores", "_losses", "_starts", "_sizes", "_ids"))

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """Numbers of chunks, known or new."""
        before = len(self.number)
        out = np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))
        if more := len(self.number) - before:
            self.add(list(islice(reversed(self.number), more))[::-1])
        return out

    def add(self, new: list[str]) -> None:
        """What is known of the chunks that were numbered last, in their order."""
        lengths = np.fromiter(map(len, new), np.int64, len(new))
        order = np.argsort(lengths, kind="stable")
        parts = []
        for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            size = int(lengths[group[0]])
            if size > LONG:
                for k in group.tolist():
                    two = n_best(new[k], self.pieces, 2)
                    parts.append((np.array([two[0][0]]), np.array([two[1][0] if len(two) > 1 else -np.inf]), np.array(two[0][1], "<i4"), np.array([len(two[0][1])])))
                continue
            step = max(1, AT_ONCE // size)
            parts += [viterbi([new[k] for k in group[at : at + step].tolist()], self.pieces) for at in range(0, len(group), step)]
        scores, seconds, ids, sizes = map(np.concatenate, zip(*parts))
        place = np.argsort(order)  # from the order of lengths to that of numbers
        for grown, more in ((self._scores, scores), (self._losses, scores - seconds), (self._sizes, sizes), (self._starts, np.cumsum(sizes) - sizes + len(self.ids))):
            grown.add(more[place])
        self._ids.add(ids)

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of chunks one after another, ids of each chunk)."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[numbers] - ends + sizes, sizes)], sizes

    def best(self, number: int) -> tuple[float, tuple[int, ...], float]:
        """(score, ids, score of the second best) of one chunk."""
        score, start = float(self.scores[number]), int(self.starts[number])
        return score, tuple(self.ids[start : start + int(self.sizes[number])].tolist()), score - float(self.losses[number])


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded (doc_id, ids) to (doc_id, text); null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            texts = [pieces.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
