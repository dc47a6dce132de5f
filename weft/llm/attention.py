"""A causal self-attention model over subword ids, trained and applied in numpy."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache
from types import SimpleNamespace

import numpy as np

#: Width of the model, rate of its training, and windows of one step.
WIDTH, RATE, BATCH = 12, 0.2, 96
#: Positions scored by a window, and positions before them that it sees too.
STRIDE, BACK = 16, 8
SPAN = STRIDE + BACK
#: Bound on exponents, so that their powers are finite.
MOST = 60
#: Parts of the model that are small and dense.
DENSE = ("w", "u", "c", "d")
#: Windows scored at once: enough that the cost of each call on arrays is shared.
AT_ONCE = 512


@lru_cache(4)
def _places(queries: int, keys: int) -> np.ndarray:
    """Distance of each of the last queries of keys positions to each key, no more than SPAN - 1, or SPAN where the key is ahead."""
    far = np.arange(keys - queries, keys)[:, None] - np.arange(keys)[None, :]
    return np.where(far < 0, SPAN, np.minimum(far, SPAN - 1))


@lru_cache(4)
def _distances(t: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances of the pairs of t positions whose second is not ahead, and where these pairs are."""
    far = np.arange(t)[:, None] - np.arange(t)[None, :]
    return far[far >= 0], far >= 0


class Attention:
    """One causal head with a bias for each distance: the next id's class from the ids up to here.

    Number n of the n + 1 inputs is the start mark. w holds the projections to queries, keys, values and what passes by.
    """

    def __init__(self, n: int, classes: int, width: int = WIDTH, seed: int = 0, dtype=np.float32):
        rng = np.random.default_rng(seed)
        self.n, self.classes, self.width, self.dtype = n, classes, width, dtype
        w = rng.normal(0, 0.5 / np.sqrt(width), (width, 4 * width))
        w[:, 2 * width : 3 * width] += np.eye(width)
        p = {"e": rng.normal(0, 0.3, (n + 1, width)), "w": w, "u": rng.normal(0, 0.3 / np.sqrt(width), (width, classes)), "c": np.zeros(classes), "d": np.zeros(SPAN)}
        self.p = {k: v.astype(dtype) for k, v in p.items()}
        self.small = np.min_scalar_type(n)  # ids sort faster in it
        self.rooms: SimpleNamespace | None = None

    def _bias(self, queries: int, keys: int) -> np.ndarray:
        """Bias of each distance for the last queries of keys positions; far below all others ahead of the query."""
        return np.append(self.p["d"], self.dtype(-1e9)).take(_places(queries, keys))

    def _rooms(self, b: int, t: int) -> SimpleNamespace:
        """Arrays that the steps over b windows of t positions write to, and views of them; those of one shape are kept.

        A step is some eighty calls on arrays that fit the cache, so that what each call costs by itself counts.
        """
        if self.rooms is None or self.rooms.a.shape != (b, t, t):
            d, m, empty = self.width, b * t, lambda *shape: np.empty(shape, self.dtype)
            r = self.rooms = SimpleNamespace(e=empty(m, d), all=empty(m, 4 * d), a=empty(b, t, t), da=empty(b, t, t), seen=empty(b, t, d), z=empty(m, d), prob=empty(self.classes, m))
            r.dz, r.back, r.down, r.de, r.sorted, r.w = empty(m, d), empty(b, t, d), empty(m, 4 * d), empty(m, d), empty(m, d), empty(d, 4 * d)
            r.q, r.k, r.v, r.r = (r.all.reshape(b, t, 4 * d)[:, :, i * d : i * d + d] for i in range(4))
            r.z3, r.dz3, r.flat = r.z.reshape(b, t, d), r.dz.reshape(b, t, d), r.prob.reshape(-1)
            r.downs = [r.down.reshape(b, t, 4 * d)[:, :, i * d : i * d + d] for i in range(4)]
            r.ones, r.far = np.ones(max(b, t, d), self.dtype), _distances(t)
            r.d, r.places = np.full(SPAN + 1, -1e9, self.dtype), _places(t, t)
            r.factors = np.where(np.arange(4 * d) < d, d**-0.5, 1).astype(self.dtype)  # queries are scaled by their projection
            r.g = empty(sum(self.p[k].size for k in DENSE))
            r.of = dict(zip(DENSE, np.split(r.g, np.cumsum([self.p[k].size for k in DENSE])[:-1])))
            r.of = {k: v.reshape(self.p[k].shape) for k, v in r.of.items()}
        return self.rooms

    def prepared(self, x: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """What gradients() needs to know of the windows of each step, (steps, windows, positions): inputs, their order, the ids in it, where they start and how often they are there, the positions that count and where their targets are."""
        steps, m = len(x), x.shape[1] * x.shape[2]
        x, y = x.reshape(steps, m), y.reshape(steps, m)
        order = np.argsort(x.astype(self.small), axis=1, kind="stable")
        ordered = np.take_along_axis(x, order, 1)
        new = np.ones((steps, m), bool)
        np.not_equal(ordered[:, 1:], ordered[:, :-1], out=new[:, 1:])
        counted = y >= 0
        whole, places = counted.all(axis=1).tolist(), y * m + np.arange(m)
        out = []
        for i in range(steps):
            starts = np.flatnonzero(new[i])
            at = None if whole[i] else np.flatnonzero(counted[i])
            out.append((x[i], order[i], ordered[i].take(starts), starts, np.diff(starts, append=m), at, places[i] if whole[i] else places[i].take(at)))
        return out

    def gradients(self, shape: tuple[int, int], x: np.ndarray, order: np.ndarray, starts: np.ndarray, at: np.ndarray | None, places: np.ndarray, told: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Gradient of the rows of e that are met; those of the other parts are left in the rooms. With told the chances of the targets, too."""
        p, (b, t), d = self.p, shape, self.width
        r, m = self._rooms(b, t), b * t
        e = p["e"].take(x, 0, out=r.e, mode="clip")
        w = np.multiply(p["w"], r.factors, out=r.w)
        np.matmul(e, w, out=r.all)
        r.d[:SPAN] = p["d"]  # far below all others ahead of the query
        a = np.matmul(r.q, r.k.transpose(0, 2, 1), out=r.a)
        a += r.d.take(r.places)
        a.clip(-np.inf, MOST, out=a)
        np.exp(a, out=a)
        a /= (a.reshape(-1, t) @ r.ones[:t]).reshape(b, t, 1)  # one product, not one for each window
        seen = np.matmul(a, r.v, out=r.seen)
        np.add(seen, r.r, out=r.z3)
        # a row for each class, so that sums and factors of positions lie side by side
        prob = np.matmul(p["u"].T, r.z.T, out=r.prob)
        prob += p["c"][:, None]
        prob.clip(-MOST, MOST, out=prob)
        np.exp(prob, out=prob)
        total = r.ones[:1].repeat(self.classes) @ prob
        count = max(1, len(places))
        chances = r.flat.take(places) / (total if at is None else total[at]) if told else None
        prob *= self.dtype(1 / count) / total
        r.flat[places] -= self.dtype(1 / count)
        if at is not None:
            left = np.ones(m, bool)
            left[at] = False
            prob[:, left] = 0
        np.matmul(prob.T, p["u"].T, out=r.dz)
        da = np.matmul(r.dz3, r.v.transpose(0, 2, 1), out=r.da)
        da -= (np.multiply(r.dz3, seen, out=seen).reshape(m, d) @ r.ones[:d]).reshape(b, t, 1)
        da *= a
        np.matmul(r.z.T, prob.T, out=r.of["u"])
        prob.sum(axis=1, out=r.of["c"])
        far, behind = r.far
        r.of["d"][:] = np.bincount(far, (r.ones[:b] @ da.reshape(b, -1)).reshape(t, t)[behind], minlength=SPAN)
        for to, one, other in zip(r.downs, (da, da.transpose(0, 2, 1), a.transpose(0, 2, 1)), (r.k, r.q, r.dz3)):
            to[:] = np.matmul(one, other, out=r.back)
        r.downs[3][:] = r.dz3
        np.matmul(e.T, r.down, out=r.of["w"])
        r.of["w"] *= r.factors
        np.matmul(r.down, w.T, out=r.de)
        return np.add.reduceat(r.de.take(order, 0, out=r.sorted, mode="clip"), starts, axis=0), chances

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Mean cross-entropy of target classes y (B, T) after inputs x, its gradients, the ids whose rows of e the gradient "e" holds, and how often x has them; targets of -1 don't count."""
        (flat, order, ids, starts, times, at, places), = self.prepared(x[None], y[None])
        rows, chances = self.gradients(x.shape, flat, order, starts, at, places, told=True)
        return float(-np.log(chances + 1e-30).sum() / max(1, len(chances))), {"e": rows} | {k: v.copy() for k, v in self.rooms.of.items()}, ids, times

    def learn(self, batches: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, int]:
        """Adagrad over all windows of texts, once; returns how often each input was met and the windows.

        batches: (input ids, target classes) of some texts one after another, and the ids of each.
        """
        # the small parts are views of one array, so that one step moves all of them
        dense = np.concatenate([self.p[k].ravel() for k in DENSE])
        for k, part in zip(DENSE, np.split(dense, np.cumsum([self.p[k].size for k in DENSE])[:-1])):
            self.p[k] = part.reshape(self.p[k].shape)
        squares, rows_squares, rate = np.full(dense.shape, 1e-6, self.dtype), np.full(self.n + 1, 1e-6, self.dtype), self.dtype(RATE)
        met, windows, held, size, fresh = np.zeros(self.n + 1, np.int64), 0, [], 0, True

        def step(shape: tuple[int, int], flat: np.ndarray, order: np.ndarray, ids: np.ndarray, starts: np.ndarray, times: np.ndarray, at: np.ndarray | None, places: np.ndarray) -> None:
            nonlocal squares, dense
            rows, _ = self.gradients(shape, flat, order, starts, at, places)
            met[ids] += times
            seen = rows_squares.take(ids)
            seen += np.einsum("ij,ij->i", rows, rows) / self.dtype(self.width)
            rows_squares[ids] = seen
            rows *= (rate / np.sqrt(seen))[:, None]
            self.p["e"][ids] -= rows
            g = self.rooms.g
            squares += g * g
            g /= np.sqrt(squares)
            g *= rate / 2
            dense -= g

        def steps(last: bool) -> None:
            nonlocal held, size, fresh
            x, y = (np.concatenate(z) for z in zip(*held))
            if fresh:  # from the shares of the classes in the first windows
                seen, fresh = np.bincount(y[y >= 0], minlength=self.classes) + 1.0, False
                self.p["c"][:] = np.log(seen / seen.sum())
            whole = len(x) // BATCH * BATCH
            for at in range(0, whole, 8 * BATCH):
                some = slice(at, min(at + 8 * BATCH, whole))
                for known in self.prepared(x[some].reshape(-1, BATCH, SPAN), y[some].reshape(-1, BATCH, SPAN)):
                    step((BATCH, SPAN), *known)
            if last and whole < len(x):
                step((len(x) - whole, SPAN), *self.prepared(x[None, whole:], y[None, whole:])[0])
                whole = len(x)
            held, size = ([(x[whole:], y[whole:])] if whole < len(x) else []), len(x) - whole

        for x, y, sizes in batches:
            n = -(-sizes // SPAN)
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1]) + np.repeat((np.cumsum(n) - n) * SPAN - ends + sizes, sizes)
            xs, ys = np.zeros(n.sum() * SPAN, x.dtype), np.full(n.sum() * SPAN, -1, y.dtype)
            xs[at], ys[at] = x, y
            held.append((xs.reshape(-1, SPAN), ys.reshape(-1, SPAN)))
            windows, size = windows + int(n.sum()), size + int(n.sum())
            if size >= 8 * BATCH:
                steps(False)
        if held:
            steps(True)
        return met, windows

    def tables(self) -> dict[str, np.ndarray]:
        """What score() needs: the projections of every input; input n + 1 is a masked position."""
        q, k, v, r = (np.vstack([x, np.zeros((1, self.width))]).astype(np.float32) for x in np.split(self.p["e"] @ self.p["w"], 4, axis=1))
        return {"q": q * np.float32(self.width**-0.5), "k": k, "v": v, "r": r, "u": self.p["u"].astype(np.float32), "c": self.p["c"].astype(np.float32), "bias": self._bias(STRIDE, SPAN).astype(np.float32)}


def score(tables: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log probability of each text's target classes. inputs, targets: those of the texts one after another.

    Windows of STRIDE scored positions overlap by the BACK positions before them; every position is scored once.
    """
    masked = len(tables["q"]) - 1
    windows = -(-sizes // STRIDE)
    # every text is laid out behind BACK masked positions and filled up to whole windows, so that windows are plain slices
    rooms = BACK + windows * STRIDE
    begins = np.cumsum(rooms) - rooms
    to = np.arange(sizes.sum()) + np.repeat(begins + BACK - np.cumsum(sizes) + sizes, sizes)
    laid, asked = np.full(rooms.sum(), masked, np.int32), np.full(rooms.sum(), -1, np.int32)
    laid[to], asked[to] = inputs, targets
    owner = np.repeat(np.arange(len(sizes)), windows)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    base = np.repeat(begins, windows) + place * STRIDE
    out = np.zeros(len(sizes))
    width = tables["k"].shape[1]
    before, after = np.hstack([tables["q"], tables["r"]]), np.hstack([tables["k"], tables["v"]])
    offsets, ones, kinds = np.arange(SPAN), np.ones(SPAN, np.float32), np.ones(tables["u"].shape[1], np.float32)
    for at in range(0, len(owner), AT_ONCE):
        o = owner[at : at + AT_ONCE]
        index = base[at : at + AT_ONCE, None] + offsets
        x, y = laid.take(index), asked.take(index[:, BACK:])
        qr, kv = before.take(x[:, BACK:], 0), after.take(x, 0)
        s = qr[:, :, :width] @ kv[:, :, :width].transpose(0, 2, 1)
        s += tables["bias"]
        early = np.flatnonzero(place[at : at + AT_ONCE] * STRIDE < BACK)  # only a text's first windows have positions before its start
        s[early] += np.where(x[early] == masked, np.float32(-1e9), np.float32(0))[:, None, :]
        np.exp(np.clip(s, -np.inf, MOST, out=s), out=s)
        z = s @ kv[:, :, width:]
        z /= (s.reshape(-1, SPAN) @ ones).reshape(len(s), STRIDE, 1)
        z += qr[:, :, width:]
        wanted = y >= 0
        whole = wanted.all()
        rows, y = (z.reshape(-1, width), y.ravel()) if whole else (z[wanted], y[wanted])
        logits = rows @ tables["u"]
        logits += tables["c"]
        np.clip(logits, -MOST, MOST, out=logits)
        chosen = logits[np.arange(len(y)), y]
        logp = chosen - np.log(np.exp(logits, out=logits) @ kinds)
        of = np.repeat(o, STRIDE) if whole else np.repeat(o, wanted.sum(axis=1))
        out += np.bincount(of, logp, minlength=len(sizes))
    return out
