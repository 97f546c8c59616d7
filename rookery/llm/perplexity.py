"""Scores of a small causal language model, trained here on the corpus itself.

Texts are cut into subword ids by a public byte-level vocabulary, once; the ids are kept for training and scoring.
The model, in numpy, has one block of masked self-attention and a hidden layer over embeddings of ids and places. Its
output is factored: a softmax over classes of ids of like frequency, given the context, times a softmax over the
class's ids, given the context too. The latter begins as the ids' shares of their class, so training starts from the
unigram. Ids are counted over the whole corpus; every id that occurs has an embedding and an output vector of
its own, those that don't occur share one.

Training: all windows of the corpus are dealt, in blocks, to trainers, whose number grows with the corpus. Each takes
Adam steps from the same start, and the mean of their parameters is the start of the next round. Scoring: windows of
``WINDOW`` ids overlap by ``WINDOW - STRIDE``, so each id is scored once, with ``WINDOW - STRIDE`` ids of context at
least (but for a text's first ids), in batches under one causal mask.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import checkpointed, col, table, text_of
from .words import as_strings, buffers, mix, slices, spans

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Ids with rows of their own at most; as many as the vocabulary has.
EMBEDDED = 50256
#: Classes at least; of a corpus with many ids the root of their number, if that is more.
CLASSES = 64
WIDTH, HIDDEN = 16, 32
WINDOW, STRIDE = 32, 24
#: One of so many blocks of windows trains; 1: all.
TRAIN_EVERY = 1
#: Windows that one trainer gets in a round, about, and those of a block.
TRAINER_WINDOWS, BLOCK_WINDOWS = 32_768, 64
ROUNDS, RATE = 4, 0.02
#: Windows of a step at most; fewer, down to the chunk's half, where a trainer's windows would make fewer steps than that.
BATCH, STEPS = 512, 128
#: Windows that go through the layers at a time.
CHUNK = 64
#: Rows whose products are summed at a time.
SUMMED = 256
#: Models that are averaged at once.
FAN_IN = 16
#: Slots for pieces whose ids a worker remembers, and ids that it remembers at most.
SLOTS, REMEMBERED = 1 << 20, 1 << 23
_OTHER, _LETTER, _DIGIT, _BLANK, _WHITE = range(5)
_CLASS = np.zeros(256, np.int8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[9, 10, 11, 12, 13]] = _WHITE
_CLASS[32] = _BLANK


class Encoder:
    """Ids of whole texts, one piece of text at a time, each distinct piece once.

    A piece is a run of letters (all characters beyond ASCII count as such), of digits or of other signs, with one
    blank before it if there is one, or a run of white space.
    """

    def __init__(self, path: str):
        import tiktoken

        ranks = {}
        with open(path, "rb") as f:
            for line in f:
                a, b = line.split()
                ranks[base64.b64decode(a)] = int(b)
        self.own = tiktoken.Encoding("corpus", pat_str=r"[\s\S]", mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self._forget()

    def _forget(self) -> None:
        self.key, self.begin, self.many = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.ids, self.used = np.zeros(1 << 20, np.int32), 0

    def _learn(self, data: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts the ids of these pieces behind those that are known; where they begin, and their number."""
        new: list[int] = []
        many, one = [], self.own._encode_single_piece
        for a, b in zip(begin.tolist(), end.tolist()):
            ids = one(data[a:b])
            many.append(len(ids))
            new += ids
        while self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(new)] = new
        length = np.array(many, np.int32)
        first = self.used + np.cumsum(length, dtype=np.int32) - length
        self.used += len(new)
        return first, length

    def pieces(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces begin, and each text's first."""
        kind = _CLASS[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[off] = True
        new = edge[:-1].copy()
        new[1:] |= kind[1:] != kind[:-1]
        # the last blank of a run goes to what follows it, unless that is white space or another text
        lead = np.zeros(len(raw), bool)
        lead[:-1] = (kind[:-1] == _BLANK) & (kind[1:] != _BLANK) & (kind[1:] != _WHITE) & ~edge[1:-1]
        new[1:] &= ~lead[:-1]
        new |= lead
        # blanks and other white space make one run
        mixed = np.zeros(len(raw), bool)
        mixed[1:] = (kind[1:] >= _BLANK) & (kind[:-1] >= _BLANK) & (kind[1:] != kind[:-1]) & ~edge[1:-1] & ~lead[1:]
        new &= ~mixed
        begin = np.flatnonzero(new)
        return begin, np.searchsorted(begin, off)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, one after the other, and where each text's begin."""
        raw, off = buffers(as_strings(texts))
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        begin, first = self.pieces(raw, off)
        end = np.append(begin[1:], len(raw))
        h = spans(raw, begin, end) | np.uint64(1)
        if self.used > REMEMBERED:
            self._forget()
        slot = (h >> np.uint64(8)).astype(np.int64) & (SLOTS - 1)
        known = self.key[slot] == h
        start, many = self.begin[slot], self.many[slot]
        if not known.all():
            new = np.flatnonzero(~known)
            _, where, which = np.unique(h[new], return_index=True, return_inverse=True)
            where = new[where]
            a, n = self._learn(raw.tobytes(), begin[where], end[where])
            start[new], many[new] = a[which], n[which]
            # of new pieces in one slot the last stays known
            self.key[slot[where]], self.begin[slot[where]], self.many[slot[where]] = h[where], a, n
        stop = np.cumsum(many, dtype=np.int64)
        out = self.ids[np.repeat(start - (stop - many), many) + np.arange(int(stop[-1]))]
        return out, np.concatenate([[0], stop])[first]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Encoder:
    return Encoder(path)


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    return tokenizer(path).encode(texts)


def _short(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 on in 16 bits, if they fit, which sort fastest."""
    return x.astype(np.uint16 if x.max(initial=0) < 65535 else np.int64)


class Vocabulary:
    """Row of the embedding, class, and log share of its class, by id; from counts of all ids.

    Rows go by frequency, and classes are stretches of rows: class c has the rows from ``low[c]`` to ``high[c]``, of log
    masses ``mass[c]`` within it. Ids that don't occur, and those past ``embedded``, share the last row, of which each class has its ids' part.
    All classes' rows one after the other are ``rows_of``, of shares ``part``; class c begins at ``edge[c]``, and ``spot`` is an id's place there.
    """

    def __init__(self, counts: np.ndarray, embedded: int = EMBEDDED, classes: int | None = None):
        occurring = int((counts > 0).sum())
        classes = classes or max(CLASSES, int(np.ceil(np.sqrt(occurring))))
        order = np.argsort(-counts, kind="stable")
        last = min(embedded - 1, occurring)
        self.rows, self.classes = last + 1, classes
        self.row = np.full(len(counts), last, np.int32)
        self.row[order[:last]] = np.arange(last)
        smooth = counts[order].astype(np.float64) + 1
        # of classes with equal sums of roots an id has the fewest others in its class, on average
        mass = np.cumsum(np.sqrt(smooth[:occurring]))
        kind = np.full(len(counts), classes - 1)
        kind[:occurring] = np.minimum(((mass - np.sqrt(smooth[:occurring]) / 2) / mass[-1:].sum() * classes).astype(np.int64), classes - 1)
        total = np.bincount(kind, weights=smooth, minlength=classes)
        self.kind, self.share = np.zeros(len(counts), np.int32), np.zeros(len(counts), np.float32)
        self.kind[order] = kind
        self.share[order] = np.log(smooth / total[kind])
        part = np.bincount(kind * self.rows + self.row[order], weights=smooth, minlength=classes * self.rows).reshape(classes, -1)
        inside = part > 0
        self.low = np.where(inside.any(axis=1), inside.argmax(axis=1), 0)
        self.high = self.low + inside.sum(axis=1)
        self.mass = [np.log(part[c, a:b] / total[c]).astype(np.float32) for c, (a, b) in enumerate(zip(self.low, self.high))]
        self.part = np.exp(np.concatenate(self.mass))
        self.edge = np.concatenate([[0], np.cumsum(self.high - self.low)])
        self.rows_of = np.concatenate([np.arange(a, b) for a, b in zip(self.low, self.high)])
        self.spot = _short(self.edge[self.kind] + self.row - self.low[self.kind])
        self.plain = bool((self.rows_of == np.arange(len(self.rows_of))).all())
        # places of classes of one row, if there are any
        single = np.repeat(np.diff(self.edge) == 1, np.diff(self.edge))
        self.alone = single if single.any() else None


def start(classes: int = CLASSES, embedded: int = EMBEDDED, d: int = WIDTH, hidden: int = HIDDEN, window: int = WINDOW) -> dict[str, np.ndarray]:
    """Random parameters, but for ``i``, the output vectors within a class, which are 0."""
    r = np.random.default_rng(7)
    w = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    return {
        "e": (r.standard_normal((embedded + 1, d)) * 0.3).astype(np.float32), "p": (r.standard_normal((window, d)) * 0.1).astype(np.float32), "qkv": w(d, 3 * d), "o": w(d, d) * np.float32(0.5),
        "w1": w(d, hidden), "b1": np.zeros(hidden, np.float32), "w2": w(hidden, d) * np.float32(0.5), "u": w(d, classes) * np.float32(0.5), "c": np.zeros(classes, np.float32),
        "i": np.zeros((embedded, d), np.float32),
    }


def cut(m: dict[str, np.ndarray], v: Vocabulary) -> dict[str, np.ndarray]:
    """The model with the rows that the vocabulary uses, and the start mark."""
    return m | {"e": np.concatenate([m["e"][: v.rows], m["e"][-1:]]), "i": m["i"][: v.rows].copy()}


def whole(small: dict[str, np.ndarray], m: dict[str, np.ndarray], v: Vocabulary) -> dict[str, np.ndarray]:
    """The cut model put back among the rows of ``m``."""
    e, i = m["e"].copy(), m["i"].copy()
    e[: v.rows], e[-1], i[: v.rows] = small["e"][:-1], small["e"][-1], small["i"]
    return small | {"e": e, "i": i}


@lru_cache(maxsize=256)
def _mask(n: int) -> np.ndarray:
    return np.tril(np.ones((n, n), np.float32))


def _scaled(qkv: np.ndarray) -> np.ndarray:
    """These weights, or their gradient, with those of queries divided by the root of the width."""
    d = len(qkv)
    out = qkv.copy()
    out[:, :d] *= np.float32(d**-0.5)
    return out


def hidden(m: dict[str, np.ndarray], rows: np.ndarray, skip: int = 0, qkv: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """All that is computed up to the last layer, which comes last, at every place of windows of rows; skip: of the first places only what later ones attend to; qkv: the scaled weights, if they are at hand."""
    b, n = rows.shape
    d = m["p"].shape[1]
    x = m["e"].take(rows, axis=0)
    x += m["p"][:n]
    both = (x.reshape(-1, d) @ (_scaled(m["qkv"]) if qkv is None else qkv)).reshape(b, n, 3 * d)
    q, k, v = both[:, skip:, :d], both[:, :, d : 2 * d], both[:, :, 2 * d :]
    s = q @ _turned(k)
    # the mask: later places get no weight
    np.minimum(s, np.float32(60), out=s)
    np.exp(s, out=s)
    s *= _mask(n)[skip:]
    total = (s.reshape(-1, n) @ _ones(n)).reshape(b, -1, 1)
    y = s @ v
    y /= total
    h = y.reshape(-1, d) @ m["o"]
    h += x[:, skip:].reshape(-1, d)
    r = h @ m["w1"]
    r += m["b1"]
    np.maximum(r, 0, out=r)
    z = r @ m["w2"]
    z += h
    return x, q, k, v, s, total, y, h, r, z


def forward(m: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Scores of the classes at every place of windows of rows."""
    return hidden(m, rows)[-1] @ m["u"] + m["c"]


def _turned(x: np.ndarray) -> np.ndarray:
    """A copy of each matrix with rows and columns exchanged; for narrow ones copy and product take less time than the product alone."""
    return np.ascontiguousarray(x.transpose(0, 2, 1))


def _summed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x.T @ y, by blocks of rows, as a product of narrow matrices takes half the time while its sums are short."""
    n = len(x) - len(x) % SUMMED
    out = x[n:].T @ y[n:]
    if n:
        out += (x[:n].reshape(-1, SUMMED, x.shape[1]).transpose(0, 2, 1) @ y[:n].reshape(-1, SUMMED, y.shape[1])).sum(axis=0)
    return out


def _exp(x: np.ndarray, most: float = np.inf) -> np.ndarray:
    """The exponentials, in place, of numbers of ``most`` at most; what may overflow, if summed, is cut."""
    if not most <= 80:
        np.minimum(x, np.float32(80), out=x)
    return np.exp(x, out=x)


def _longest(x: np.ndarray) -> float:
    """Length of the longest row: no product of rows is above that of their lengths."""
    return float(np.sqrt(((x * x) @ _ones(x.shape[1])).max(initial=0)))


def inside(m: dict[str, np.ndarray], v: Vocabulary, z: np.ndarray, ids: np.ndarray, w: np.ndarray | None = None, g: dict[str, np.ndarray] | None = None, dz: np.ndarray | None = None, most: float = np.inf) -> np.ndarray:
    """Log probability of each id in its class, given the last layer; most: what no product of it and the vectors exceeds.

    With weights w, the gradients of the mean loss are added to g["i"] and dz; of weight 0 are places without an id.
    """
    spot = v.spot[ids]
    order = np.argsort(spot, kind="stable")
    spot = spot[order]
    edges = np.searchsorted(spot, v.edge.astype(spot.dtype)).tolist()
    classes = [(slice(a, b), slice(c, d)) for a, b, c, d in zip(edges, edges[1:], v.edge.tolist(), v.edge[1:].tolist()) if b > a]
    vectors = m["i"][: len(v.part)] if v.plain else m["i"].take(v.rows_of, axis=0)
    z, mine = z.take(order, axis=0), vectors.take(spot, axis=0)
    one, total, scores = _ones(z.shape[1]), np.empty(len(ids), np.float32), []
    found = (z * mine) @ one
    # class by class only what can't be done for all at once; shares and weights go with the vectors, which have fewer numbers than the scores
    for here, rows in classes:
        p = _exp(z[here] @ vectors[rows].T, most)
        np.matmul(p, v.part[rows], out=total[here])
        if w is not None:
            scores.append(p)
    found -= np.log(total)
    if v.alone is not None:
        found[v.alone[spot]] = 0
    if w is not None:
        w = w[order]
        weighed, turn, slope = z * (w / total)[:, None], np.zeros_like(vectors), np.empty_like(z)
        shared = vectors * v.part[:, None]
        for p, (here, rows) in zip(scores, classes):
            np.matmul(p.T, weighed[here], out=turn[rows])
            np.matmul(p, shared[rows], out=slope[here])
        turn *= v.part[:, None]
        slope *= (w / total)[:, None]
        mine *= w[:, None]
        slope -= mine
        z *= w[:, None]
        where = _runs(spot)
        turn[spot[where]] -= np.add.reduceat(z, where, axis=0)
        if v.plain:
            g["i"][: len(turn)] += turn
        else:
            np.add.at(g["i"], v.rows_of, turn)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        dz += slope.take(back, axis=0)
    out = v.share[ids]
    out[order] += found
    return out


def _runs(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal numbers begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1]))


def _output(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, float]:
    """Of the classes: what is added to their scores, 0 at most; its exponentials; and the length of their longest vector."""
    add = np.maximum(m["c"] - m["c"].max(), np.float32(-60))
    return add, np.exp(add), _longest(m["u"].T)


@lru_cache(maxsize=4096)
def _ones(n: int) -> np.ndarray:
    return np.ones(n, np.float32)


def gradients(m: dict[str, np.ndarray], rows: np.ndarray, kinds: np.ndarray, real: np.ndarray, voc: Vocabulary | None = None, ids: np.ndarray | None = None, g: dict[str, np.ndarray] | None = None) -> tuple[dict[str, np.ndarray], float]:
    """Gradient of the mean loss over the real targets, and that loss; without ids that of their classes alone. g: arrays to be used for it."""
    b, n = rows.shape
    d = m["p"].shape[1]
    g = g or {key: np.empty_like(value) for key, value in m.items()}
    for key in g:
        g[key][...] = 0
    kinds, w = kinds.ravel(), real.ravel().astype(np.float32)
    w /= max(float(w.sum()), 1.0)
    kept, loss, longest, (add, grown, widest), qkv = [], 0.0, [], _output(m), _scaled(m["qkv"])
    turned = m["u"].T * grown[:, None]
    z, dz = np.empty((b * n, d), np.float32), np.empty((b * n, d), np.float32)
    # few windows at a time, so that what they need stays in the caches
    for begin in range(0, b, CHUNK):
        x = hidden(m, rows[begin : begin + CHUNK], 0, qkv)
        at = slice(begin * n, begin * n + len(x[-1]))
        z[at] = x[-1]
        p = x[-1] @ m["u"]
        kind = kinds[at]
        target = np.arange(0, p.size, p.shape[1]) + kind
        own = p.ravel()[target] + add[kind]
        longest.append(_longest(x[-1]))
        _exp(p, longest[-1] * widest)
        total = p @ grown
        loss -= float(((own - np.log(total)) * w[at]).sum())
        p.ravel()[target] -= total / grown[kind]
        # weights go with the layer, which has fewer numbers than the scores
        share = w[at] / total
        g["u"] += _summed(x[-1] * share[:, None], p)
        g["c"] += share @ p
        np.matmul(p, turned, out=dz[at])
        dz[at] *= share[:, None]
        kept.append((at, x[:-1]))
    g["u"] *= grown
    g["c"] *= grown
    if voc is not None:
        loss -= float((inside(m, voc, z, ids.ravel(), w, g, dz, max(longest) * _longest(m["i"])) * w).sum())
    for at, (x, q, k, v, s, total, y, h, r) in kept:
        dh = dz[at]
        g["w2"] += _summed(r, dh)
        da = dh @ m["w2"].T
        da *= r > 0
        g["w1"] += _summed(h, da)
        g["b1"] += _ones(len(da)) @ da
        dh += da @ m["w1"].T
        g["o"] += _summed(y.reshape(-1, d), dh)
        dy = (dh @ m["o"].T).reshape(y.shape)
        dy /= total
        both = np.empty((*y.shape[:2], 3 * d), np.float32)
        np.matmul(s.transpose(0, 2, 1), dy, out=both[:, :, 2 * d :])
        ds = dy @ _turned(v)
        ds -= ((dy * y).reshape(-1, d) @ _ones(d)).reshape(len(y), -1, 1)
        ds *= s
        np.matmul(ds, k, out=both[:, :, :d])
        np.matmul(ds.transpose(0, 2, 1), q, out=both[:, :, d : 2 * d])
        both = both.reshape(-1, 3 * d)
        g["qkv"] += _summed(x.reshape(-1, d), both)
        dh += both @ qkv.T
        g["p"][:n] += dh.reshape(y.shape).sum(0)
    g["qkv"][:] = _scaled(g["qkv"])
    # sums by row, in its order
    rows = _short(rows.ravel())
    order = np.argsort(rows, kind="stable")
    where = _runs(rows := rows[order])
    g["e"][rows[where]] = np.add.reduceat(dz.take(order, axis=0), where, axis=0)
    return g, loss


def _views(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, x in like.items():
        out[k] = flat[at : at + x.size].reshape(x.shape)
        at += x.size
    return out


def train(m: dict[str, np.ndarray], voc: Vocabulary, tokens: np.ndarray, real: np.ndarray, rate: float = RATE) -> dict[str, np.ndarray]:
    """One pass of Adam over windows of ids, with a falling rate."""
    p = np.concatenate([x.ravel() for x in m.values()])
    g, first, second, room = (np.zeros_like(p) for _ in range(4))
    now, slope = _views(p, m), _views(g, m)
    batch = min(BATCH, max(CHUNK // 2, len(tokens) // STEPS))
    steps = -(-len(tokens) // batch)
    for t in range(steps):
        part = slice(t * batch, (t + 1) * batch)
        ids = tokens[part]
        gradients(now, _inputs(voc, ids, real[part], len(m["e"]) - 1), voc.kind[ids], real[part], voc, ids, slope)
        # means of ten gradients and of a hundred squares, as sums: their factors are in the pace
        pace = np.float32(rate * (1 - t / steps) * np.sqrt(1 - 0.99 ** (t + 1)) / (1 - 0.9 ** (t + 1)))
        first *= np.float32(0.9)
        first += g
        np.multiply(g, g, out=g)
        second *= np.float32(0.99)
        second += g
        np.sqrt(second, out=room)
        room += np.float32(1e-5)
        np.divide(first, room, out=room)
        room *= pace
        p -= room
    return {k: x.copy() for k, x in now.items()}


def pack(m: dict[str, np.ndarray]) -> bytes:
    return b"".join(m[k].tobytes() for k in sorted(m))


def unpack(data: bytes, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        n = like[k].nbytes
        out[k] = np.frombuffer(data[at : at + n], np.float32).reshape(like[k].shape)
        at += n
    return out


def _windows(first: np.ndarray, window: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first place, number of ids, and ids already scored before, of every window of texts of these bounds."""
    n = np.diff(first)
    many = np.where(n > 0, 1 + np.maximum(0, -(-(n - window) // stride)), 0)
    doc = np.repeat(np.arange(len(n)), many)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    begin = k * stride
    size = np.minimum(window, n[doc] - begin)
    return doc, first[doc] + begin, size, np.where(k > 0, window - stride, 0)


def _gather(ids: np.ndarray, begin: np.ndarray, size: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    at = begin[:, None] + np.arange(window)
    if (size == window).all():
        return ids[at], np.ones(at.shape, bool)
    real = np.arange(window) < size[:, None]
    return np.where(real, ids[np.minimum(at, len(ids) - 1)], 0), real


def _inputs(v: Vocabulary, ids: np.ndarray, real: np.ndarray, embedded: int) -> np.ndarray:
    """Rows of the ids before each place; the window's first place has the start mark."""
    rows = np.full(ids.shape, embedded, np.int32)
    rows[:, 1:] = v.row[ids[:, :-1]] if real.all() else np.where(real[:, :-1], v.row[ids[:, :-1]], embedded)
    return rows


def score(m: dict[str, np.ndarray], v: Vocabulary, ids: np.ndarray, first: np.ndarray, window: int = WINDOW, stride: int = STRIDE, batch: int = BATCH) -> np.ndarray:
    """Sum of the log probabilities of each text's ids, each scored once."""
    doc, begin, size, seen = _windows(first, window, stride)
    out, farthest, (add, grown, widest) = np.zeros(len(first) - 1), _longest(m["i"]), _output(m)
    qkv = _scaled(m["qkv"])
    # full windows and short ones apart, so that short texts don't pay for padding, and first ones and others, which skip what is scored before
    order = np.lexsort((seen, size))
    for t in range(0, len(order), batch):
        layer, target, log, longest = [], [], [], []
        for pick in np.split(order[t : t + batch], range(CHUNK, batch, CHUNK)):
            if not len(pick):
                continue
            n, skip = int(size[pick[-1]]), int(seen[pick].min())
            tokens, real = _gather(ids, begin[pick], size[pick], n)
            z = hidden(m, _inputs(v, tokens, real, len(m["e"]) - 1), skip, qkv)[-1]
            own = tokens[:, skip:].ravel()
            if int(size[pick[0]]) < n or int(seen[pick].max()) > skip:
                # only the places that this window scores
                which = np.flatnonzero((real & (np.arange(n) >= seen[pick][:, None]))[:, skip:])
                z, own = z.take(which, axis=0), own[which]
            kind, logits = v.kind[own], z @ m["u"]
            log.append(logits.ravel()[np.arange(0, logits.size, logits.shape[1]) + kind] + add[kind])
            longest.append(_longest(z))
            log[-1] -= np.log(_exp(logits, longest[-1] * widest) @ grown)
            layer.append(z), target.append(own)
        got = np.concatenate(log) + inside(m, v, np.concatenate(layer), np.concatenate(target), most=max(longest) * farthest)
        # every window scores some ids
        now = order[t : t + batch]
        many = size[now] - seen[now]
        out += np.bincount(doc[now], weights=np.add.reduceat(got, np.cumsum(many) - many, dtype=np.float64), minlength=len(out))
    return out


def _keep_memory() -> None:
    """Tells the C library to keep what arrays free for the next ones, instead of giving the pages back each time."""
    import ctypes

    try:
        own = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError):
        return
    own(-1, 1 << 28), own(-3, 1 << 28)  # M_TRIM_THRESHOLD, M_MMAP_THRESHOLD


def _word(size: int) -> type:
    return np.uint16 if size <= 65536 else np.uint32


def coded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, name, ids) of every row: a hash of the id, if there is such a column, and of the text, and the text's ids. Null texts have none."""
    size = tokenizer(path).size
    own = col(id_col) if id_col in docs.columns else F.lit(None).cast("long")
    slim = docs.select(own.alias("doc_id"), F.xxhash64(own.cast("string"), text_of(docs, text_col)).alias("name"), text_of(docs, text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch.column("text")):
                ids, first = encode(part, path)
                data = ids.astype(_word(size))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), batch.column("name").slice(at, len(part)), _binary(data, first)], names=["doc_id", "name", "ids"])

    return checkpointed(slim.mapInArrow(cut_up, f"doc_id {kind}, name long, ids binary"))


def _binary(data: np.ndarray, first: np.ndarray) -> pa.Array:
    """The stretches of data between these bounds as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((first * data.itemsize).astype(np.int32)), pa.py_buffer(data)])


def _ids(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, one after the other, and where each row's begin."""
    raw, off = buffers(column)
    word = np.dtype(_word(size))
    return np.frombuffer(raw.tobytes(), word), off // word.itemsize


def fit(docs: DataFrame, text_col: str = "text", path: str = VOCABULARY, every: int = TRAIN_EVERY, trainer_windows: int = TRAINER_WINDOWS, rounds: int = ROUNDS, id_col: str = "doc_id", ids: DataFrame | None = None) -> tuple[dict[str, np.ndarray], Vocabulary]:
    """The model and the vocabulary of a corpus; ids: what ``coded`` gives for it, if that is at hand.

    Null and empty texts have no ids; an empty corpus leaves the starting model. Texts are cut into blocks of windows, which are
    dealt by a hash of the document's id (if there is such a column), its text and the block's place, so that copies spread over trainers.
    """
    size = tokenizer(path).size
    ids = (coded(docs, id_col, text_col, path) if ids is None else ids).select("name", "ids").where(F.length("ids") > 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, windows = np.zeros(size + 1, np.int64), 0
        for batch in batches:
            got, first = _ids(batch.column("ids"), size)
            counts[:size] += np.bincount(got, minlength=size)
            windows += int((-(-np.diff(first) // WINDOW)).sum())
        # the last is the number of windows
        counts[size] = windows
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(counts[there])], names=["id", "n"])

    counts = np.zeros(size + 1, np.int64)
    for r in ids.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    v, total = Vocabulary(counts[:size]), int(counts[size])
    m = start(v.classes)
    like = {k: np.empty_like(x) for k, x in cut(m, v).items()}
    share = docs.sparkSession.sparkContext.broadcast

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = BLOCK_WINDOWS * WINDOW
        for batch in batches:
            got, first = _ids(batch.column("ids"), size)
            many = -(-np.diff(first) // span)
            doc = np.repeat(np.arange(len(many)), many)
            place = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            h = mix(batch.column("name").to_numpy().view(np.uint64)[doc] + mix(place.astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), _binary(got, np.append(first[doc] + place * span, len(got)))], names=["h", "ids"])

    dealt = ids.mapInArrow(blocks, "h long, ids binary").where(F.pmod("h", F.lit(every)) == 0)
    schema = "branch long, weight double, model binary"
    for round_ in range(rounds if total else 0):
        trainers = max(1, round(total / every / rounds / trainer_windows))
        model = share((pack(cut(m, v)), v))

        def one(key: tuple, group: pa.Table) -> pa.Table:
            _keep_memory()
            data, voc = model.value
            group = group.sort_by("h").combine_chunks()
            got, first = _ids(pa.concat_arrays(group.column("ids").chunks), size)
            _, begin, length, _ = _windows(first, WINDOW, WINDOW)
            order = np.random.default_rng(round_).permutation(len(begin))
            tokens, real = _gather(got, begin[order], length[order], WINDOW)
            trained = train(unpack(data, like), voc, tokens.astype(np.int32), real)
            return pa.table({"branch": [key[0].as_py() // FAN_IN], "weight": [float(len(order))], "model": [pack(trained)]})

        def mean(frame: pd.DataFrame) -> pd.DataFrame:
            total_ = sum(w * np.frombuffer(x, np.float32).astype(np.float64) for w, x in zip(frame["weight"], frame["model"])) / frame["weight"].sum()
            return pd.DataFrame({"branch": [int(frame["branch"].iloc[0]) // FAN_IN], "weight": [frame["weight"].sum()], "model": [total_.astype(np.float32).tobytes()]})

        mine = dealt.where(F.pmod(F.shiftright("h", 8), F.lit(rounds)) == round_).withColumn("trainer", F.pmod(F.shiftright("h", 16), F.lit(trainers)))
        got = mine.groupBy("trainer").applyInArrow(one, schema)
        while True:
            got = checkpointed(got.groupBy("branch").applyInPandas(mean, schema))
            if got.count() <= 1:
                break
        if row := got.first():
            m = whole({k: x.copy() for k, x in unpack(row.model, like).items()}, m, v)
    return m, v


def scores(docs: DataFrame, m: dict[str, np.ndarray], v: Vocabulary, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, ids: DataFrame | None = None) -> DataFrame:
    """(doc_id, tokens, nll, perplexity) of every row: number of ids, mean negative log probability, and its exponential.

    Null, empty and idless texts have 0 tokens and null scores. Repeated rows stay; whole texts are scored; other
    columns are left out. ids: what ``coded`` gives for the rows, if that is at hand.
    """
    size = tokenizer(path).size
    ids = coded(docs, id_col, text_col, path) if ids is None else ids
    small = cut(m, v)
    shared = docs.sparkSession.sparkContext.broadcast((pack(small), v))
    like = {k: np.empty_like(x) for k, x in small.items()}
    kind = ids.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_memory()
        data, voc = shared.value
        model = unpack(data, like)
        for batch in batches:
            got, first = _ids(batch.column("ids"), size)
            count = np.diff(first)
            sums = score(model, voc, got, first)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count.astype(np.float64)), pa.array(-sums / np.maximum(count, 1), mask=count == 0)], names=["doc_id", "tokens", "nll"])

    return ids.select("doc_id", "ids").mapInArrow(judge, f"doc_id {kind}, tokens double, nll double").withColumn("perplexity", F.exp("nll"))


def op9_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ids = coded(docs)
    m, v = fit(docs, ids=ids)
    return scores(docs, m, v, ids=ids)
