"""Words of whole texts as numpy arrays, without a Python object per word.

A word is a maximal run of ASCII letters, digits and non-ASCII characters of the
lower-cased text. Null and empty texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}
#: Texts are worked on in slices of about so many bytes, to bound memory.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed)) | np.uint64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, SLICE_BYTES + 4096)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _POWERS[key] = np.multiply.accumulate(a)
    return _POWERS["up"], _POWERS["down"]


@dataclass
class Words:
    """``hash[first[d]:first[d + 1]]`` are the words of text ``d``."""

    hash: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not pa.types.is_string(column.type) and not pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an array of strings or binary values without nulls."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, at_most: int = SLICE_BYTES, rows: int = 1 << 16) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive runs of whole texts of about ``at_most`` bytes and ``rows`` rows at most, each with its first index."""
    column = as_strings(column)
    if not len(column):
        return
    _, off = buffers(column)
    start = 0
    while start < len(column):
        end = min(max(start + 1, int(np.searchsorted(off, off[start] + at_most, "right")) - 1), start + rows)
        yield start, column.slice(start, end - start)
        start = end


def words(column: pa.Array) -> Words:
    """Word hashes of an array of texts (of one slice, see ``slices``)."""
    column = pc.utf8_lower(as_strings(column))
    n = len(column)
    if not n:
        return Words(np.zeros(0, np.uint64), np.zeros(1, np.int64))
    raw, off = buffers(column)
    inside = _IN_WORD[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[off] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return Words(spans(raw, begin, end + 1), np.searchsorted(begin, off).astype(np.int64))


def spans(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each stretch of bytes, the same wherever it stands."""
    up, down = powers(len(raw))
    total = np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)
    h = total[end - 1] - np.where(begin > 0, total[begin - 1], np.uint64(0))
    return mix(h * down[begin])


def shingles(w: Words, k: int, seed: int = 1) -> Words:
    """Hashes of ``k`` consecutive words; a text of 1 to ``k - 1`` words has one, of all its words."""
    factor = constants(k, seed)
    padded = np.concatenate([w.hash, np.zeros(k, np.uint64)])
    n, have = len(w.hash), w.counts()
    out = np.zeros(n, np.uint64)
    last = np.repeat(w.first[1:], have)
    where = np.arange(n)
    for j in range(k):
        part = padded[j : j + n] * factor[j]
        if j:
            part[where + j >= last] = 0
        out += part
    count = np.where(have >= k, have - k + 1, np.minimum(have, 1))
    keep = where - np.repeat(w.first[:-1], have) < np.repeat(count, have)
    return Words(mix(out[keep]), np.concatenate([[0], np.cumsum(count)]).astype(np.int64))


def windows(w: Words, length: int, seed: int) -> np.ndarray:
    """A hash of the ``length`` words from each position on, over text ends too; mind those."""
    base = int(constants(1, seed)[0])
    h = np.concatenate([w.hash, np.zeros(length, np.uint64)])
    out, done, span, factor, bits = np.zeros(len(w.hash), np.uint64), 0, 1, 1, length
    # powers of two double up: a window of 2s words is one of s, times base**s, plus the next of s
    level = h
    while bits:
        if bits & 1:
            out = out * np.uint64(pow(base, span, 1 << 64)) + level[done : done + len(w.hash)]
            done += span
        bits >>= 1
        if bits:
            shifted = np.concatenate([level[span:], np.zeros(span, np.uint64)])
            level = level * np.uint64(pow(base, span, 1 << 64)) + shifted
            span *= 2
    return mix(out)


def count_words(column: pa.Array) -> np.ndarray:
    """The number of words of each text."""
    out = [np.zeros(0, np.int64)]
    for _, part in slices(column):
        raw, off = buffers(pc.utf8_lower(part))
        inside = _IN_WORD[raw]
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[off] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        out.append(np.diff(np.searchsorted(np.flatnonzero(begins), off)))
    return np.concatenate(out)
