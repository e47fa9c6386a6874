"""Words and hashes of many texts at once, in numpy, straight from Arrow buffers.

A batch of texts is one byte array and an offset array. Nothing here makes a
Python object per word. All work goes through blocks of about ``BLOCK`` bytes
so that memory stays bounded whatever the batch; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Letters: ASCII ones, and every byte of characters beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = [np.ones(1, np.uint64)]


def powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            _POWERS[0] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 4096), _BASE, np.uint64)]), dtype=np.uint64)
    return _POWERS[0]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n, at = len(column), column.offset
    _, offs, data = column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64)[at : at + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes."""
    data, offs = buffers(column)
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z made lower case; no other byte changes."""
    return _LOWER[data]


def words(data: np.ndarray, offs: np.ndarray, inside: np.ndarray = ~_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, ptr): runs of bytes of ``inside``, else of those that are none of the six ASCII spaces.

    Words of text d are ptr[d] to ptr[d + 1]. Words end at text ends.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    ink = inside[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    cut = offs[(offs > 0) & (offs < n)]
    first[cut] = ink[cut]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    last[cut - 1] = ink[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts:ends]; the spans may not overlap and may not be empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    begins = np.concatenate([[0], np.cumsum(size)[:-1]])
    inside = np.arange(len(at)) - np.repeat(begins, size)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(_BYTE[data[at]] * powers(int(size.max()))[inside], begins)
        return mix(sums + size.astype(np.uint64) * _BASE)


def chain(*hashes: np.ndarray) -> np.ndarray:
    """One hash of several, in order."""
    with np.errstate(over="ignore"):
        out = mix(hashes[0] + np.uint64(1))
        for h in hashes[1:]:
            out = mix(out * _BASE + h)
        return out


def shingles(h: np.ndarray, ptr: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text numbers) of runs of ``k`` words; a text with 1 to k - 1 words gives its whole sequence."""
    count = np.diff(ptr)
    of = np.repeat(np.arange(len(count)), count)
    n = len(h)
    if n >= k:
        full = of[k - 1 :] == of[: n - k + 1]
        whole = chain(*(h[j : n - k + 1 + j] for j in range(k)))
        out, at = whole[full], of[: n - k + 1][full]
    else:
        out, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = [(d, h[ptr[d] : ptr[d + 1]]) for d in np.flatnonzero((count > 0) & (count < k))]
    if short:
        out = np.concatenate([out, *[chain(np.array([len(x)], np.uint64), *(x[i : i + 1] for i in range(len(x)))) for _, x in short]])
        at = np.concatenate([at, np.array([d for d, _ in short])])
        order = np.argsort(at, kind="stable")
        out, at = out[order], at[order]
    return out, at


def unique_in_group(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, hash) pairs in order, and how often each came."""
    if not len(h):
        return h, at, np.zeros(0, np.int64)
    order = np.lexsort((h, at))
    h, at = h[order], at[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    where = np.flatnonzero(new)
    return h[where], at[where], np.diff(np.append(where, len(h)))


def lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, found) of ``wanted`` among sorted distinct ``keys``."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


class Index:
    """Places of 64-bit hashes among sorted distinct keys, by a table on their top bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint64)
        self.bits = max(1, int(np.ceil(np.log2(max(2, len(keys))))) + 1)
        edges = (np.arange((1 << self.bits) + 1, dtype=np.float64) * 2.0 ** (64 - self.bits))
        edges[-1] = 0
        self.first = np.searchsorted(self.keys, edges.astype(np.uint64)).astype(np.int64)
        self.first[-1] = len(keys)
        self.most = int(np.diff(self.first).max()) if len(keys) else 0

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = self.first[(wanted >> np.uint64(64 - self.bits)).astype(np.int64)]
        end = len(self.keys) - 1
        for _ in range(self.most):
            np.minimum(at, end, out=at)
            step = self.keys[at] < wanted
            if not step.any():
                break
            at += step
        np.minimum(at, end, out=at)
        return at, self.keys[at] == wanted
