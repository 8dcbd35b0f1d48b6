"""Word hashes of whole Arrow batches, computed with numpy on the UTF-8 bytes.

A word is a run of bytes of one class; its hash is a polynomial over random 64-bit values of its
bytes, taken from prefix sums, so that no Python object is made for a word. All of it works on
blocks of a few MB, whatever the batch or the text sizes are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_WINDOW_BASE = 0xD1342543DE82EF95 | 1

#: Bytes of A-Z go to a-z, all others stay.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

#: Runs of bytes other than white space (space and \x09-\x0D).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False

#: Runs of ASCII letters and digits and of all bytes beyond ASCII, after FOLD.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64)."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as far as they were asked for."""

    def __init__(self, base: int):
        self.bases = U(base), U(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, base in zip(("up", "down"), self.bases, strict=True):
                steps = np.full(size, base)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_BYTES, _WINDOWS = Powers(_BASE), Powers(_WINDOW_BASE)


@dataclass
class Words:
    """The words of some documents, in order. docs: indexes in the batch; bounds: of the documents' words; edges: of their bytes, to which starts and ends belong."""

    docs: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    edges: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        """For each word, the position of its document in docs."""
        return np.repeat(np.arange(len(self.docs)), self.counts)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows of so many words that lie in one document."""
        return windows(self.hashes, self.owner(), size)


def windows(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(hashes)
    if n < size:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    up, down = _WINDOWS.upto(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up, out=sums[1:])
    starts = np.flatnonzero(owner[: n - size + 1] == owner[size - 1 :])
    return starts, mix((sums[starts + size] - sums[starts]) * down[starts])


def column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string column; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    if not len(array):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = array.buffers()
    bounds = np.frombuffer(bounds, np.int64)[array.offset : array.offset + len(array) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), bounds


def _scan(data: np.ndarray, bounds: np.ndarray, fold: np.ndarray | None, inside: np.ndarray):
    """Folded bytes, starts, ends and hashes of the words between the bounds, which begin at 0."""
    data = fold[data] if fold is not None else data
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return data, none, none, np.empty(0, np.uint64)
    within = inside[data]
    before = np.zeros(n, bool)
    before[1:] = within[:-1]
    edges = bounds[:-1]
    before[edges[edges < n]] = False
    starts = np.flatnonzero(within & ~before)
    after = np.zeros(n, bool)
    after[:-1] = within[1:]
    edges = bounds[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(within & ~after) + 1
    up, down = _BYTES.upto(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return data, starts, ends, hashes


def _cuts(data: np.ndarray, start: int, end: int, inside: np.ndarray, fold: np.ndarray | None) -> list[int]:
    """Places in a long text where no word is cut, about a block apart."""
    out, at = [start], start
    while end - at > BLOCK_BYTES:
        piece = data[at + BLOCK_BYTES : min(end, at + 4 * BLOCK_BYTES)]
        free = np.flatnonzero(~inside[fold[piece] if fold is not None else piece])
        at = at + BLOCK_BYTES + int(free[0]) if len(free) else min(end, at + 4 * BLOCK_BYTES)
        while not len(free) and at < end and inside[fold[data[at]] if fold is not None else data[at]]:
            at += 1  # a word of several MB stays whole
        out.append(at)
    return [*out, end] if out[-1] < end else out


def words(array: pa.Array, inside: np.ndarray, fold: np.ndarray | None = FOLD) -> Iterator[Words]:
    """The words of all documents of a column, some documents at a time: about a block of text, or one longer document."""
    data, bounds = column(array)
    first, n = 0, len(bounds) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + BLOCK_BYTES, "right")) - 1)
        last = min(last, n)
        docs = np.arange(first, last)
        origin = int(bounds[first])
        if bounds[last] - origin <= 4 * BLOCK_BYTES:
            own = bounds[first : last + 1] - origin
            folded, starts, ends, hashes = _scan(data[origin : bounds[last]], own, fold, inside)
            yield Words(docs, np.searchsorted(starts, own), hashes, starts, ends, folded, own)
        else:
            cuts = _cuts(data, origin, int(bounds[last]), inside, fold)
            parts = [_scan(data[a:b], np.array([0, b - a]), fold, inside) for a, b in zip(cuts, cuts[1:], strict=False)]
            hashes = np.concatenate([p[3] for p in parts])
            starts = np.concatenate([p[1] + a - origin for p, a in zip(parts, cuts, strict=False)])
            ends = np.concatenate([p[2] + a - origin for p, a in zip(parts, cuts, strict=False)])
            yield Words(docs, np.array([0, len(hashes)]), hashes, starts, ends, np.concatenate([p[0] for p in parts]), np.array([0, int(bounds[last]) - origin]))
        first = last
