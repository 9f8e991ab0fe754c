"""Byte-level kernel of the repeated-passage operator (NumPy only).

A window is a run of ``window`` bytes inside one document.  Each window names
one *designated* position: the leftmost of its ``gram``-byte grams with the
smallest hash.  The choice depends on the window's bytes alone, so two equal
windows designate the same gram at the same offset, and the windows that
designate one position form one unbroken range of starts.  That makes the
designated positions a complete, sparse set of suffix starts.
"""

from __future__ import annotations

import numpy as np

#: Bytes that are worked on at a time; longer texts are cut, windows overlap.
CHUNK = 1 << 18

U64 = np.uint64


def _table(seed: int) -> np.ndarray:
    """256 random odd 64-bit values, the same in every process."""
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


_TABLES = (_table(20240601), _table(20240602))
_BASES = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


_POWERS: dict[int, list[np.ndarray]] = {}


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, cached for the longest call."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK + 4096)
        base = int(_BASES[which])
        inverse = pow(base, -1, 1 << 64)
        up, down = np.full(size, U64(base)), np.full(size, U64(inverse))
        up[0] = down[0] = 1
        have = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
        _POWERS[which] = have
    return have[0], have[1]


class Names:
    """Names of substrings: equal bytes have equal names, whatever their place."""

    def __init__(self, data: np.ndarray, which: int):
        self.which = which
        up, self.down = _powers(len(data) + 1, which)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(_TABLES[which][data] * up[: len(data)], out=self.sums[1:])

    def all(self, length: int) -> np.ndarray:
        """Names of the substrings of that length at every start."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Names of [start, end); the length is part of the name."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, in three passes."""
    n = len(x)
    if n < width:
        return np.empty(0, x.dtype)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(rows, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def designated(data: np.ndarray, ends: np.ndarray, window: int, gram: int):
    """Sparse suffix starts of several documents laid end to end.

    ``ends`` holds the end of each document in ``data``.  Returns arrays
    (document index, first window start, last window start, designated start)
    in positions of ``data``, one entry per unbroken range of window starts.
    """
    n = len(data)
    starts = np.concatenate(([0], ends[:-1]))
    empty = np.empty(0, np.int64)
    if n < window:
        return (empty,) * 4
    names = Names(data, 0).all(gram)
    keyed = (names & U64(0xFFFFFFFF00000000)) | np.arange(len(names), dtype=U64)
    chosen = (sliding_min(keyed, window - gram + 1) & U64(0xFFFFFFFF)).astype(np.int64)
    # a range of starts ends where the choice changes or the document's last window is passed
    change = np.flatnonzero(chosen[1:] != chosen[:-1]) + 1
    last = ends - window
    long_enough = last >= starts
    first_of_doc, last_of_doc = starts[long_enough], last[long_enough]
    if not len(first_of_doc):
        return (empty,) * 4
    cuts = np.unique(np.concatenate((change, first_of_doc, last_of_doc + 1)))
    cuts = cuts[cuts < len(chosen)]
    doc = np.searchsorted(ends, cuts, side="right")
    stop = np.append(cuts[1:], len(chosen)) - 1
    inside = cuts <= last[doc]
    lo, hi, doc = cuts[inside], stop[inside], doc[inside]
    hi = np.minimum(hi, last[doc])
    return doc, lo, hi, chosen[lo]


def pieces(lengths, window: int):
    """Cut long documents into parts that overlap by window - 1 bytes.

    Yields lists of (document index, from, to) of about CHUNK bytes in all.
    """
    held, size = [], 0
    step = CHUNK - (window - 1)
    for i, n in enumerate(lengths):
        at = 0
        while n - at >= window:
            end = min(n, at + CHUNK)
            if held and size + end - at > CHUNK:
                yield held
                held, size = [], 0
            held.append((i, at, end))
            size += end - at
            if end == n:
                break
            at += step
    if held:
        yield held


def doubled_ranks(data: np.ndarray, window: int) -> np.ndarray:
    """Exact ranks of the windows at every start, by doubling: equal ranks are equal bytes.

    The first ranks are bytes, eight of them read as a number.  Pairs (rank
    at i, rank at i + offset) are sorted and numbered at offsets of 8, 16,
    32 and so on, the last one at what the window's length leaves.
    """
    n = len(data) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    length = min(8, window)
    rank = np.zeros(len(data) - length + 1, U64)
    for j in range(length):
        rank = (rank << U64(8)) | data[j : len(data) - length + 1 + j].astype(U64)
    rank = np.unique(rank, return_inverse=True)[1]
    while length < window:
        offset = min(length, window - length)
        pairs = (rank[: len(rank) - offset].astype(U64) << U64(32)) | rank[offset:].astype(U64)
        rank = np.unique(pairs, return_inverse=True)[1]
        length += offset
    return rank
