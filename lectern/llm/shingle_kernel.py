"""Word shingles and their wide SimHash (NumPy), for many texts at a time.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased.  A shingle's name is a
64-bit hash of its words' hashes; a text below k words is one shingle, one
without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

from lectern.llm.repeat_kernel import mix

U64 = np.uint64
#: Bytes of text worked on at a time; a longer text is cut at white space.
BLOCK = 1 << 19
#: Words longer than this are hashed one by one.
LONG = 64
#: Shingles whose bits are summed at a time.
ROWS = 1 << 14

_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LOW = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_draw = np.random.default_rng(20240603)
_LETTER = _draw.integers(1, 1 << 62, 256, dtype=np.uint64) * U64(2) + U64(1)
_PLACE = _draw.integers(1, 1 << 62, LONG, dtype=np.uint64) * U64(2) + U64(1)
_ORDER = _draw.integers(1, 1 << 62, 64, dtype=np.uint64) * U64(2) + U64(1)
_LANES = _draw.integers(1, 1 << 62, (2, 64), dtype=np.uint64) * U64(2) + U64(1)
#: A byte's bits, each in a byte of its own: sums of up to 255 don't run over.
_SPREAD = np.array([sum((b >> i & 1) << 8 * i for i in range(8)) for b in range(256)], U64)


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words of a block, and where they begin."""
    space = _SPACE[raw]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    begins, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(begins):
        return np.empty(0, U64), begins
    sizes = ends - begins
    step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    value = _LETTER[_LOW[raw[np.repeat(begins, sizes) + step]]] * _PLACE[np.minimum(step, LONG - 1)]
    names = np.add.reduceat(value, np.cumsum(sizes) - sizes)
    for i in np.flatnonzero(sizes > LONG):
        names[i] = xxhash.xxh64_intdigest(_LOW[raw[begins[i] : ends[i]]].tobytes(), 1)
    return mix(names + sizes.astype(U64) * _ORDER[0]), begins


def _one(raw: np.ndarray) -> np.ndarray:
    """Names of the words of a text of any length."""
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        while end < len(raw):
            gaps = np.flatnonzero(_SPACE[raw[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end = min(len(raw), end + BLOCK)  # one word fills the block
        out.append(_words(raw[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, U64)


def _blocks(texts: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, words' names, words of each text) for runs of texts."""
    held: list[np.ndarray] = []
    first = size = 0

    def settle() -> tuple[int, np.ndarray, np.ndarray]:
        ends = np.cumsum([len(t) + 1 for t in held])
        gap = np.full(1, 32, np.uint8)
        names, begins = _words(np.concatenate([x for t in held for x in (t, gap)]))
        return first, names, np.bincount(np.searchsorted(ends, begins, side="right"), minlength=len(held))

    for i, t in enumerate(texts):
        if len(t) > BLOCK:
            if held:
                yield settle()
            names = _one(t)
            yield i, names, np.array([len(names)])
            held, first, size = [], i + 1, 0
            continue
        held.append(t)
        size += len(t)
        if size >= BLOCK:
            yield settle()
            held, first, size = [], i + 1, 0
    if held:
        yield settle()


def sets(texts: list[np.ndarray], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, sorted distinct shingles of each text one after another, how many each has)."""
    for first, names, n in _blocks(texts):
        begin = np.cumsum(n) - n
        many = np.maximum(n - k + 1, np.minimum(n, 1))
        doc = np.repeat(np.arange(len(n)), many)
        at = np.repeat(begin, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        size = np.minimum(n, k)[doc]
        total = size.astype(U64)
        for j in range(k):
            here = np.minimum(at + j, len(names) - 1)
            total += np.where(j < size, names[here] * _ORDER[j % 64] + U64(j), U64(0)) if len(names) else U64(0)
        total = mix(total)
        order = np.lexsort((total, doc))
        total, doc = total[order], doc[order]
        new = np.ones(len(total), bool)
        new[1:] = (total[1:] != total[:-1]) | (doc[1:] != doc[:-1])
        yield first, total[new], np.bincount(doc[new], minlength=len(n))


def simhash(shingles: np.ndarray, n: np.ndarray, lanes: int) -> np.ndarray:
    """64 x lanes bits of each set, as ``lanes`` integers: those set in over half of its shingles' hashes."""
    total = np.zeros((len(n), 64 * lanes), np.int64)
    ends = np.cumsum(n)
    # rows are summed in runs of 255 at most, none across two sets
    parts = -(-n // 255)
    doc = np.repeat(np.arange(len(n)), parts)
    cuts = np.repeat(ends - n, parts) + 255 * (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts))
    at = 0
    while at < len(cuts):
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + ROWS)))
        stop = int(cuts[to]) if to < len(cuts) else len(shingles)
        some = shingles[cuts[at] : stop]
        hashes = np.stack([mix(some * _LANES[0, j] + _LANES[1, j]) for j in range(lanes)], axis=1)
        spread = _SPREAD[hashes.view(np.uint8).reshape(len(some), 8 * lanes)]
        sums = np.add.reduceat(spread, cuts[at:to] - cuts[at], axis=0)
        np.add.at(total, doc[at:to], sums.view(np.uint8).reshape(to - at, 64 * lanes))
        at = to
    return np.packbits(2 * total > n[:, None], axis=1).view(np.uint64)


def parities(shingles: np.ndarray, n: np.ndarray, lanes: int) -> np.ndarray:
    """Whether each set has an odd number of shingles in each of 64 x lanes classes, as ``lanes`` integers.

    Two sets differ in no fewer shingles than parities.
    """
    out = np.empty((len(n), lanes), np.uint64)
    classes = 64 * lanes
    at, first = 0, 0
    while first < len(n):
        last = first + max(1, int(np.searchsorted(np.cumsum(n[first:]), 1 << 18)))
        some = n[first:last]
        names = shingles[at : at + int(some.sum())]
        place = np.repeat(np.arange(len(some)) * classes, some) + (names >> U64(32)).astype(np.int64) % classes
        odd = np.bincount(place, minlength=len(some) * classes).reshape(len(some), classes) & 1
        out[first:last] = np.packbits(odd.astype(np.uint8), axis=1).view(np.uint64)
        at, first = at + len(names), last
    return out
