"""Hashed byte n-gram counts of whole texts (NumPy), and raw access to Arrow text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Longer texts are counted in parts of this many bytes, which overlap by an n-gram.
PART = 1 << 22


def raw_texts(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each value, without copies; a null has none."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    valid = np.ones(len(column), bool) if not column.null_count else np.asarray(column.is_valid())
    for i in range(len(column)):
        yield held[at[i] : at[i + 1]] if valid[i] else held[:0]


def letters_only() -> np.ndarray:
    """Byte map: letters lower-cased, bytes beyond ASCII as they are, all else a space."""
    table = np.full(256, 32, np.uint8)
    table[97:123] = table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


def shapes() -> np.ndarray:
    """Byte map: everything as it is, but for digits, which count as one."""
    table = np.arange(256, dtype=np.uint8)
    table[48:58] = 48
    return table


class Counter:
    """Counts of n-grams by hash bucket."""

    def __init__(self, buckets: int, order: int, table: np.ndarray, seed: int):
        if buckets & (buckets - 1):
            raise ValueError("buckets must be a power of two")
        self.buckets, self.order, self.table = buckets, order, table
        self.codes = np.random.default_rng(seed).integers(0, buckets, (order, 256)).astype(np.uint16)

    def __call__(self, text: np.ndarray) -> np.ndarray:
        """Counts of one text between two spaces; n-grams of spaces alone are left out."""
        out = np.zeros(self.buckets, np.int64)
        n = self.order
        for start in range(0, max(1, len(text)), PART):
            part = text[max(0, start - n + 1) : start + PART]
            head, tail = start == 0, start + PART >= len(text)
            x = np.empty(len(part) + head + tail, np.uint8)
            x[0] = x[-1] = 32
            x[int(head) : int(head) + len(part)] = self.table[part]
            if len(x) < n:
                continue
            h = self.codes[0][x[: len(x) - n + 1]]
            blank = x[: len(x) - n + 1] == 32
            for k in range(1, n):
                own = x[k : len(x) - n + 1 + k]
                h = h ^ self.codes[k][own]
                blank &= own == 32
            out += np.bincount(h[~blank], minlength=self.buckets)
        return out
