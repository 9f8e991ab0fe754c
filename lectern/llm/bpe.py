"""Byte-level BPE encoding and decoding by overlapping chunks.

Every text is cut into chunks that overlap.  Each chunk is pre-tokenised on
its own.  The pre-tokeniser looks only forward from where a match begins, so
once the pre-tokens of two neighbouring chunks begin at one position they
agree from there on: that is where the chunks are stitched.  Where no position
of an overlap fits (one pre-token fills it), the chunks stay together.  The
pieces between stitches are encoded pre-token by pre-token and their ids
joined, which gives the ids of the whole text.  Decoding joins the raw bytes
of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lectern.llm.shared import map_arrow, others, quoted, schema_of

CHUNK = 1 << 10
OVERLAP = 1 << 6
#: Characters behind a match that may have decided it (a look-ahead, or a longer alternative that failed).
LOOK = 4
#: Pre-tokens whose ids a task remembers, and the longest of them.
REMEMBERED, SHORT = 1 << 18, 64


class _Ids(dict):
    """Ids by pre-token, merged when first met."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, token: str) -> tuple[int, ...]:
        found = tuple(merge(token.encode(), self.ranks))
        if len(token) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = found
        return found


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: of neighbours the lowest rank first, leftmost of equals; n log n for n bytes."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    after, before, width = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i]
        if not width[i] or j >= n or width[i] + width[j] != size:
            continue
        width[i], width[j] = size, 0
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(piece[i : k + width[k]])) is not None:
                heapq.heappush(heap, (r, i, size + width[k]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h : i + size])) is not None:
            heapq.heappush(heap, (r, h, width[h] + size))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : i + width[i]]])
        i = after[i]
    return out


class Codec:
    """Encoder and decoder for one rank file and one pre-token pattern, which has to match every character."""

    def __init__(self, ranks_file: bytes, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        if not LOOK < overlap < chunk:
            raise ValueError("overlap must be larger than the look-ahead and smaller than chunk")
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
        self.bytes_of = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.pattern = regex.compile(pattern)
        self.ids = _Ids(self.ranks)
        self.chunk, self.overlap = chunk, overlap

    def _tokens(self, text: str, start: int, end: int) -> list[str]:
        """Pre-tokens of text[start:end], as if nothing were around it."""
        out = self.pattern.findall(text, start, end)
        if sum(map(len, out)) != end - start:
            raise ValueError("the pattern leaves characters out")
        return out

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The text's pre-tokens, piece by piece, in order."""
        n = len(text)
        end = min(n, self.chunk)
        tokens = self._tokens(text, 0, end) if n else []
        start = 0
        while end < n:
            # where this chunk's pre-tokens begin in the overlap, of those that its end can't have changed
            marks, i, at = {}, len(tokens), end
            while i and at > end - self.overlap:
                i -= 1
                at -= len(tokens[i])
                if end - self.overlap <= at <= end - LOOK:
                    marks[at] = i
            ahead_start, ahead_end = end - self.overlap, min(n, end - self.overlap + self.chunk)
            ahead = self._tokens(text, ahead_start, ahead_end)
            j, at = 0, ahead_start
            while at not in marks and at <= end - LOOK:
                at += len(ahead[j])
                j += 1
            if at in marks:
                yield tokens[: marks[at]]
                tokens, start, end = ahead[j:], at, ahead_end
                continue
            # the chunks stay together: read on from the last sure position, twice as far
            i, at = len(tokens), end
            while at > end - LOOK and i:
                i -= 1
                at -= len(tokens[i])
            yield tokens[:i]
            start, end = at, min(n, at + 2 * (end - at) + self.chunk)
            tokens = self._tokens(text, start, end)
        if tokens:
            yield tokens

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        ids = self.ids.__getitem__
        for piece in self.pieces(text):
            out.extend(chain.from_iterable(map(ids, piece)))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def _codec(ranks_file: bytes, pattern: str) -> Codec:
    return Codec(ranks_file, pattern)


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", digests: bool = False) -> DataFrame:
    """Add the ids of each text and the bytes that they decode to.

    Every input column stays as it is, but for columns already named like an
    output, which are replaced.  A null or empty text has no ids and decodes
    to no bytes; equal rows give equal rows; an empty table gives an empty
    table.  A text takes its ids' memory besides its own, whatever its length;
    a run of white space or letters is one pre-token, merged in n log n.  The
    rank file (under 2 MB, fixed by the vocabulary) is read by the driver and
    broadcast, so executors need no copy of it.

    With ``digests`` the columns are n_tokens, ids_sha256 (ids as
    little-endian unsigned 32-bit integers) and decoded_sha256 instead of the
    ids and bytes, which then never leave the worker.
    """
    with open(ranks_path, "rb") as f:
        held = df.sparkSession.sparkContext.broadcast(f.read())
    made = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"} if digests else {ids: "array<int>", decoded: "binary"}
    keep = others(df, *made, text)
    base = df.select(*[quoted(c) for c in keep], quoted(text))  # the text comes last
    n_keep = len(keep) + (not digests)
    names = [*base.columns[:n_keep], *made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held.value, pattern)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            out: list[list] = [[] for _ in made]
            for value in texts:
                found = codec.encode(value.as_py() or "")
                raw = codec.decode(found)
                if digests:
                    row = (len(found), hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest())
                else:
                    row = (np.array(found, "<i4"), raw)
                for held_column, x in zip(out, row, strict=True):
                    held_column.append(x)
            types = [pa.int64(), pa.string(), pa.string()] if digests else [pa.list_(pa.int32()), pa.binary()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], *[pa.array(x, t) for x, t in zip(out, types, strict=True)]], names=names)

    return map_arrow(base, run, schema_of(base, base.columns[:n_keep], made))
