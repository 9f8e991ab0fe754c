"""SimHash near-duplicates by a byte-position inverted index.

Fingerprints of 64 bits that differ in at most 3 bits agree in at least 5 of
their 8 bytes, and so in at least 4 of any 7.  The index therefore has a
posting for each choice of 4 of the first 7 byte positions, with the bytes
there.  Within a posting the shared positional bytes of each pair are
tallied; pairs with fewer than 5 are filtered out, each remaining pair counts
only at the first posting that both share, and is verified by its Hamming
distance.  Equal fingerprints are one entry throughout, so copies make no
pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.components import components
from lectern.llm.ngrams import raw_texts
from lectern.llm.shared import drop, map_arrow, others, quoted, schema_of, survivors, unused, written

BITS = 3
POSITIONS = 7
CHOSEN = 4
#: Least number of equal bytes of linked fingerprints.
SHARED = 8 - BITS
#: Postings up to this length are paired with shifts of the whole batch.
SHORT = 64
#: Postings up to this length are paired where they are; longer ones are dealt anew by a fifth byte.
MEDIUM = 4096
CHOICES = [(sum(1 << p for p in c), c) for c in combinations(range(POSITIONS), CHOSEN)]


def _words(raw: bytes, block: int) -> Iterator[list[bytes]]:
    """A text's words, about ``block`` bytes at a time."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + block)
        while end < len(raw) and not raw[end : end + 1].isspace():  # no word is cut
            end += 1
        yield raw[at:end].lower().split()
        at = end


def fingerprint(raw: bytes, shingle: int = 3, seed: int = 42, block: int = 1 << 18) -> int:
    """Fingerprint of one text: majority of the bits of its shingles' hashes, repeats included.

    Blocks of a text are worked on one after another, so its words never are
    in memory all at once.
    """
    digest, total, n, held = xxhash.xxh64_digest, np.zeros(64, np.int64), 0, []
    for words in _words(raw, block):
        held += words
        if len(held) < shingle:
            continue
        text = b" ".join(held)
        lengths = np.fromiter(map(len, held), np.int64, len(held))
        ends = np.cumsum(lengths + 1) - 1
        pairs = zip((ends - lengths)[: len(held) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        hashes = np.frombuffer(b"".join([digest(text[a:b], seed) for a, b in pairs]), np.uint8).reshape(-1, 8)
        n += len(hashes)
        for at in range(0, len(hashes), 4096):
            total += np.unpackbits(hashes[at : at + 4096], axis=1).sum(0, dtype=np.int64)
        held = held[len(held) - shingle + 1 :]
    if not n:
        if not held:
            return 0
        n, total = 1, np.unpackbits(np.frombuffer(digest(b" ".join(held), seed), np.uint8)).astype(np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp", shingle: int = 3) -> DataFrame:
    """df without its text, with the fingerprint as a signed 64-bit integer.

    A text without words (null too) has fingerprint 0.
    """
    keep = others(df, text, out)
    base = df.select(*[quoted(c) for c in keep], quoted(text).alias(unused(df, "_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(raw.tobytes(), shingle) for raw in raw_texts(batch.column(batch.num_columns - 1))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], names=[*keep, out])

    return map_arrow(base, run, schema_of(df, keep, {out: "bigint"}))


def _close(a: np.ndarray, b: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which pairs belong to this posting: tally, first shared posting, verified distance."""
    x = a ^ b
    same = x.view(np.uint8).reshape(-1, 8) == 0
    head = same[:, :POSITIONS]
    first = head & (np.cumsum(head, axis=1) <= CHOSEN)
    home = (first * (1 << np.arange(POSITIONS))).sum(1)
    return (same.sum(1) >= SHARED) & (home == mask) & (np.bitwise_count(x) <= BITS)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of each of n nodes' component."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        now = label.copy()
        np.minimum.at(now, i, least)
        np.minimum.at(now, j, least)
        np.minimum.at(now, label[i], least)
        np.minimum.at(now, label[j], least)
        now = now[now]
        if (now == label).all():
            return label
        label = now


def _star_links(fps: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As many links as connect what the pairs connect: fewer than nodes."""
    root = _roots(len(fps), i, j)
    own = np.flatnonzero(root != np.arange(len(fps)))
    return fps[own], fps[root[own]]


def _pairs(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the distance, in blocks of rows."""
    left, right = [], []
    for at in range(0, len(fps), 256):
        near = np.bitwise_count(fps[at : at + 256, None] ^ fps[None, at:]) <= BITS
        i, j = np.nonzero(near)
        ahead = j > i
        left.append(i[ahead] + at)
        right.append(j[ahead] + at)
    return np.concatenate(left), np.concatenate(right)


def _flips(places: list[int]) -> np.ndarray:
    """All masks of 1 to 3 of these bits."""
    return np.array([sum(1 << p for p in c) for r in range(1, BITS + 1) for c in combinations(places, r)], np.uint64)


def _split_posting(part: np.ndarray, mask: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of entries that agree in a posting's four bytes and in byte q.

    They differ in 24 bits only, so they are at most 2**24.  Many of them
    aren't paired: each entry's 2,324 neighbours are looked up, so the work
    grows with the entries alone.
    """
    part = np.unique(part)
    if len(part) <= MEDIUM:
        return _star_links(part, *_pairs(part))
    left, right = [], []
    for flip in _flips([8 * p + b for p in range(8) if p != q and (p >= POSITIONS or not mask >> p & 1) for b in range(8)]):
        other = part ^ flip
        at = np.minimum(np.searchsorted(part, other), len(part) - 1)
        hit = np.flatnonzero((part[at] == other) & (other > part))
        left.append(hit)
        right.append(at[hit])
    return _star_links(part, np.concatenate(left), np.concatenate(right))


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("k", pa.int64())])


def _rows(a: np.ndarray, b: np.ndarray, k: np.ndarray | None = None) -> pa.RecordBatch:
    signed = lambda x: pa.array(x.view(np.int64))
    return pa.RecordBatch.from_arrays([signed(a), pa.nulls(len(a), pa.int64()) if k is not None else signed(b), pa.nulls(len(a), pa.int64()) if k is None else pa.array(k)], schema=LINKS)


def _link_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b, null) of postings (key, fp) that come sorted by key; entries (fp, null, key) of long ones.

    A posting may span batches; MEDIUM entries of it are held at most.
    """

    def links(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(begins, len(keys)))
        for at, n in zip(begins[sizes > SHORT], sizes[sizes > SHORT], strict=True):
            if n > MEDIUM:
                yield _rows(fps[at : at + n], None, keys[at : at + n])
            else:
                part = np.unique(fps[at : at + n])
                yield _rows(*_star_links(part, *_pairs(part)))
        small = np.repeat(sizes <= SHORT, sizes)
        k, x = keys[small], fps[small]
        for shift in range(1, int(sizes[sizes <= SHORT].max(initial=0))):
            i = np.flatnonzero(k[shift:] == k[:-shift])
            if not len(i):
                break
            ok = _close(x[i], x[i + shift], k[i] >> 32)
            yield _rows(x[i[ok]], x[i[ok] + shift])

    held = [np.empty(0, np.int64), np.empty(0, np.uint64)]
    known = None  # the key of a long posting that goes on
    for batch in batches:
        now = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)]
        if known is not None:
            n = int(np.searchsorted(now[0], known, side="right"))
            if n:
                yield _rows(now[1][:n], None, now[0][:n])
            if n == len(now[0]):
                continue
            now, known = [c[n:] for c in now], None
        held = [np.concatenate(c) for c in zip(held, now, strict=True)]
        if not len(held[0]):
            continue
        cut = int(np.searchsorted(held[0], held[0][-1]))
        if cut:
            yield from links(held[0][:cut], held[1][:cut])
        held = [c[cut:] for c in held]
        if len(held[0]) > MEDIUM:
            known = held[0][0]
            yield _rows(held[1], None, held[0])
            held = [c[:0] for c in held]
    if len(held[0]):
        yield from links(*held)


def _link_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b, null) of split postings (key, byte's place and value, fp) that come sorted by both."""
    held: list[list[np.ndarray]] = []

    def settle() -> Iterator[pa.RecordBatch]:
        k, v, x = (np.concatenate(c) for c in zip(*held, strict=True))
        begins = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (v[1:] != v[:-1]))))
        for at, end in zip(begins, np.append(begins[1:], len(k)), strict=True):
            yield _rows(*_split_posting(x[at:end], int(k[at]) >> 32, int(v[at]) >> 8))

    for batch in batches:
        k, v, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
        if not len(k):
            continue
        cut = int(np.flatnonzero((k == k[-1]) & (v == v[-1]))[0])  # sorted: the last one may go on
        if cut == 0 and held and held[-1][0][-1] == k[0] and held[-1][1][-1] == v[0]:
            held.append([k, v, x])
            continue
        held.append([k[:cut], v[:cut], x[:cut]])
        yield from settle()
        held = [[k[cut:], v[cut:], x[cut:]]]
    if held:
        yield from settle()


def link(distinct: DataFrame, fp: str = "fp") -> DataFrame:
    """(a, b) fingerprints whose links connect all that lie within 3 bits of each other.

    ``distinct`` has each fingerprint once.  Short postings give every linked
    pair once; a long one gives links that connect the same entries.
    """
    byte = lambda p: F.shiftrightunsigned(F.col(fp), 8 * p).bitwiseAND(F.lit(255).cast("bigint"))

    def key(mask: int, places: tuple[int, ...]):
        out = F.lit(mask << 32).cast("bigint")
        for i, p in enumerate(places):
            out = out.bitwiseOR(F.shiftleft(byte(p), 8 * i))
        return out

    postings = distinct.select(F.explode(F.array(*[key(m, c) for m, c in CHOICES])).alias("k"), F.col(fp).alias("fp"))
    found = written(postings.repartition("k").sortWithinPartitions("k").mapInArrow(_link_postings, "a bigint, b bigint, k bigint"))
    # linked entries of a posting agree in a byte more than its four: a long one is dealt by each other byte in turn
    mask = F.shiftright("k", 32)
    split = [F.when((mask.bitwiseAND(F.lit(1 << p)) == 0) if p < POSITIONS else F.lit(True), F.lit(p << 8).cast("bigint").bitwiseOR(byte(p))) for p in range(8)]
    long = found.where("k IS NOT NULL").select("k", F.col("a").alias(fp)).distinct()
    long = long.select("k", F.explode(F.array_compact(F.array(*split))).alias("v"), fp)
    more = long.repartition("k", "v").sortWithinPartitions("k", "v").mapInArrow(_link_splits, "a bigint, b bigint, k bigint")
    return found.where("k IS NULL").union(more).select("a", "b")


def cluster(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row of df.

    component_id is the smallest id that the row's fingerprint reaches over
    links, its own included.  Null ids are never the smallest; a component
    without any other id has a null component_id.  Repeated rows are repeated
    in the result; an empty table gives an empty table.
    """
    marked = written(fingerprints(df.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("_body")), "_body", "fp", shingle))
    firsts = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    with_root = written(_rooted(firsts))
    least = with_root.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(with_root.join(least, "root").select("fp", "component_id"))
    drop(firsts)
    drop(with_root)
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def _rooted(distinct: DataFrame) -> DataFrame:
    """distinct with the root of each fingerprint's component, the smallest that it reaches."""
    links = written(link(distinct))
    roots = written(components(links))
    drop(links)
    return distinct.join(roots, distinct.fp == roots.node, "left").select(*distinct.columns, F.coalesce("root", "fp").alias("root"))


def deduplicate(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3) -> DataFrame:
    """df's rows that are the first of their component of 3-bit links: one of each group (see survivors).

    neardup.deduplicate links by the similarity of 5-word shingles instead.
    """

    def clustered(rows: DataFrame) -> DataFrame:
        marked = written(fingerprints(rows, "_body", "fp", shingle))
        rooted = written(_rooted(written(marked.select("fp").distinct())))
        return marked.join(rooted, "fp").select("_id", "_row", F.col("root").alias("component"))

    return survivors(df, clustered, text, doc_id)
