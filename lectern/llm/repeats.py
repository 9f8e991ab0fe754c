"""Removal of repeated passages by distributed prefix doubling.

The suffix starts are the sparse but complete set of repeat_kernel: each
window of ``window`` bytes designates one of them, so the verdict on a window
is found at its designated start.  Spark sorts ranks and positions, new ranks
are taken from the sorted order, and what is unique is settled:

1. Starts are sorted by their gram (32 bytes); a gram's rank is its place.  A
   unique one settles all windows of its start.  So does a stretch of windows
   that equals an earlier one's as a whole: all of them repeat.
2. Open starts are sorted by the pair (rank of the gram at the start, gram at
   an offset of 32 bytes): to the right of it for windows that begin at most
   36 bytes before the start, to its left for the others.  A pair's rank is
   its place and stands for 64 bytes.  Unique ones are settled.
3. Windows that begin in one of these groups are ranked by doubling their
   prefixes, 8, 16, 32 and 64 bytes, pairs (rank at i, rank at i + offset)
   being sorted each time, and last by the pair at an offset of 36, which
   is past the threshold: the first position of each rank stays, every other
   window repeats.  Ranks are exact, as the first are the bytes themselves.

Large groups of round 2 aren't gathered: their windows are sorted by Spark
under 128-bit names of their bytes.  Grams that a share of all documents hold
(found in a bounded sample, which decides nothing but the route) don't meet
under their rank at all: in round 1 their stretches are dealt by their whole
bytes, in round 2 they meet by the names of both grams, and only pairs that
are large themselves (found likewise) are dealt evenly, as windows.  Before
each exchange a task keeps only its first of equal entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lectern.llm import repeat_kernel as kernel
from lectern.llm.ngrams import raw_texts
from lectern.llm.shared import map_arrow, others, quoted, schema_of, written

#: Entries that a task holds before it combines and sends them.
HELD = 1 << 19
#: Largest group of round 2 that is ranked where it is.
GROUP = 20_000
#: Marks what belongs to a hot gram, above any position.
HOT = 1 << 50
NULL_ID = -(1 << 63)


@dataclass(frozen=True)
class Params:
    """A gram is hot if so large a share of the sampled documents hold it, and ``hot_least`` of them.

    By default the share is a quarter of a task's part of all documents, so
    no gram's entries are much of a task's, at any size.  A document has
    about 3 designated grams in 100 bytes, so the hot grams are at most its
    average number over the share, however large the corpus.  The sample has
    as many documents as make ``hot_least`` of the share, at most ``sample``.
    """

    window: int = 100
    gram: int = 32
    hot_share: float | None = None
    hot_least: int = 64
    sample: int = 1_000_000

    @property
    def reach(self) -> int:
        return self.window - self.gram

    @property
    def offset(self) -> int:
        """Of round 2's second gram: no window has room for less than one of its two sides."""
        return min(self.gram, (self.reach + 1) // 2)

    def share(self, tasks: int) -> float:
        return min(0.02, 1 / (4 * tasks)) if self.hot_share is None else self.hot_share


def _concat(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _batch(names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c, np.int64)) for c in columns], names=names)


def merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges [lo, hi] joined where they touch or overlap within a document."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    begins = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    group = np.cumsum(np.concatenate(([0], (doc[1:] != doc[:-1]).astype(np.int64))))
    reach = hi.copy()
    for a, b in zip(begins, np.append(begins[1:], len(doc)), strict=True) if (lo[1:] < hi[:-1]).any() else []:
        reach[a:b] = np.maximum.accumulate(hi[a:b])
    new = np.concatenate(([True], (group[1:] != group[:-1]) | (lo[1:] > reach[:-1] + 1)))
    at = np.flatnonzero(new)
    return doc[at], lo[at], np.maximum.reduceat(hi, at)


def _spread(doc: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Keys that deal settled ranges evenly over the partitions."""
    return kernel.mix(doc.view(np.uint64) * np.uint64(3) + lo.view(np.uint64)).view(np.int64)


# --- round 1 --------------------------------------------------------------

ROUND1 = ["k", "f", "doc", "lo", "ext"]


def _grams(p: Params, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The name of every designated gram, once a document."""
    for batch in batches:
        texts = list(raw_texts(batch.column(1)))
        for part in kernel.pieces([len(t) for t in texts], p.window):
            data = np.concatenate([texts[i][a:b] for i, a, b in part])
            d, _, _, at = kernel.designated(data, np.cumsum([b - a for _, a, b in part]), p.window, p.gram)
            if len(d):
                k = kernel.Names(data, 0).at(at, at + p.gram).view(np.int64)
                yield _batch(["k"], [np.unique(np.stack((d, k)), axis=1)[1]])


def hot_grams(keyed: DataFrame, p: Params) -> np.ndarray:
    """Names of the grams that a share of the documents hold, from a bounded sample drawn by hash."""
    share = p.share(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    most = min(p.sample, max(20_000, int(p.hot_least / share))) if share else p.sample
    n = keyed.count()
    place = F.pmod(F.xxhash64("_key", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    drawn = keyed.select("_key", "_body") if n <= most else keyed.select("_key", "_body").where(place < most / n)
    counts = drawn.mapInArrow(lambda b: _grams(p, b), "k bigint").groupBy("k").agg(F.count("*").alias("n"))
    least = max(p.hot_least, int(share * min(n, most)))
    return np.sort(np.array([r.k for r in counts.where(F.col("n") >= least).collect()], np.int64))


def _starts(p: Params, hot: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram's name, stretch's name, document, first window, extent) of every designated start.

    ``ext`` packs the last window and the start itself, both counted from
    ``lo``, and whether the gram is hot; in a settled range it is -1 minus the
    last window.  A hot gram's stretches are keyed by their whole names.
    """
    held: list[list[np.ndarray]] = [[] for _ in ROUND1]
    size = 0

    def combined() -> Iterator[pa.RecordBatch]:
        k, f, doc, lo, ext = (_concat(x) for x in held)
        for x in held:
            x.clear()
        if not len(k):
            return
        order = np.lexsort((lo, doc, f, k))
        k, f, doc, lo, ext = k[order], f[order], doc[order], lo[order], ext[order]
        first = np.concatenate(([True], (k[1:] != k[:-1]) | (f[1:] != f[:-1])))
        # the same position twice (a repeated row) is no repeat
        at = np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))
        repeat = ~first & ((doc != doc[at]) | (lo != lo[at]))
        yield _batch(ROUND1, [x[first] for x in (k, f, doc, lo, ext)])
        d, a, b = merged(doc[repeat], lo[repeat], lo[repeat] + (ext[repeat] & 0xFFFF))
        if len(d):
            yield _batch(ROUND1, [_spread(d, a), np.zeros(len(d)), d, a, -1 - (b - a)])

    for batch in batches:
        ids = batch.column(0).to_numpy()
        texts = list(raw_texts(batch.column(1)))
        for part in kernel.pieces([len(t) for t in texts], p.window):
            data = np.concatenate([texts[i][a:b] for i, a, b in part])
            ends = np.cumsum([b - a for _, a, b in part])
            d, lo, hi, at = kernel.designated(data, ends, p.window, p.gram)
            if not len(d):
                continue
            base = np.array([a for _, a, _ in part]) - np.concatenate(([0], ends[:-1]))
            k = kernel.Names(data, 0).at(at, at + p.gram).view(np.int64)
            f = kernel.Names(data, 1).at(lo, hi + p.window).view(np.int64)
            many = np.isin(k, hot)
            k[many] = kernel.mix((k[many] ^ f[many]).view(np.uint64)).view(np.int64)
            held[0].append(k)
            held[1].append(f)
            held[2].append(ids[[i for i, _, _ in part]][d])
            held[3].append(lo + base[d])
            held[4].append((hi - lo) | (at - lo) << 16 | np.where(many, HOT, 0))
            size += len(d)
            if size >= HELD:
                yield from combined()
                size = 0
    yield from combined()


RANGES = ["doc", "lo", "hi", "at", "rank"]


def _rank_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settled ranges (at = -1) and open stretches (at = designated start, marked if hot) from sorted starts.

    An open stretch has its gram's rank: its place among the partition's grams.
    """
    context = TaskContext.get()
    rank = (context.partitionId() if context else 0) << 40
    last_k = last_f = last_doc = last_lo = None
    pending = None  # the first stretch of the current gram, until another one shows up

    for batch in batches:
        k, f, doc, lo, ext = (batch.column(i).to_numpy() for i in range(5))
        out = [[], [], [], [], []]
        done = ext < 0
        if done.any():
            for held, x in zip(out, (doc[done], lo[done], lo[done] - 1 - ext[done], np.full(done.sum(), -1), np.zeros(done.sum(), np.int64)), strict=True):
                held.append(x)
            k, f, doc, lo, ext = (x[~done] for x in (k, f, doc, lo, ext))
        if len(k):
            new_k = np.concatenate(([k[0] != last_k], k[1:] != k[:-1]))
            new_f = new_k | np.concatenate(([f[0] != last_f], f[1:] != f[:-1]))
            ranks = rank + np.cumsum(new_k)
            rank = int(ranks[-1])
            hi, at = lo + (ext & 0xFFFF), lo + (ext >> 16 & 0xFFFF) + (ext & HOT)
            # the position that a repeat is compared with: the first of its stretch
            where = np.maximum.accumulate(np.where(new_f, np.arange(len(k)), -1))
            head_doc = np.where(where >= 0, doc[where], last_doc if last_doc is not None else 0)
            head_lo = np.where(where >= 0, lo[where], last_lo if last_lo is not None else 0)
            repeat = ~new_f & ((doc != head_doc) | (lo != head_lo))
            for held, x in zip(out, (doc[repeat], lo[repeat], hi[repeat], np.full(repeat.sum(), -1), np.zeros(repeat.sum(), np.int64)), strict=True):
                held.append(x)
            heads = np.flatnonzero(new_f)
            if len(heads):
                if pending is not None and not new_k[heads[0]]:
                    for held, x in zip(out, pending, strict=True):
                        held.append(np.array([x]))
                follows = np.append(~new_k[heads[1:]], False)  # another stretch of this gram comes next
                open_ = ~new_k[heads] | follows | (ext[heads] >= HOT)
                for held, x in zip(out, (doc, lo, hi, at, ranks), strict=True):
                    held.append(x[heads[open_]])
                h = heads[-1]
                if new_k[h] and not open_[-1]:
                    pending = (doc[h], lo[h], hi[h], at[h], ranks[h])
                else:
                    pending = None
                last_doc, last_lo = doc[h], lo[h]
            last_k, last_f = k[-1], f[-1]
        if any(out):
            yield _batch(RANGES, [_concat(x) for x in out])


# --- rounds 2 and 3 -------------------------------------------------------

HALVES = ["k", "n", "doc", "lo", "hi"]


def _pair_names(k: np.ndarray, gram: np.ndarray) -> np.ndarray:
    return kernel.mix(k.view(np.uint64) ^ kernel.mix(gram.view(np.uint64))).view(np.int64)


def large_pairs(bare: DataFrame, ranked: DataFrame, p: Params) -> np.ndarray:
    """Names of the pairs of hot grams with more halves than one task should gather, from a sample drawn by hash.

    That is ``GROUP`` halves, or a task's part of all open stretches if that
    is less.  The sample has as many documents as make ``hot_least`` of them,
    so what is found is at most the larger of the tasks and of the halves
    over ``GROUP``, but for a factor below 2.
    """
    tasks = int(bare.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(1, p.hot_least, min(GROUP, ranked.where("at >= 0").count() // tasks))
    drawn = lambda key: F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 30)) < int(max(1, p.hot_least) / most * (1 << 30))
    some = _with_open(bare.where(drawn("_key")), ranked.where(f"at >= {HOT}").where(drawn("doc")))
    halves = some.mapInArrow(lambda b: _open_stretches(p, b), ", ".join(f"`{n}` bigint" for n in HALVES) + ", raw binary")
    found = halves.groupBy("k", "n").agg(F.count("*").alias("c")).where(F.col("c") >= p.hot_least).collect()
    return np.sort(_pair_names(np.array([r.k for r in found], np.int64), np.array([r.n for r in found], np.int64)))


def _with_open(keyed: DataFrame, stretches: DataFrame) -> DataFrame:
    """keyed's documents that have some of the stretches, which _open lists."""
    listed = stretches.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi", "at", "rank")).alias("_open"))
    return keyed.join(listed.hint("shuffle_hash"), F.col("_key") == F.col("doc")).select(*keyed.columns, "_open")


def _open_stretches(p: Params, batches: Iterator[pa.RecordBatch], key: int = 0, text: int = 1, large: np.ndarray = np.empty(0, np.int64)) -> Iterator[pa.RecordBatch]:
    """(rank at the start, gram at the offset, document, first window, last window, bytes) of the halves of open stretches.

    The rank is turned to below zero where the second gram lies to the left.
    A hot stretch has its gram's name in place of the rank; should it equal a
    rank, two groups are ranked as one.  Halves of ``large`` pairs (sorted
    names) are marked in ``hi`` and dealt evenly.
    """
    names = [*HALVES, "raw"]
    for batch in batches:
        ids = batch.column(key).to_numpy()
        listed = batch.column(batch.num_columns - 1)
        offsets, fields = listed.offsets.to_numpy(), listed.values
        lo_all, hi_all, at_all, rank_all = (fields.field(i).to_numpy() for i in range(4))
        out: list[list] = [[] for _ in names]
        size = 0
        for i, raw in enumerate(raw_texts(batch.column(text))):
            some = slice(offsets[i], offsets[i + 1])
            lo, hi, at, rank = lo_all[some], hi_all[some], at_all[some], rank_all[some]
            many, at = at >= HOT, at % HOT
            if many.any():
                rank = rank.copy()
                rank[many] = _names_at(raw, at[many], at[many] + p.gram)
            for a, b, second, k in (
                (np.maximum(lo, at - (p.reach - p.offset)), np.minimum(hi, at), at + p.offset, rank),
                (np.maximum(lo, at - p.reach), np.minimum(hi, at - (p.reach - p.offset) - 1), at - p.offset, -1 - rank),
            ):
                real = np.flatnonzero(a <= b)
                if not len(real):
                    continue
                # names of substrings of this document alone, whatever its length
                gram = _names_at(raw, second[real], second[real] + p.gram)
                dealt = many[real] & (len(large) > 0)
                if dealt.any():
                    pair = _pair_names(k[real], gram)
                    dealt &= large[np.minimum(np.searchsorted(large, pair), len(large) - 1)] == pair
                out[2].append(np.full(len(real), ids[i]))
                out[0].append(np.where(dealt, _spread(out[2][-1], a[real]), k[real]))
                out[1].append(gram)
                out[3].append(a[real])
                out[4].append(b[real] + np.where(dealt, HOT, 0))
                out[5] += [raw[x : y + p.window].tobytes() for x, y in zip(a[real], b[real], strict=True)]
                size += len(real)
            if size > 20_000:
                yield pa.RecordBatch.from_arrays([*[pa.array(_concat(x)) for x in out[:5]], pa.array(out[5], pa.binary())], names=names)
                out, size = [[] for _ in names], 0
        if size:
            yield pa.RecordBatch.from_arrays([*[pa.array(_concat(x)) for x in out[:5]], pa.array(out[5], pa.binary())], names=names)


def _names_at(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Names of substrings [start, end) of one text of any length, in bounded memory."""
    out = np.empty(len(start), np.int64)
    part = start // kernel.CHUNK
    for c in np.unique(part):
        own = part == c
        base = int(c) * kernel.CHUNK
        names = kernel.Names(raw[base : int(end[own].max())], 0)
        out[own] = names.at(start[own] - base, end[own] - base).view(np.int64)
    return out


WINDOWS = ["n1", "n2", "doc", "lo", "hi"]


def _windows(p: Params, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, raws: list[bytes], exact: bool):
    """(name, name, document, start) of every window of the stretches; an exact name is a rank, the second one 0."""
    data = np.frombuffer(b"".join(raws), np.uint8)
    n = hi - lo + 1
    begin = np.cumsum(np.concatenate(([0], (n + p.window - 1)[:-1])))
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(begin, n) + step
    if exact:
        n1 = kernel.doubled_ranks(data, p.window)[at]
        n2 = np.zeros(len(n1), np.int64)
    else:
        n1, n2 = (kernel.Names(data, w).at(at, at + p.window).view(np.int64) for w in (0, 1))
    return n1, n2, np.repeat(doc, n), np.repeat(lo, n) + step


def _rank_windows(n1, n2, doc, at):
    """Order by rank and position; which are the first of their rank, which repeat an earlier position."""
    order = np.lexsort((at, doc, n2, n1))
    n1, n2, doc, at = n1[order], n2[order], doc[order], at[order]
    first = np.concatenate(([True], (n1[1:] != n1[:-1]) | (n2[1:] != n2[:-1])))
    head = np.maximum.accumulate(np.where(first, np.arange(len(n1)), 0))
    repeat = ~first & ((doc != doc[head]) | (at != at[head]))
    return (n1, n2, doc, at), first, repeat


def _rank_stretches(p: Params, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeating windows of round 2's sorted groups; windows of large groups, to be sorted by themselves."""
    hot = None
    rank, last = 0, None  # of the current pair (rank, gram at the offset): its place

    def settle(k, doc, lo, hi, raws, whole: bool) -> Iterator[pa.RecordBatch]:
        """whole: the groups are complete, so the first of each rank is settled too."""
        if not len(k):
            return
        if whole:
            alone = np.concatenate(([True], k[1:] != k[:-1])) & np.concatenate((k[1:] != k[:-1], [True]))
            pick = np.flatnonzero(~alone)
            if not len(pick):
                return
            doc, lo, hi, raws = doc[pick], lo[pick], hi[pick], [raws[i] for i in pick]
        for at in range(0, len(doc), GROUP) if not whole else (0,):
            some = slice(at, at + GROUP) if not whole else slice(None)
            (n1, n2, d, w), first, repeat = _rank_windows(*_windows(p, doc[some], lo[some], hi[some], raws[some], whole))
            a, x, y = merged(d[repeat], w[repeat], w[repeat])
            if len(a):
                yield _batch(WINDOWS, [_spread(a, x), np.zeros(len(a)), a, x, y])
            if not whole:
                yield _batch(WINDOWS, [n1[first], n2[first], d[first], w[first], np.full(first.sum(), -1)])

    parts: list[tuple] = []
    size = 0
    for batch in batches:
        k, n, doc, lo, hi = (batch.column(i).to_numpy() for i in range(5))
        raws = batch.column(5).to_pylist()
        if not len(k):
            continue
        new = np.concatenate(([last != (k[0], n[0])], (k[1:] != k[:-1]) | (n[1:] != n[:-1])))
        last, k = (k[-1], n[-1]), rank + np.cumsum(new)
        rank = int(k[-1])
        many = hi >= HOT
        if many.any():
            yield from settle(k[many], doc[many], lo[many], hi[many] - HOT, [r for r, m in zip(raws, many, strict=True) if m], False)
            k, doc, lo, hi, raws = k[~many], doc[~many], lo[~many], hi[~many], [r for r, m in zip(raws, many, strict=True) if not m]
        if not len(k):
            continue
        cut = int(np.searchsorted(k, k[-1]))
        ready, rest = slice(0, cut), slice(cut, None)
        if cut == 0 and parts and parts[-1][0][-1] == k[0] or hot is not None and k[0] == k[-1] == hot:
            parts.append((k, doc, lo, hi, raws))
            size += len(k)
        else:
            parts.append((k[ready], doc[ready], lo[ready], hi[ready], raws[ready]))
            yield from settle(*(_concat([x[i] for x in parts]) for i in range(4)), [r for x in parts for r in x[4]], hot is None) if hot is None else _settle_after_hot(settle, parts, hot)
            hot = None
            parts = [(k[rest], doc[rest], lo[rest], hi[rest], raws[rest])]
            size = len(k) - cut
        if size > GROUP:  # one group only: what is held begins with it, and it goes on
            hot = parts[-1][0][-1]
            yield from settle(*(_concat([x[i] for x in parts]) for i in range(4)), [r for x in parts for r in x[4]], False)
            parts, size = [], 0
    if parts:
        yield from settle(*(_concat([x[i] for x in parts]) for i in range(4)), [r for x in parts for r in x[4]], True) if hot is None else _settle_after_hot(settle, parts, hot)


def _settle_after_hot(settle, parts: list[tuple], hot: int) -> Iterator[pa.RecordBatch]:
    """The rest of a large group first, then the complete groups behind it."""
    k, doc, lo, hi = (_concat([x[i] for x in parts]) for i in range(4))
    raws = [r for x in parts for r in x[4]]
    n = int(np.searchsorted(k, hot, side="right")) if len(k) and k[0] == hot else 0
    yield from settle(k[:n], doc[:n], lo[:n], hi[:n], raws[:n], False)
    yield from settle(k[n:], doc[n:], lo[n:], hi[n:], raws[n:], True)


def _rank_hot_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats among single windows that come sorted by rank and position; settled ranges pass."""
    head = None  # (n1, n2, doc, at) of the current rank's first window
    for batch in batches:
        n1, n2, doc, lo, hi = (batch.column(i).to_numpy() for i in range(5))
        done = hi >= 0
        out = [[doc[done]], [lo[done]], [hi[done]]]
        n1, n2, doc, lo = (x[~done] for x in (n1, n2, doc, lo))
        if len(n1):
            if head is not None:
                n1, n2, doc, lo = (np.concatenate(([h], x)) for h, x in zip(head, (n1, n2, doc, lo), strict=True))
            first = np.concatenate(([True], (n1[1:] != n1[:-1]) | (n2[1:] != n2[:-1])))
            at = np.maximum.accumulate(np.where(first, np.arange(len(n1)), 0))
            repeat = ~first & ((doc != doc[at]) | (lo != lo[at]))
            for held, x in zip(out, (doc[repeat], lo[repeat], lo[repeat]), strict=True):
                held.append(x)
            h = at[-1]
            head = (n1[h], n2[h], doc[h], lo[h])
        yield _batch(RANGES[:3], [_concat(x) for x in out])


# --- the operator ---------------------------------------------------------

def _keyed(df: DataFrame, text: str, doc_id: str, key: str) -> DataFrame:
    """df with a bigint key in the order of ids, null first, that tells the texts under one id apart.

    It is the id itself where ids are integers and none repeats.  Else (id,
    SHA-256 of the text) is sorted and numbered by place, so any ids and any
    number of texts under one of them have keys of their own.
    """
    ident = quoted(doc_id)
    if isinstance(df.schema[doc_id].dataType, IntegralType):
        plain = F.coalesce(ident.cast("bigint"), F.lit(NULL_ID))
        if df.groupBy(plain.alias("i")).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return df.withColumn(key, plain)
    mark = F.sha2(F.coalesce(quoted(text), F.lit("")), 256)
    names = df.select(ident.alias("_i"), mark.alias("_m")).distinct()
    # numbers grow with the partition and the place in it, and partitions are ranges
    order = written(names.repartitionByRange("_i", "_m").sortWithinPartitions("_i", "_m").withColumn("_k", F.monotonically_increasing_id()))
    held = order.select(F.col("_i").alias("_id"), F.col("_m").alias("_mark"), F.col("_k").alias(key))
    return df.join(held, ident.eqNullSafe(F.col("_id")) & (mark == F.col("_mark"))).drop("_id", "_mark")


def repeated_ranges(keyed: DataFrame, p: Params, text: str) -> DataFrame:
    """(doc, lo, hi): window starts lo to hi of document ``doc`` repeat earlier windows.

    ``keyed`` has a bigint _key.  Round 2 carries all its columns, so that
    its shuffle of the texts is the one that the result needs as well.
    """
    longs = lambda names: ", ".join(f"`{n}` bigint" for n in names)
    bare = keyed.select("_key", F.col(text).alias("_body"))
    hot = hot_grams(bare, p)
    starts = bare.mapInArrow(lambda b: _starts(p, hot, b), longs(ROUND1))
    ranked = starts.repartition("k").sortWithinPartitions("k", "f", "doc", "lo").mapInArrow(_rank_grams, longs(RANGES))
    ranked = written(ranked)
    large = large_pairs(bare, ranked, p) if len(hot) else hot
    some = _with_open(keyed, ranked.where("at >= 0"))
    places = keyed.columns.index("_key"), keyed.columns.index(text)
    halves = some.mapInArrow(lambda b: _open_stretches(p, b, *places, large), longs(HALVES) + ", raw binary")
    windows = halves.repartition("k", "n").sortWithinPartitions("k", "n", "doc", "lo").mapInArrow(lambda b: _rank_stretches(p, b), longs(WINDOWS))
    late = windows.repartition("n1").sortWithinPartitions("n1", "n2", "doc", "lo").mapInArrow(_rank_hot_windows, longs(RANGES[:3]))
    return ranked.where("at < 0").select("doc", "lo", "hi").union(late)


def remove(df: DataFrame, params: Params | None = None, text: str = "text", doc_id: str = "doc_id", digests: bool = False) -> DataFrame:
    """df with the bytes covered by repeated windows removed from its texts.

    Adds n_bytes, n_removed, n_spans (maximal removed runs) and kept, the
    remaining bytes joined, as binary; with ``digests`` kept_sha256 instead,
    and the text stays behind.  A window repeats if the same bytes also start
    at a smaller id, or earlier in the same document.  A null text counts as
    empty, a null id as smaller than any other.  Rows that repeat both id and
    text are one document: each gets its result.  Different texts under one
    id come in the order of their SHA-256; ids may be of any type that has an
    order.  An empty table gives an empty table; columns named like an output
    are replaced.
    """
    p = params or Params()
    if not 4 <= p.gram <= p.window:
        raise ValueError("a gram has at least 4 bytes and at most a window's")
    last = "kept_sha256" if digests else "kept"
    made = {"n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", last: "string" if digests else "binary"}
    keep = others(df, *made, *([text] if digests else []))
    # columns go by number meanwhile, so none can clash with what the rounds add
    rest_of = others(df, *made, text)
    numbered = [quoted(c).alias(f"c{i}") for i, c in enumerate(rest_of)]
    keyed = _keyed(df.select(*numbered, quoted(doc_id).alias("_doc"), quoted(text).alias("_text")), "_text", "_doc", "_key").drop("_doc")
    ranges = repeated_ranges(keyed, p, "_text")
    listed = ranges.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("_ranges"))
    joined = keyed.join(listed.hint("shuffle_hash"), F.col("_key") == F.col("doc"), "left")
    joined = joined.select(*[f"c{i}" for i in range(len(rest_of))], "_ranges", "_text")
    own = [c for c in keep if c not in rest_of]  # the text, unless only digests are asked for
    window = p.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(rest_of)
            listed = batch.column(n)
            offsets, values = listed.offsets.to_numpy(), listed.values
            lo_all, hi_all = values.field(0).to_numpy(), values.field(1).to_numpy()
            out: list[list] = [[] for _ in made]
            for i, raw in enumerate(raw_texts(batch.column(n + 1))):
                lo, hi = lo_all[offsets[i] : offsets[i + 1]], hi_all[offsets[i] : offsets[i + 1]]
                rest, removed, spans = [], 0, 0
                if len(lo):
                    order = np.argsort(lo, kind="stable")
                    lo, end = lo[order], np.maximum.accumulate(hi[order] + window)
                    begins = np.concatenate(([True], lo[1:] > end[:-1]))
                    a, b = lo[begins], end[np.append(np.flatnonzero(begins)[1:] - 1, len(end) - 1)]
                    removed, spans = int((b - a).sum()), len(a)
                    for x, y in zip(np.concatenate(([0], b)), np.append(a, len(raw)), strict=True):
                        rest.append(raw[x:y].tobytes())
                kept = b"".join(rest) if spans else raw.tobytes()
                row = (len(raw), removed, spans, hashlib.sha256(kept).hexdigest() if digests else kept)
                for held, x in zip(out, row, strict=True):
                    held.append(x)
            types = [pa.int64()] * 3 + [pa.string() if digests else pa.binary()]
            texts = [batch.column(n + 1)] * len(own)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *texts, *[pa.array(x, t) for x, t in zip(out, types, strict=True)]], names=[*rest_of, *own, *made])

    return map_arrow(joined, run, schema_of(df, [*rest_of, *own], made)).select(*[quoted(c) for c in [*keep, *made]])
