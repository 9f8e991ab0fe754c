"""Near-duplicates by similarity: wide SimHashes met in a byte-position index.

simhash.py links fingerprints of 64 bits within 3 bits.  Texts whose 5-word
shingles have a Jaccard similarity of 0.8 lie much farther apart, about 15 of
100 bits, so no 64-bit radius both covers them and tells them from others.
Here a fingerprint has 48 bytes in eight groups of six positions.  The index
has a posting for each two positions of a group, with the bytes there: two
fingerprints with two equal bytes in one group share a posting.  At
similarity 0.8 bytes are equal with probability 0.27, and a pair is missed
with probability 0.003, less the more similar it is.

Equal sets of shingles are one entry throughout.  First a star is drawn
through each posting of three equal bytes; what its close pairs (by 128 bits)
connect is a family.  Then each posting of two equal bytes joins its families
by as many close pairs as connect what they connect.  A family holds near
copies, and texts alike that stay below the similarity; all similar pairs of
the index lie within one.  There every two sets are compared, in blocks of a
bounded size: their equal bytes are tallied, their differing bits counted,
and their sets' parities compared (1,024 classes of shingles, in no more of
which sets can differ than in shingles, so that no similar pair is lost by
it).  What is left is verified by the Jaccard similarity of the shingles
themselves, unless the block's links connect it already, so no link is false
and a large group of near copies makes few.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import shingle_kernel as kernel
from lectern.llm.components import components
from lectern.llm.expr import let
from lectern.llm.ngrams import raw_texts
from lectern.llm.simhash import _roots
from lectern.llm.shared import drop, schema_of, survivors, written

#: Fingerprint: 64-bit words, groups of byte positions, positions in a group.
WORDS, GROUPS, WIDTH = 6, 8, 6
#: 64-bit words of parities.
PARITIES = 16
#: What a set is compared by: its size, fingerprint and parities.
FIELDS = {"n": "bigint", "w": "array<bigint>", "p": "array<bigint>"}
#: Postings up to this length are paired with shifts of the whole batch.
SHORT = 16
#: Sets, and shingles, in a share of a family; a block has two shares.
SHARE, SHINGLES = 4096, 1 << 21
KEYS = [places for g in range(GROUPS) for places in combinations(range(g * WIDTH, (g + 1) * WIDTH), 2)]
#: Positions of the stars' postings.
STARS = [(p, p + 1, p + 2) for p in range(0, GROUPS * WIDTH, 3)]


@dataclass(frozen=True)
class Near:
    """``percent``: least Jaccard similarity of linked texts; the other limits follow from it."""

    shingle: int = 5
    percent: int = 80

    @property
    def differ(self) -> float:
        """Probability that a bit differs at that similarity: the angle between the sets over pi."""
        s = self.percent / 100
        return math.acos(2 * s / (1 + s)) / math.pi

    def bits(self, n: int) -> int:
        """Most of n bits that differ: 3.6 standard deviations above the mean."""
        return math.ceil(n * self.differ + 3.6 * math.sqrt(n * self.differ * (1 - self.differ)))

    @property
    def bytes(self) -> int:
        """Fewest equal bytes: 3 standard deviations below the mean, and the two of a posting."""
        n, p = GROUPS * WIDTH, (1 - self.differ) ** 8
        return max(2, math.floor(n * p - 3 * math.sqrt(n * p * (1 - p))))


def _marks(df: DataFrame, p: Near) -> DataFrame:
    """(_id, _row, set, n, w, p) of df's (_id, _row, _body): its set's name and size, its fingerprint and parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, size = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int64)
            bits, odd = np.zeros((batch.num_rows, WORDS), np.uint64), np.zeros((batch.num_rows, PARITIES), np.uint64)
            for first, flat, n in kernel.sets(list(raw_texts(batch.column(2))), p.shingle):
                some = slice(first, first + len(n))
                ends = np.cumsum(n)
                name[some] = [xxhash.xxh64_intdigest(flat[b - m : b].tobytes()) for b, m in zip(ends, n, strict=True)]
                size[some] = n
                bits[some] = kernel.simhash(flat, n, WORDS)
                odd[some] = kernel.parities(flat, n, PARITIES)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel().view(np.int64))) for x in (bits, odd)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(name.view(np.int64)), pa.array(size), *lists], names=["_id", "_row", "set", *FIELDS])

    return df.select("_id", "_row", "_body").mapInArrow(run, schema_of(df, ["_id", "_row"], {"set": "bigint"} | FIELDS))


def _postings(kinds: DataFrame, positions: list[tuple[int, ...]], *columns: str) -> DataFrame:
    """Entries under each of the positions, dealt by posting: which positions, and the bytes there."""
    chosen = F.array(*[F.array(*[F.lit(p) for p in places]) for places in positions])  # folded to one constant
    word = lambda p: F.get("w", F.floor(p / 8).cast("int"))
    every = F.transform(F.sequence(F.lit(0), F.lit(8 * WORDS - 1)), lambda p: F.call_function("shiftrightunsigned", word(p), 8 * (p % 8)).bitwiseAND(F.lit(255).cast("bigint")))
    key = lambda held, places, at: F.aggregate(places, at.cast("bigint"), lambda k, p: k * 256 + F.get(held, p))
    keys = let(every, lambda held: F.transform(chosen, lambda places, at: key(held, places, at)))
    return kinds.select(F.explode(keys).alias("k"), *columns).repartition("k")


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which rows of integers differ."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _sketches(batch: pa.RecordBatch) -> np.ndarray:
    """The last two columns of a batch as rows of two integers."""
    return np.stack([batch.column(c).to_numpy().view(np.uint64) for c in (-2, -1)], axis=1)


def _draw_stars(limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Close pairs (first entry, entry) of postings (k, set, x, y) that come sorted; one entry is held."""
    last = None
    for batch in batches:
        k, s, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _sketches(batch)
        if not len(k):
            continue
        if last is not None:
            k, s, x = (np.concatenate((v, c)) for v, c in zip(last, (k, s, x), strict=True))
        head = np.maximum.accumulate(np.where(np.concatenate(([True], k[1:] != k[:-1])), np.arange(len(k)), 0))
        h = head[-1:]
        last = (k[h], s[h], x[h])
        near = (head != np.arange(len(k))) & (_apart(x, x[head]) <= limit)
        yield pa.RecordBatch.from_arrays([pa.array(s[head[near]]), pa.array(s[near])], names=["a", "b"])


def _meet(limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (family, family) of postings (k, family, x, y) that come sorted by key: as many as connect what close pairs connect.

    The commonest family of a posting is compared with the others only.
    """

    def close(k: np.ndarray, family: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        begins = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        sizes = np.diff(np.append(begins, len(k)))
        left, right = [], []
        for at, n in zip(begins[sizes > SHORT], sizes[sizes > SHORT], strict=True):
            own, of = x[at : at + n], family[at : at + n]
            known, place, many = np.unique(of, return_inverse=True, return_counts=True)
            if len(known) == 1:
                continue
            main = place == many.argmax()
            rest = np.flatnonzero(~main)
            for row in range(0, len(rest), 128):
                some = rest[row : row + 128]
                p, q = np.nonzero((_apart(own[some, None], own[None]) <= limit) & (of[some, None] != of[None]))
                ahead = main[q] | (q > some[p])
                left.append(some[p[ahead]] + at)
                right.append(q[ahead] + at)
        small = np.flatnonzero(np.repeat(sizes <= SHORT, sizes))
        for shift in range(1, int(sizes[sizes <= SHORT].max(initial=0))):
            i, j = small[:-shift], small[shift:]
            same = k[i] == k[j]
            if not same.any():
                break
            i, j = i[same], j[same]
            near = (family[i] != family[j]) & (_apart(x[i], x[j]) <= limit)
            left.append(i[near])
            right.append(j[near])
        if left and any(map(len, left)):
            # one node a family: what they connect is all that counts
            known, place = np.unique(family, return_inverse=True)
            root = _roots(len(known), place[np.concatenate(left)], place[np.concatenate(right)])
            linked = np.flatnonzero(root != np.arange(len(known)))
            yield pa.RecordBatch.from_arrays([pa.array(known[root[linked]]), pa.array(known[linked])], names=["a", "b"])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), _sketches(batch)]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))  # sorted: the last posting may go on
        if cut == 0 and held and held[-1][0][-1] == now[0][0]:
            held.append(now)
            continue
        held.append([c[:cut] for c in now])
        yield from close(*(np.concatenate(c) for c in zip(*held, strict=True)))
        held = [[c[cut:] for c in now]]
    if held:
        yield from close(*(np.concatenate(c) for c in zip(*held, strict=True)))


def _shingles(df: DataFrame, kinds: DataFrame, needed: DataFrame, p: Near) -> DataFrame:
    """(set, h): the shingles of the needed sets, read from one text of each."""
    rows = kinds.join(needed, "set", "left_semi").select(F.col("_row").alias("r"))
    drawn = df.join(rows.hint("shuffle_hash"), F.col("_row") == F.col("r"), "left_semi").select("_body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, flat, n in kernel.sets(list(raw_texts(batch.column(0))), p.shingle):
                found = [flat[b - m : b].tobytes() for b, m in zip(np.cumsum(n), n, strict=True)]
                name = np.array([xxhash.xxh64_intdigest(h) for h in found], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(found, pa.binary())], names=["set", "h"])

    return written(drawn.mapInArrow(run, "set bigint, h binary").dropDuplicates(["set"]))


BLOCK = ["family", "block", "share", "set", "n", "w", "p", "h"]


def _link_blocks(near: Near, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links (a, b) of blocks that come sorted: as many as connect each block's similar sets."""
    limit = near.bits(64 * WORDS)
    held: list[pa.RecordBatch] = []

    def links(block: pa.Table) -> pa.RecordBatch:
        column = lambda c: block.column(c).combine_chunks()
        name, n, share = (column(c).to_numpy() for c in ("set", "n", "share"))
        w, p = (column(c).flatten().to_numpy().view(np.uint64).reshape(len(name), -1) for c in ("w", "p"))
        sets = [np.frombuffer(h.as_buffer(), np.uint64) for h in block.column("h")]
        two, label = share.min() != share.max(), np.arange(len(name))
        a, b = [], []
        for i in range(len(name) - 1):
            j = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
            if two:  # each share has a block of its own for its own pairs
                j = j[share[j] != share[i]]
            j = j[100 * np.minimum(n[j], n[i]) >= near.percent * np.maximum(n[j], n[i])]
            j = j[((w[j] ^ w[i]).view(np.uint8) == 0).sum(1) >= near.bytes]
            j = j[_apart(w[j], w[i]) <= limit]
            j = j[(100 + near.percent) * _apart(p[j], p[i]) <= (100 - near.percent) * (n[j] + n[i])]
            while len(j):
                both = len(np.intersect1d(sets[i], sets[j[0]], assume_unique=True))
                if 100 * both >= near.percent * (n[i] + n[j[0]] - both):
                    a.append(name[i])
                    b.append(name[j[0]])
                    label[label == label[j[0]]] = label[i]
                j = j[1:][label[j[1:]] != label[i]]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        begins = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(0))))
        if held and (held[-1].column(0)[0].as_py(), held[-1].column(1)[0].as_py()) != tuple(key[:, 0].tolist()):
            yield links(pa.Table.from_batches(held))
            held = []
        for at, end in zip(begins, begins[1:], strict=False):
            yield links(pa.Table.from_batches([*held, batch.slice(at, end - at)]))
            held = []
        held.append(batch.slice(begins[-1]))
    if held:
        yield links(pa.Table.from_batches(held))


def _family_links(df: DataFrame, kinds: DataFrame, families: DataFrame, p: Near) -> DataFrame:
    """Verified links within families (set, family): shares meet in blocks, each with itself and with each other."""
    members = families.join(kinds, "set")
    sizes = members.groupBy("family").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    shares = F.greatest(F.ceil(F.col("m") / SHARE), F.ceil(F.col("s") / SHINGLES)).cast("int")
    sizes = sizes.where("m > 1").select("family", shares.alias("shares"))
    held = _shingles(df, kinds, members.select("set"), p)
    dealt = members.join(sizes, "family").withColumn("share", F.pmod(F.xxhash64("set", F.lit(5)), F.col("shares")).cast("int"))
    block = F.transform(F.sequence(F.lit(0), F.col("shares") - 1), lambda u: F.least(u, F.col("share")) * F.col("shares") + F.greatest(u, F.col("share")))
    dealt = dealt.join(held, "set").withColumn("block", F.explode(block)).select(*BLOCK)
    found = dealt.repartition("family", "block").sortWithinPartitions("family", "block", "set").mapInArrow(lambda b: _link_blocks(p, b), "a bigint, b bigint")
    found = written(found)
    drop(held)
    return found


def cluster(df: DataFrame, near: Near | None = None) -> DataFrame:
    """(_id, _row, component) of df's (_id, _row, _body); texts without words are one component."""
    p = near or Near()
    limit, sketch = p.bits(128), (F.get("w", WORDS - 2).alias("x"), F.get("w", WORDS - 1).alias("y"))
    marks = written(_marks(df, p))
    kinds = written(marks.groupBy("set").agg(F.min("_row").alias("_row"), *[F.first(c).alias(c) for c in FIELDS]))
    rooted = lambda df, roots, out: df.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn(out, F.coalesce("root", "set")).drop("root")

    stars = _postings(kinds.select("*", *sketch), STARS, "set", "x", "y").sortWithinPartitions("k", "set")
    alike = written(stars.mapInArrow(lambda b: _draw_stars(limit, b), "a bigint, b bigint").distinct())
    families = written(components(alike))
    entries = rooted(kinds, families, "family").select("w", "family", *sketch)
    met = _postings(entries, KEYS, "family", "x", "y").sortWithinPartitions("k").mapInArrow(lambda b: _meet(limit, b), "a bigint, b bigint")
    whole = written(components(written(alike.union(met.distinct()))))
    links = _family_links(df, kinds, whole.select(F.col("node").alias("set"), F.col("root").alias("family")), p)
    out = rooted(marks.select("_id", "_row", "set"), written(components(links)), "component")
    for table in (alike, families, whole):
        drop(table)
    return out.select("_id", "_row", "component")


def deduplicate(df: DataFrame, near: Near | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """df's rows that are the first of their component (see survivors): one of each group of near-duplicates.

    Links are exact (Jaccard similarity of the sets of shingles, 64-bit
    names); of the pairs at the very threshold about 3 in 1,000 are missed,
    5 in 100 where the texts have fewer than ten shingles.  A null or empty
    text has no words; all such texts are one group.  Rows are told apart by
    id and content, null ids too.  A text takes about six times its bytes of
    memory.  An empty table gives an empty table.
    """
    return survivors(df, lambda rows: cluster(rows, near), text, doc_id)
