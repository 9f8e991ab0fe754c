"""Exact top-k search of binary codes by incremental multi-index hashing.

Codes are cut into m segments of about log2(n) bits, each with its own index.
Round r looks up, for every query that isn't settled, segment values at
exactly r flipped bits: in all segments, or in as many as its kth verified
distance so far asks for.  Once all segments are searched to r - 1 bits and
the first a of them to r, every code within m * r + a - 1 bits has been seen,
for any other differs by r + 1 in those a and by r in the rest.  A query whose
kth verified distance is within that is settled.  A pair is verified once, at
the first of its nearest segments, within the lookup's join.

Equal codes are one entry, of which the k + 1 smallest ids are kept, and
equal queries are one search, so copies cost nothing.  A segment grows with
the table (up to 32 bits, so to four billion codes), so a bucket doesn't; a
value that very many codes share is split by Spark at run time (adaptive skew
join), as probes and index meet in a sort-merge join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.shared import SALTS, drop, quoted, written

BITS = 64


@dataclass(frozen=True)
class Segments:
    """Where each segment begins, and its length."""

    starts: tuple[int, ...]
    lengths: tuple[int, ...]

    @classmethod
    def of(cls, n_codes: int) -> Segments:
        width = min(32, max(4, math.floor(math.log2(max(2, n_codes)))))
        m = math.ceil(BITS / width)
        lengths = [BITS // m + (i < BITS % m) for i in range(m)]
        return cls(tuple(sum(lengths[:i]) for i in range(m)), tuple(lengths))

    def value(self, code: Column, j: int) -> Column:
        return F.shiftrightunsigned(code, self.starts[j]).bitwiseAND(F.lit((1 << self.lengths[j]) - 1).cast("bigint"))

    def key(self, value: Column, j: int) -> Column:
        return value.bitwiseOR(F.lit(j << 32).cast("bigint"))


def sign_codes(df: DataFrame, vector: str, out: str = "code") -> DataFrame:
    """df with a 64-bit code: bit i is set where the vector's element i is above 0.

    Elements beyond 64 have no bit; missing and null elements count as 0.  A
    null vector has a null code.
    """
    v = quoted(vector)
    bits = F.transform(F.slice(v, 1, BITS), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return df.withColumn(out, F.when(v.isNotNull(), F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))))


def _smallest_ids(items: DataFrame, k: int) -> DataFrame:
    """The k smallest ids of each code, first within salts so that a hot code is split."""
    salted = items.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    first = salted.withColumn("_n", F.row_number().over(W.partitionBy("code", "_salt").orderBy("id"))).where(F.col("_n") <= k)
    return first.withColumn("_n", F.row_number().over(W.partitionBy("code").orderBy("id"))).where(F.col("_n") <= k).select("code", "id")


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """Each query's k nearest codes; of equal distances those with the smallest first id."""
    order = W.partitionBy("q").orderBy("distance", "first")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def _probes(open_queries: DataFrame, parts: Segments, r: int) -> DataFrame:
    """(q, reach, k, j): the keys at exactly r flipped bits of the first ``searched`` segments of each query."""
    out = None
    for length in sorted(set(parts.lengths)):
        if r > length:
            continue
        flips = [sum(1 << b for b in c) for c in combinations(range(length), r)]
        mine = [j for j, n in enumerate(parts.lengths) if n == length]
        values = F.explode(F.array(*[F.struct(parts.value(F.col("q"), j).alias("v"), F.lit(j).alias("j")) for j in mine]))
        masks = F.split(F.lit(",".join(map(str, flips))), ",").cast("array<bigint>")  # folded to one constant
        x = open_queries.select("q", "reach", "searched", values.alias("s")).where("s.j < searched").select("q", "reach", "s", F.explode(masks).alias("f"))
        key = F.col("s.v").bitwiseXOR(F.col("f")).bitwiseOR(F.shiftleft(F.col("s.j").cast("bigint"), 32))
        x = x.select("q", "reach", key.alias("k"), F.col("s.j").alias("j"))
        out = x if out is None else out.union(x)
    return out


def _home(parts: Segments, x: Column) -> Column:
    """Struct (r, j): the least segment distance of a pair and the first segment that has it."""
    each = [F.struct(F.bit_count(parts.value(x, j)).alias("r"), F.lit(j).alias("j")) for j in range(len(parts.starts))]
    return F.least(*each) if len(each) > 1 else each[0]


def search(items: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, id, distance): each query's k nearest items by Hamming distance.

    Both inputs have columns (id, code).  Ties go to the smaller id; an item
    with the query's own id is left out.  Rows with a null id or code are
    neither found nor queries; repeated rows count once.  Where there are
    fewer than k other items a query has as many rows as there are; an empty
    table gives an empty table.
    """
    items = items.where("id IS NOT NULL AND code IS NOT NULL").select("id", "code").distinct()
    queries = written(queries.where("id IS NOT NULL AND code IS NOT NULL").select(F.col("id").alias("query_id"), F.col("code").alias("q")).distinct())
    ids = written(_smallest_ids(items, k + 1))
    codes = written(ids.groupBy("code").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    n_codes = codes.count()
    parts = Segments.of(n_codes)
    index = written(codes.select(F.explode(F.array(*[parts.key(parts.value(F.col("code"), j), j) for j in range(len(parts.starts))])).alias("k"), "code", "first", "n"))
    m = len(parts.starts)
    open_queries = written(queries.select("q").distinct().select("q", F.lit(BITS).alias("reach"), F.lit(m).alias("searched")))
    best = None
    for r in range(max(parts.lengths) + 1):
        if open_queries.isEmpty():
            break
        x = F.col("q").bitwiseXOR(F.col("code"))
        home = _home(parts, x)
        here = (home["r"] == r) & (home["j"] == F.col("j")) & (F.bit_count(x) <= F.col("reach"))
        # what a few queries probe for is much more than they are: Spark must not take it for small
        probes = _probes(open_queries, parts, r).withColumnRenamed("k", "probe").hint("merge")
        met = probes.join(index.hint("merge"), (F.col("probe") == F.col("k")) & here)
        met = met.select("q", "code", "first", "n", F.bit_count(x).alias("distance"))
        now = written(_nearest(met if best is None else best.unionByName(met), k + 1))
        if best is not None:
            drop(best)
        best = now
        # the kth verified distance: the item that is left out may be the query itself
        so_far = F.sum("n").over(W.partitionBy("q").orderBy("distance", "first").rowsBetween(W.unboundedPreceding, 0))
        kth = best.withColumn("_c", so_far).where(F.col("_c") > k).groupBy("q").agg(F.min("distance").alias("kth"))
        left = open_queries.join(kth, "q", "left").where(F.col("kth").isNull() | (F.col("kth") > m * r + F.col("searched") - 1))
        left = left.select("q", F.coalesce("kth", F.lit(BITS)).alias("reach"))
        left = written(left.withColumn("searched", F.least(F.lit(m), F.col("reach") - m * (r + 1) + 1)))
        drop(open_queries)
        open_queries = left
    if best is None:
        return queries.select("query_id", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("id"), F.lit(0).alias("distance")).limit(0)
    named = best.select("q", "code", "distance").join(ids, "code")
    ranked = W.partitionBy("q").orderBy("distance", "id")
    named = written(named.withColumn("_n", F.row_number().over(ranked)).where(F.col("_n") <= k + 1).drop("_n"))
    out = queries.join(named, "q").where("query_id <> id")
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "q").orderBy("distance", "id"))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "id", "distance")
