"""Connected components by alternating stars, on written tables.

Each round replaces every node's neighbours by links to the smallest one
(first for larger neighbours, then for smaller), which halves path lengths
and ends with one star for each component.  Nothing but counts and checksums
comes to the driver; each round's table is in the shared folder, so an
executor may go at any time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import drop, written


def _star(links: DataFrame, smaller: bool) -> DataFrame:
    """One star step over (u, v) rows.

    A node with very many neighbours meets its one row of the smallest;
    Spark splits such a key at run time (adaptive skew join), so nothing is
    repeated for the others.
    """
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.where("v < u") if smaller else both
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    if smaller:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return written(out.where("u <> v").distinct())


def _sum(links: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(links.agg(F.count("*"), F.sum(F.shiftright(h, 20)), F.sum(h.bitwiseAND(F.lit((1 << 20) - 1)))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest of its component.

    ``links`` has two columns of one ordered type; repeated links, links both
    ways and links to oneself are allowed.
    """
    a, b = links.columns
    now = written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    seen = None
    while (state := _sum(now)) != seen:
        seen = state
        if not state[0]:
            break
        large = _star(now, smaller=False)
        small = _star(large, smaller=True)
        drop(now)
        drop(large)
        now = small
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
