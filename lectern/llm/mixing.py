"""Mixing sources to target weights by Poisson replication (native).

Each source has a repetition rate: how often a document of it occurs in the
mixture on average.  A document draws its count by inverting the Poisson
distribution of that rate at a uniform number hashed from its id and text, so
any run, retry or cluster draws alike.  The copies are then shuffled globally by a
hashed key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.expr import let
from lectern.llm.shared import attach, others, quoted

#: A larger rate is drawn as a sum of equal parts, none above this.
PART = 16.0


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the MD5 of the parts: 52 bits, and a half."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("bigint")
    return (h.cast("double") + 0.5) / float(1 << 52)


def rates(df: DataFrame, weights: dict[str, float] | None, temperature: float, size: float, source: str) -> tuple[DataFrame, int]:
    """One row a source (_source, rate), and the number of sources.

    ``weights`` gives target shares by source (sources it lacks get none; they
    need not add up to 1); without it a source's share goes as its number of
    documents to the power ``temperature``.  ``size`` is the size of the
    mixture against the input.
    """
    counts = df.groupBy(_key(source).alias("_source")).agg(F.count("*").alias("n"))
    if weights is None:
        share = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        named = df.sparkSession.createDataFrame([("s:" + k, float(w)) for k, w in weights.items()], "_source string, w double")
        counts = counts.join(named, "_source", "left")
        share = F.coalesce(F.col("w"), F.lit(0.0))
    counts = counts.withColumn("share", share)
    total = counts.agg(F.sum("n").alias("n"), F.sum("share").alias("share"), F.count("*").alias("k")).first()
    unit = (total.n or 0) * size / total.share if total.share else 0.0
    return counts.select("_source", (F.col("share") * F.lit(unit) / F.col("n")).alias("rate")), total.k


def _key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s:"), quoted(source).cast("string")), F.lit("n"))


def _table(rate: Column) -> Column:
    """Cumulative Poisson probabilities from 0 to where they reach 1 in a double."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    first = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), last), first, step, lambda a: a["c"])


def replicate(
    df: DataFrame,
    weights: dict[str, float] | None = None,
    temperature: float = 0.5,
    size: float = 1.0,
    seed: int = 42,
    source: str = "source",
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """df's rows, each as often as it was drawn, in a global random order.

    Adds rate, n_copies, copy (from 1) and shuffle_key, a uniform number that
    the rows are sorted by within each partition; rows are dealt to
    partitions by it.  Rows with a null source form a source of their own.
    Texts under one id, and under a null id, draw each for itself; rows that
    repeat both id and text draw the same count.  Without a text column the
    id alone draws.  An empty table, or target shares that add up to nothing,
    give an empty table.  Columns named like an output are replaced.
    """
    made = ["rate", "n_copies", "copy", "shuffle_key"]
    kept = [c for c in df.columns if c in others(df, *made) or c in (source, doc_id, text)]
    # columns go by number meanwhile, so none can clash with what is added
    ident = F.coalesce(quoted(doc_id).cast("string"), F.lit("null"))
    if others(df, text) != df.columns:
        ident = F.concat_ws(":", ident, F.md5(F.coalesce(quoted(text), F.lit(""))))
    x = df.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(kept)], ident.alias("_ident"), _key(source).alias("_source"))
    table, n = rates(df, weights, temperature, size, source)
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    table = table.withColumn("_parts", parts).withColumn("_cdf", _table(F.col("rate") / F.col("_parts")))
    x = attach(x, table, "_source", n)
    below = lambda u: F.size(F.filter(F.col("_cdf"), lambda c: c <= u))
    draw = lambda j: let(uniform(F.col("_ident"), j.cast("string"), F.lit(f"draw{seed}")), below)
    one = draw(F.lit(1))
    many = F.aggregate(F.sequence(F.lit(1), F.col("_parts")), F.lit(0), lambda a, j: a + draw(j))
    x = x.withColumn("n_copies", F.when(F.col("_parts") == 1, one).otherwise(many).cast("bigint")).where("n_copies > 0")
    x = x.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_copies"))))
    x = x.withColumn("shuffle_key", uniform(F.col("_ident"), F.col("copy").cast("string"), F.lit(f"order{seed}")))
    x = x.select(*[F.col(f"c{i}") for i in range(len(kept))], *made)
    return x.repartition("shuffle_key").sortWithinPartitions("shuffle_key").toDF(*kept, *made)
