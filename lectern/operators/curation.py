"""Curation: tiers, reference mixes, screens, flow counts, journal profiles, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.folders import cut
from lectern.functions.ranking import sjr_number

# Shares that a reference list should keep to, in percent.
LEAST_TOP, MOST_LOW, MOST_GREY = 70, 15, 10


def tiers(journals: DataFrame, top: int = 50) -> DataFrame:
    """Journals (issn, sjr_score, best_tier) with a tier: S for the ``top`` scores, else the best tier."""
    score = sjr_number(F.col("sjr_score"))
    # the top scores are a top-k, not a sort of all journals
    scored = journals.withColumn("score", score)
    best = scored.orderBy(F.col("score").desc(), "issn").limit(top).select("issn", F.lit(True).alias("_top"))
    x = scored.join(F.broadcast(best), "issn", "left")
    return x.withColumn("tier", F.when(F.col("_top"), "S").when(F.col("best_tier") == "unknown", "Grey").otherwise(F.col("best_tier"))).drop("_top")


def reference_mix(refs: DataFrame, by: str, tier: str = "tier") -> DataFrame:
    """Shares of top (S, A, B), low (C, D) and grey references and whether the mix is within its limits."""
    share = lambda *t: 100 * F.count_if(F.col(tier).isin(*t)) / F.count("*")
    x = refs.groupBy(by).agg(F.count("*").alias("n"), share("S", "A", "B").alias("top_percent"), share("C", "D").alias("low_percent"), share("Grey").alias("grey_percent"))
    fits = (F.col("top_percent") >= LEAST_TOP) & (F.col("low_percent") <= MOST_LOW) & (F.col("grey_percent") <= MOST_GREY)
    return x.withColumn("within_limits", fits)


def by_influence(works: DataFrame) -> DataFrame:
    """Works with their rank within a tier: influential citations, then citations, then id.

    There are few tiers, so works are sorted in ranges of (tier, order) and
    numbered there; a tier's works in earlier ranges are added.  What is
    added is a row a range and tier, whatever the number of works.
    """
    order = ["tier", F.col("influential").desc(), F.col("cited_by_count").desc(), "work_id"]
    ranged = cut(works.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_range", F.shiftright("_at", 33))
    firsts = ranged.groupBy("tier", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("tier").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = firsts.select(F.col("tier").alias("_tier"), "_range", (before - F.col("_first") + 1).alias("_add"))
    held = ranged.join(starts, F.col("tier").eqNullSafe(F.col("_tier")) & (ranged["_range"] == starts["_range"]))
    return held.select(*works.columns, (F.col("_at") + F.col("_add")).cast("int").alias("rank"))


def unlisted(journals: DataFrame, *lists: DataFrame, key: str = "issn") -> DataFrame:
    """Journals in none of the lists: possibly predatory."""
    out = journals
    for held in lists:
        out = out.join(held.select(key).distinct(), key, "left_anti")
    return out


def flow(records: DataFrame) -> DataFrame:
    """PRISMA counts by stage and reason, with totals by stage (reason ``*``) and over all (stage ``*``)."""
    x = records.rollup("stage", "reason").agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    return x.select(F.when(F.col("_g") == 3, "*").otherwise(F.col("stage")).alias("stage"), F.when(F.col("_g") >= 1, "*").otherwise(F.col("reason")).alias("reason"), "n")


def log_queries(log: DataFrame, queries: DataFrame) -> DataFrame:
    """The query log with entries appended (api, query, filters, results, date)."""
    return log.unionByName(queries.select(*log.columns))


def journal_profile(works: DataFrame, edges: DataFrame, journal: str, recent: int = 5) -> DataFrame:
    """Per journal: works, median reference count, shares of recent references and self-citations, share of each method."""
    w = works.select("work_id", "year", journal, "method")
    cited = w.select(F.col("work_id").alias("cited"), F.col("year").alias("cited_year"), F.col(journal).alias("cited_journal"))
    refs = edges.join(w.select(F.col("work_id").alias("citing"), "year", journal), "citing").join(cited, "cited")
    counts = refs.groupBy("citing").agg(F.count("*").alias("n"))
    about = w.join(counts, w.work_id == counts.citing, "left").groupBy(journal).agg(
        F.count("*").alias("works"), F.percentile(F.coalesce("n", F.lit(0)), 0.5).alias("median_references"), (100 * F.count_if(F.col("method") == "quantitative") / F.count("*")).alias("quantitative_percent")
    )
    shares = refs.groupBy(journal).agg(
        (100 * F.count_if(F.col("year") - F.col("cited_year") < recent) / F.count("*")).alias("recent_percent"),
        (100 * F.count_if(F.col(journal) == F.col("cited_journal")) / F.count("*")).alias("self_percent"),
    )
    return about.join(shares, journal, "left")


def top_cited_journals(works: DataFrame, edges: DataFrame, journal: str, limit: int = 10) -> DataFrame:
    """Per journal the journals that it cites most."""
    w = works.select("work_id", journal)
    refs = edges.join(w.select(F.col("work_id").alias("citing"), F.col(journal).alias("from_journal")), "citing").join(w.select(F.col("work_id").alias("cited"), F.col(journal).alias("to_journal")), "cited")
    counts = refs.groupBy("from_journal", "to_journal").agg(F.count("*").alias("n"))
    by = W.partitionBy("from_journal").orderBy(F.col("n").desc(), "to_journal")
    return counts.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)


def reviewer_likelihood(in_journal: Column, on_topic: Column) -> Column:
    return F.when(in_journal & on_topic, "HIGH").when(in_journal | on_topic, "MEDIUM").otherwise("LOW")


def kappa(ratings: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Cohen's kappa of two raters from one row an item: agreement beyond chance."""
    cells = ratings.groupBy(a, b).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("t"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    rows, cols = cells.groupBy(F.col(a).alias("k")).agg(F.sum("n").alias("r")), cells.groupBy(F.col(b).alias("k")).agg(F.sum("n").alias("c"))
    chance = rows.join(cols, "k").agg(F.coalesce(F.sum(F.col("r") * F.col("c")), F.lit(0)).alias("chance"))
    one = F.lit(1).alias("_one")
    x = total.select("*", one).join(chance.select("*", one), "_one")
    observed, expected = F.col("same") / F.col("t"), F.col("chance") / (F.col("t") * F.col("t"))
    return x.select(F.col("t").alias("n"), observed.alias("observed"), expected.alias("expected"), F.try_divide(observed - expected, 1 - expected).alias("kappa"))


def alpha(ratings: DataFrame, item: str = "item", value: str = "value") -> DataFrame:
    """Krippendorff's alpha for nominal values: one row a rating; items rated once don't count."""
    cells = ratings.groupBy(item, value).agg(F.count("*").alias("n"))
    items = cells.groupBy(item).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("sq")).where("m > 1")
    kept = cells.join(items.select(item), item, "left_semi")
    totals = kept.groupBy(value).agg(F.sum("n").alias("n"))
    one = F.lit(1).alias("_one")
    inner = items.agg(F.sum((F.col("m") * F.col("m") - F.col("sq")) / (F.col("m") - 1)).alias("inner"), F.sum("m").alias("n")).select("*", one)
    outer = totals.agg(F.sum(F.col("n") * F.col("n")).alias("sq")).select("*", one)
    x = inner.join(outer, "_one")
    observed = F.col("inner") / F.col("n")
    expected = (F.col("n") * F.col("n") - F.col("sq")) / (F.col("n") * (F.col("n") - 1))
    return x.select("n", (1 - F.try_divide(observed, expected)).alias("alpha"))
