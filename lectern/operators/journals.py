"""Journal rankings: three systems joined by ISSN, looked up by ISSN or name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.identifiers import normalize_issn
from lectern.functions.ranking import best_tier, sjr_number
from lectern.functions.texts import similarity_at_least


def _named(df: DataFrame, system: str) -> DataFrame:
    return df.select("issn", *[F.col(c).alias(f"{system}_{c}") for c in df.columns if c not in ("issn", "pos")], F.lit(True).alias(f"in_{system}"))


def metrics(sjr: DataFrame, qualis: DataFrame, jql: DataFrame) -> DataFrame:
    """One row an ISSN that any system has, with its title and best tier."""
    x = _named(sjr, "sjr").join(_named(qualis, "qualis"), "issn", "full").join(_named(jql, "jql"), "issn", "full")
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    title = F.coalesce(some("sjr_title"), some("jql_title"), some("qualis_title"), F.lit(""))
    tier = best_tier(F.col("sjr_quartile"), F.col("qualis_classification"), F.col("jql_abs"))
    return x.withColumn("title", title).withColumn("best_tier", tier)


def name_index(sjr_names: DataFrame, jql_names: DataFrame) -> DataFrame:
    """(name, issn, first_pos, system): both systems' names; ties go to the first system, then the first place."""
    return sjr_names.withColumn("system", F.lit(0)).unionByName(jql_names.withColumn("system", F.lit(1)))


def by_issn(queries: DataFrame, table: DataFrame) -> DataFrame:
    """Queries (qid, q) that are an ISSN of the table."""
    return queries.withColumn("issn", normalize_issn(F.col("q"))).join(table, "issn")


def by_name(queries: DataFrame, names: DataFrame) -> DataFrame:
    """Queries (qid, q) with the ISSN of their exact name; the first system counts."""
    found = queries.join(names, F.lower(F.trim("q")) == F.col("name"))
    first = W.partitionBy("qid").orderBy("system")
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("qid", "q", "issn")


def by_similar_name(queries: DataFrame, names: DataFrame, percent: int = 85) -> DataFrame:
    """Queries with the ISSN of the most similar name, at least ``percent``; ties by system, then place.

    Names that can reach the percentage have lengths within a factor, so both
    sides meet in buckets of the logarithm of the length.
    """
    from lectern.functions.texts import lcs_length

    step = 0.2623  # a little under ln(115 / 85) / 1.15
    wide = 2
    bucket = lambda c: F.floor(F.log(F.length(c)) / step).cast("int")
    q = queries.select("qid", "q", F.lower(F.trim("q")).alias("n")).where("n <> ''")
    q = q.withColumn("bucket", F.explode(F.sequence(bucket("n") - wide, bucket("n") + wide)))
    held = names.where("name <> ''").withColumn("bucket", bucket("name"))
    met = q.join(held, "bucket").where(similarity_at_least(F.col("n"), F.col("name"), percent, strict=False))
    score = 200 * lcs_length(F.col("n"), F.col("name")) / (F.length("n") + F.length("name"))
    best = W.partitionBy("qid").orderBy(F.col("score").desc(), "system", "first_pos")
    met = met.withColumn("score", score)
    return met.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("qid", "q", "issn", "score")


def by_partial_name(queries: DataFrame, titles: DataFrame, least: int = 10, gram: int = 8) -> DataFrame:
    """Queries longer than ``least`` with the first title that contains them or that they contain.

    A text that contains another holds the other's first ``gram`` characters
    (all of them, if it is shorter), so both sides meet by equality there.
    Equal queries are looked up once, of equal titles the first counts.  The
    lists of grams are many times the tables, whatever Spark estimates, so
    they are never broadcast.
    """
    asked = queries.select("qid", "q", F.lower(F.trim("q")).alias("n")).where(F.length("n") > least).distinct()
    q = asked.select("n").distinct()
    t = titles.select(F.lower("title").alias("t"), F.struct("pos", "issn").alias("place")).where("t <> ''").groupBy("t").agg(F.min("place").alias("place"))

    def grams(c: str, n: Column) -> Column:
        places = F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - n + 1))
        return F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(F.col(c), i, n))))

    g = min(gram, least)
    longer = q.withColumn("k", F.substring("n", 1, g)).join(t.select("*", grams("t", F.lit(g)).alias("k")).hint("merge"), "k").where(F.col("t").contains(F.col("n")))
    size = F.least(F.length("t"), F.lit(g))
    sizes = t.select(size.alias("size")).distinct()  # at most g rows
    held = q.withColumn("size", F.explode(F.sequence(F.lit(1), F.lit(g)))).join(F.broadcast(sizes), "size").select("n", "size", grams("n", F.col("size")).alias("k"))
    shorter = held.join(t.withColumn("size", size).withColumn("k", F.substring("t", 1, g)).hint("merge"), ["size", "k"]).where(F.col("n").contains(F.col("t")))
    met = longer.select("n", "place").union(shorter.select("n", "place")).groupBy("n").agg(F.min("place").alias("place"))
    return asked.join(met.hint("merge"), "n").select("qid", "q", "place.issn")


def rank(queries: DataFrame, table: DataFrame, names: DataFrame) -> DataFrame:
    """Rankings of (qid, q) queries by ISSN, else exact name, else similar name, with match_kind.

    ``table`` is metrics(), ``names`` name_index().  A query that nothing
    fits has match_kind ``none`` and tier ``unknown``.
    """
    first = by_issn(queries, table).select("qid", "q", "issn", F.lit("issn").alias("match_kind"))
    left = queries.join(first, "qid", "left_anti")
    second = by_name(left, names).withColumn("match_kind", F.lit("name"))
    left = left.join(second, "qid", "left_anti")
    third = by_similar_name(left, names).select("qid", "q", "issn", F.lit("similar").alias("match_kind"))
    found = first.unionByName(second).unionByName(third)
    out = queries.join(found.drop("q"), "qid", "left").join(table.select("issn", "title", "sjr_quartile", "qualis_classification", "jql_abs", "best_tier"), "issn", "left")
    title = F.when(F.col("match_kind") == "name", F.trim("q")).otherwise(F.coalesce("title", F.lit("")))
    return out.select("qid", "q", F.coalesce("issn", F.trim("q")).alias("issn"), title.alias("title"), F.coalesce("match_kind", F.lit("none")).alias("match_kind"), "sjr_quartile", "qualis_classification", "jql_abs", F.coalesce("best_tier", F.lit("unknown")).alias("best_tier"))


def top_for_field(sjr: DataFrame, qualis: DataFrame, jql: DataFrame, field: str, limit: int = 20) -> DataFrame:
    """The journals of a field (in area or title) with the highest score; a journal once an ISSN."""
    low = field.lower()
    score = sjr_number(F.col("sjr_score"))
    hits = sjr.where(F.contains(F.lower("area"), F.lit(low)) | F.contains(F.lower("title"), F.lit(low))).withColumn("score", score)
    best = hits.orderBy(F.col("score").desc(), F.col("pos")).limit(limit)
    q = qualis.select("issn", "classification")
    j = jql.select("issn", F.col("abs").alias("abs_rating"))
    x = best.join(q, "issn", "left").join(j, "issn", "left")
    return x.withColumn("best_tier", best_tier(F.col("quartile"), F.col("classification"), F.col("abs_rating")))


def enriched(journals: DataFrame, sjr: DataFrame, qualis: DataFrame, jql: DataFrame) -> DataFrame:
    """Journals (journal_id, issn_l, issns) with each system's entry of the first ISSN that has one, else N/A."""
    keys = journals.select("journal_id", F.posexplode(F.array_prepend("issns", F.col("issn_l"))).alias("at", "issn")).withColumn("issn", normalize_issn(F.col("issn")))
    out = journals
    for df, value, name in ((sjr, "quartile", "sjr"), (qualis, "classification", "qualis"), (jql, "abs", "jql")):
        found = keys.join(df.select("issn", value), "issn").groupBy("journal_id").agg(F.min_by(value, "at").alias(name))
        out = out.join(found, "journal_id", "left").withColumn(name, F.coalesce(name, F.lit("N/A")))
    return out


def source_lookup(sources: DataFrame, wanted: Column, name: str = "name", issn: str = "issn") -> Column:
    """Predicate: by ISSN if the text has a hyphen and at most ten characters, else by name."""
    by_number = wanted.contains("-") & (F.length(wanted) <= 10)
    return F.when(by_number, F.col(issn) == F.upper(wanted)).otherwise(F.lower(F.col(name)).contains(F.lower(wanted)))
