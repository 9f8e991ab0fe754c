"""Citation verification, retractions, open access, keyword trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.folders import cut
from lectern.functions.identifiers import normalize_doi
from lectern.functions.texts import has_all_tokens, titles_match, tokens


#: Probes up to this number are broadcast; they are counted first.
BROADCAST_ROWS = 20_000


def _words(df: DataFrame, *columns: str) -> Column:
    """Distinct words of the columns that df has."""
    return tokens(F.concat_ws(" ", *[F.col(c) for c in columns if c in df.columns]))


def candidates(refs: DataFrame, works: DataFrame, slack: int = 1) -> DataFrame:
    """(ref_id, near, same): the works that share most words with a reference, as structs (overlap, work_id).

    ``near`` is the best within ``slack`` years, ``same`` the best of the very
    year; of equal overlaps the smallest work_id.  Words are those of title
    and author.  A reference's words are probed rarest first, one, then two,
    four and so on: a work that none of the first n of m words has led to
    shares m - n at most, so a reference whose best has more is settled, and
    common words are hardly ever looked up.
    """
    asked = refs.select("ref_id", F.col("year").alias("claimed"), _words(refs, "author", "title").alias("words"))
    held = works.select("work_id", F.col("year").alias("_y"), _words(works, "authors", "title").alias("held"))
    needed = asked.select(F.explode("words").alias("word")).distinct()
    counts = held.select(F.explode("held").alias("word")).join(needed, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    rare = asked.select("ref_id", F.explode("words").alias("word")).join(counts, "word").groupBy("ref_id")
    rare = rare.agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]).alias("words"))
    todo = cut(asked.select("ref_id", "claimed").join(rare, "ref_id"))
    low, width, best = 0, 1, None
    while not todo.isEmpty():
        probes = todo.select("ref_id", "claimed", "words", F.explode(F.slice("words", low + 1, width)).alias("word"))
        probes = F.broadcast(probes) if todo.count() * width <= BROADCAST_ROWS else probes
        shared = F.array_intersect("words", "held")
        met = held.select("work_id", "_y", "held", F.explode("held").alias("word")).join(probes, "word")
        # a pair counts at the rarest word that both have, so once in all rounds
        met = met.where((F.abs(F.col("_y") - F.col("claimed")) <= slack) & (F.element_at(shared, 1) == F.col("word")))
        one = F.struct((-F.size(shared)).alias("less"), F.col("work_id"))
        now = met.groupBy("ref_id").agg(F.min(one).alias("near"), F.min(F.when(F.col("_y") == F.col("claimed"), one)).alias("same"))
        if best is not None:
            now = now.unionByName(best).groupBy("ref_id").agg(F.min("near").alias("near"), F.min("same").alias("same"))
        best = cut(now)
        low, width = low + width, 2 * width
        unseen = F.size("words") - low
        sure = lambda c: F.coalesce(-F.col(f"{c}.less"), F.lit(0)) > unseen
        left = todo.join(best, "ref_id", "left").where((unseen > 0) & ~(sure("near") & sure("same")))
        todo = cut(left.select(*todo.columns))
    if best is None:
        kind = f"struct<overlap:int,work_id:{works.schema['work_id'].dataType.simpleString()}>"
        return refs.select("ref_id", F.lit(None).cast(kind).alias("near"), F.lit(None).cast(kind).alias("same")).limit(0)
    plain = lambda c: F.when(F.col(c).isNotNull(), F.struct((-F.col(f"{c}.less")).alias("overlap"), F.col(f"{c}.work_id").alias("work_id"))).alias(c)
    return best.select("ref_id", plain("near"), plain("same"))


def verify(refs: DataFrame, works: DataFrame, strict: bool = False) -> DataFrame:
    """(ref_id, verified, confidence, work_id, doi, matched_title) of references (ref_id, title, year, perhaps author).

    The best candidate within a year decides with its title against the
    reference's alone (confidence high); else the best of the very year
    counts as medium without a title test, unless ``strict``.  A reference
    without any is not verified.  ``work_id`` and ``doi`` are those of the
    match; ``matched_title`` is the closest title, verified or not.  Works
    without a doi column have none.
    """
    best = candidates(refs, works)
    near = F.col("near.work_id")
    fields = works.select(F.col("work_id").alias("_w"), F.col("title").alias("_t"), (F.col("doi") if "doi" in works.columns else F.lit("")).alias("_d"))
    ids = best.select(F.explode(F.array(near, F.col("same.work_id"))).alias("_w")).where("_w IS NOT NULL").distinct()
    some = cut(fields.join(ids, "_w", "left_semi").groupBy("_w").agg(F.min(F.struct("_t", "_d")).alias("_f")))
    of = lambda c: some.select(F.col("_w").alias(f"_{c}"), F.col("_f").alias(f"_{c}_f"))
    x = refs.select("ref_id", F.col("title").alias("asked")).join(best, "ref_id", "left")
    x = x.join(of("near"), near == F.col("_near"), "left").join(of("same"), F.col("same.work_id") == F.col("_same"), "left")
    high = F.coalesce(titles_match(F.col("asked"), F.col("_near_f._t")), F.lit(False))
    medium = F.lit(False) if strict else F.col("same").isNotNull()
    confidence = F.when(high, "high").when(medium, "medium").otherwise("low" if strict else "none")
    match = lambda a, b: F.when(high, F.col(a)).when(medium, F.col(b))
    return x.select(
        "ref_id",
        (high | medium).alias("verified"),
        confidence.alias("confidence"),
        match("near.work_id", "same.work_id").alias("work_id"),
        F.coalesce(match("_near_f._d", "_same_f._d"), F.lit("")).alias("doi"),
        F.coalesce(match("_near_f._t", "_same_f._t"), F.col("_near_f._t"), F.lit("")).alias("matched_title"),
    )


def verify_summary(verified: DataFrame) -> DataFrame:
    return verified.agg(F.count("*").alias("total"), F.count_if("verified").alias("verified"), F.count_if(~F.col("verified")).alias("unverified"))


def retraction_flags(updates: DataFrame, key: str = "doi") -> DataFrame:
    """(doi, retracted, n_updates) from one row an update (doi, type)."""
    return updates.groupBy(key).agg(F.bool_or(F.col("type") == "retraction").alias("retracted"), F.count("*").alias("n_updates"))


def open_access(dois: DataFrame, locations: DataFrame) -> DataFrame:
    """Status of every asked DOI; one that isn't known is closed."""
    asked = dois.withColumn("_key", F.lower(normalize_doi(F.col("doi"))))
    held = locations.select(F.lower(normalize_doi(F.col("doi"))).alias("_key"), "oa_status", "is_oa", "pdf_url")
    x = asked.join(held, "_key", "left")
    return x.select("doi", F.coalesce("oa_status", F.lit("closed")).alias("oa_status"), F.coalesce("is_oa", F.lit(False)).alias("is_oa"), F.coalesce("pdf_url", F.lit("")).alias("pdf_url"))


def keyword_trends(works: DataFrame, keywords: list[str], first: int = 2015, last: int = 2025, text: str = "title") -> DataFrame:
    """(keyword, year, count) over the whole grid, 0 where nothing matched.

    One scan tests all keywords (a text matches if it has all the keyword's
    words); the matches are counted before they are shuffled.
    """
    words = [k.strip() for k in keywords]
    hits = F.filter(F.array(*[F.when(has_all_tokens(F.col(text), k), F.lit(k)) for k in words]), lambda x: x.isNotNull())
    counted = works.where(F.col("year").between(first, last)).select("year", F.explode(hits).alias("keyword")).groupBy("keyword", "year").agg(F.count("*").alias("n"))
    spark = works.sparkSession
    grid = spark.createDataFrame([(k, y) for k in dict.fromkeys(words) for y in range(first, last + 1)], "keyword string, year int")
    return grid.join(counted, ["keyword", "year"], "left").select("keyword", "year", F.coalesce("n", F.lit(0)).alias("count"))


def status(verified: Column, retracted: Column) -> Column:
    return F.when(verified & F.coalesce(retracted, F.lit(False)), "VERIFIED + RETRACTED").when(verified, "VERIFIED").otherwise("UNVERIFIED")
