"""The citation graph: neighbours, networks, co-citations, influence, context, authors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def citing(edges: DataFrame, works: DataFrame, seeds: DataFrame, per_page: int = 25) -> DataFrame:
    """(seed, rank, work_id, ...): the most cited works that cite each seed (a column work_id)."""
    hits = edges.join(seeds.select(F.col("work_id").alias("cited")), "cited").withColumnRenamed("cited", "seed")
    x = hits.join(works, hits.citing == works.work_id).drop("citing")
    by = W.partitionBy("seed").orderBy(F.col("cited_by_count").desc_nulls_last(), "work_id")
    return x.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= per_page)


def references(edges: DataFrame, works: DataFrame, seeds: DataFrame, per_page: int = 25) -> DataFrame:
    """(seed, rank, work_id, ...): the works among each seed's first references (by ``ord``)."""
    hits = edges.join(seeds.select(F.col("work_id").alias("citing")), "citing").withColumnRenamed("citing", "seed")
    first = hits.withColumn("rank", F.row_number().over(W.partitionBy("seed").orderBy("ord", "cited"))).where(F.col("rank") <= per_page)
    return first.join(works, first.cited == works.work_id).drop("cited")


def co_citations(edges: DataFrame, wanted: DataFrame | None = None, least: int = 2, limit: int | None = None) -> DataFrame:
    """(paper_a, paper_b, co_citations): pairs cited together by at least ``least`` works.

    ``edges`` is distinct (citing, cited).  ``wanted`` (a column work_id)
    restricts both papers before they are paired.  A work pairs its own
    references only, so the cost follows reference lists, not the papers'
    fame.
    """
    e = edges if wanted is None else edges.join(wanted.select(F.col("work_id").alias("cited")), "cited", "left_semi")
    a, b = e.select("citing", F.col("cited").alias("paper_a")), e.select("citing", F.col("cited").alias("paper_b"))
    pairs = a.join(b, "citing").where("paper_a < paper_b").groupBy("paper_a", "paper_b").agg(F.count("*").alias("co_citations")).where(F.col("co_citations") >= least)
    return pairs if limit is None else pairs.orderBy(F.col("co_citations").desc(), "paper_a", "paper_b").limit(limit)


def network(
    edges: DataFrame, works: DataFrame, seeds: DataFrame, depth: int = 1, max_nodes: int = 100, per_node: int = 10, deepest: int | None = 2, most_nodes: int | None = 200
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a breadth-first walk from the seeds (ord, work_id).

    Each level is one join.  Nodes (work_id, level, place) come in the order
    in which they are first met: by level, then by the place of the node that
    cites them and of the reference; the first ``max_nodes`` stay.  Works
    that aren't loaded are no nodes, but edges (citing, cited, level, place)
    may end at them.  ``deepest`` and ``most_nodes`` bound what a caller can
    ask for; None lifts them.
    """
    depth = depth if deepest is None else min(depth, deepest)
    max_nodes = max_nodes if most_nodes is None else min(max_nodes, most_nodes)
    by = W.partitionBy("citing").orderBy("ord", "cited")
    refs = edges.withColumn("_n", F.row_number().over(by).cast("bigint")).where(F.col("_n") <= per_node)
    known = works.select("work_id")
    level = seeds.groupBy("work_id").agg(F.min("ord").alias("p1")).join(known, "work_id", "left_semi")
    level = level.select("work_id", F.lit(0).alias("level"), F.array(F.col("p1").cast("bigint")).alias("place"))
    nodes = level
    for d in range(1, depth + 1):
        up = level.withColumnRenamed("work_id", "citing")
        grown = refs.join(up, "citing").withColumn("next", F.array_append("place", F.col("_n")))
        met = grown.groupBy(F.col("cited").alias("work_id")).agg(F.min("next").alias("place"))
        level = met.join(known, "work_id", "left_semi").join(nodes, "work_id", "left_anti").select("work_id", F.lit(d).alias("level"), "place")
        nodes = nodes.unionByName(level)
    nodes = nodes.orderBy("level", "place").limit(max_nodes)
    links = refs.join(nodes.where(F.col("level") < depth).select(F.col("work_id").alias("citing"), "level", "place"), "citing")
    return nodes.select("work_id", "level", "place"), links.select("citing", "cited", "level", F.array_append("place", F.col("_n")).alias("place"))


def network_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nodes_count, edges_count) of a network, before its edges are cut."""
    counts = nodes.agg(F.count("*").alias("nodes_count")).select("*", F.lit(1).alias("_one"))
    return counts.join(edges.agg(F.count("*").alias("edges_count")).select("*", F.lit(1).alias("_one")), "_one").drop("_one")


def with_influence(citations: DataFrame) -> DataFrame:
    """Citations with a title, and over all of them how many there are and how many are influential."""
    titled = citations.where(F.coalesce("title", F.lit("")) != "")
    return titled.groupBy("cited").agg(F.count("*").alias("returned"), F.count_if("is_influential").alias("influential_count"))


def context(refs: DataFrame, pairs: DataFrame, most: int = 500) -> DataFrame:
    """For (citing, cited_doi) pairs the first reference whose DOI equals or contains the cited one.

    Among a work's first ``most`` references by rank; found is false where
    there is none.  An empty DOI finds nothing.
    """
    p = pairs.withColumn("_want", F.lower(F.regexp_replace("cited_doi", "(?i)doi:", "")))
    r = refs.where(F.col("rank") < most).select(F.col("citing").alias("_c"), "rank", F.lower("ref_doi").alias("_doi"), "cited_title", "is_influential")
    hit = (F.col("citing") == F.col("_c")) & (F.col("_want") != "") & F.contains(F.col("_doi"), F.col("_want"))
    met = p.join(r, hit, "left").groupBy("citing", "cited_doi").agg(F.min_by(F.struct("rank", "cited_title", "is_influential"), "rank").alias("x"))
    return met.select("citing", "cited_doi", F.col("x").isNotNull().alias("found"), F.col("x.rank").alias("rank"), F.col("x.cited_title").alias("cited_title"), F.col("x.is_influential").alias("is_influential"))


def authors(works: DataFrame, author: str = "author_id") -> DataFrame:
    """Profile of every author: works, citations, h-index."""
    by = W.partitionBy(author).orderBy(F.col("cited_by_count").desc(), "work_id")
    ranked = works.withColumn("_n", F.row_number().over(by))
    return ranked.groupBy(author).agg(
        F.count("*").alias("works_count"),
        F.sum("cited_by_count").alias("cited_by_count"),
        F.count_if(F.col("cited_by_count") >= F.col("_n")).alias("h_index"),
    )


def author_works(works: DataFrame, wanted: Column, per_page: int = 20, author: str = "author_id") -> DataFrame:
    """The most cited works of the authors that the predicate names."""
    by = W.partitionBy(author).orderBy(F.col("cited_by_count").desc(), "work_id")
    return works.where(wanted).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= per_page)
