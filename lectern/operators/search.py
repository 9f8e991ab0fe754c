"""Retrieval: filtered, ranked, capped, over one source or several."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.identifiers import normalize_issn
from lectern.functions.texts import has_all_tokens

# Rows that each source returns at most.
CAPS = {"openalex": 50, "crossref": 50, "arxiv": 50, "scielo": 50, "semantic_scholar": 100, "tavily": 20}


def year_between(year: Column, low: int | None, high: int | None) -> Column:
    """Inclusive range; a bound that is 0 or None doesn't count, a null year is outside any range."""
    out = F.lit(True)
    if low:
        out = out & (year >= low)
    if high:
        out = out & (year <= high)
    return out


@dataclass(frozen=True)
class Query:
    text: str = ""
    year_from: int | None = None
    year_to: int | None = None
    issn: str | None = None
    type: str | None = None
    journal: str | None = None
    sort: str = "cited_by_count"
    per_page: int = 25


def matches(q: Query, text: str = "title", **columns: str) -> Column:
    """The query's filters as one predicate, which Spark pushes to the scan as far as it can."""
    at = {"year": "year", "issn": "issn", "type": "type", "journal": "journal"} | columns
    out = year_between(F.col(at["year"]), q.year_from, q.year_to)
    if q.issn:
        out = out & (normalize_issn(F.col(at["issn"])) == normalize_issn(F.lit(q.issn)))
    if q.type:
        out = out & (F.col(at["type"]) == q.type)
    if q.journal:
        out = out & F.lower(F.col(at["journal"])).contains(q.journal.lower())
    if q.text:
        out = out & has_all_tokens(F.col(text), q.text)
    return out


def search(works: DataFrame, q: Query, cap: int | None = 50, tie: str = "work_id", **columns: str) -> DataFrame:
    """The best rows of the query, by the sort column downwards, then by id; at most ``cap``, unless that is None."""
    text = columns.pop("text", "title")
    found = works.where(matches(q, text, **columns))
    return found.orderBy(F.col(q.sort).desc_nulls_last(), F.col(tie)).limit(q.per_page if cap is None else min(q.per_page, cap))


def search_each(works: DataFrame, q: Query, sources: list[str], caps: dict[str, int] | None = None, source: str = "source_api", tie: str = "work_id", **columns: str) -> DataFrame:
    """Results of several sources in the order asked for, with source_order and rank.

    All sources are one scan: a window ranks rows within each, and its limit
    is applied before the shuffle.
    """
    text = columns.pop("text", "title")
    order = {s.strip().lower(): i for i, s in reversed(list(enumerate(sources)))}
    place = F.create_map(*[c for k, i in order.items() for c in (F.lit(k), F.lit(i))])
    caps = caps or CAPS
    most = F.create_map(*[c for k in order for c in (F.lit(k), F.lit(min(q.per_page, caps.get(k, 50))))])
    name = F.lower(F.col(source))
    found = works.where(name.isin(list(order)) & matches(q, text, **columns))
    by = W.partitionBy(source).orderBy(F.col(q.sort).desc_nulls_last(), F.col(tie))
    highest = max([min(q.per_page, caps.get(k, 50)) for k in order], default=0)
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= highest)
    return ranked.withColumn("source_order", F.element_at(place, name)).where(F.col("rank") <= F.element_at(most, name))


def summary(works: DataFrame, q: Query, source: str = "source_api", **columns: str) -> DataFrame:
    """Total rows by source, before caps."""
    text = columns.pop("text", "title")
    return works.where(matches(q, text, **columns)).groupBy(source).agg(F.count("*").alias("total"))


def web_results(pages: DataFrame, domains: list[str], limit: int = 10, cap: int | None = CAPS["tavily"], url: str = "url", content: str = "content", tie: str = "page_id") -> DataFrame:
    """Pages of the domains (any, if none is named) and their subdomains, with 300 characters of content."""
    host = F.lower(F.regexp_extract(F.col(url), r"://([^/?#:]*)", 1))
    wanted = F.lit(not domains)
    for d in domains:
        wanted = wanted | (host == d.lower()) | host.endswith("." + d.lower())
    found = pages.where(wanted).withColumn("host", host).withColumn("snippet", F.substring(content, 1, 300))
    return found.orderBy(tie).limit(limit if cap is None else min(limit, cap))
