"""Full text: positioned spans to Markdown, truncation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.texts import truncated

# Characters of a full text, what stands for the rest, what parts pages.
LIMIT = 100_000
MARKER = "\n\n[... TRUNCATED — full text too long.]"
PAGE_BREAK = "\n\n---\n\n"


def lines(spans: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, page, line, markdown): each line by its largest and boldest span; blank lines go.

    ``spans`` has (doc, page, line, at, text, size, font, flags).
    """
    bold = F.bool_or(F.lower(F.col("font")).contains("bold") | (F.col("flags").bitwiseAND(F.lit(16)) > 0))
    joined = F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda s: s["text"]), ""))
    x = spans.groupBy(doc, "page", "line").agg(joined.alias("text"), F.max("size").alias("size"), bold.alias("bold")).where("text <> ''")
    t = F.col("text")
    marked = (
        F.when((F.col("size") > 14) & F.col("bold"), F.concat(F.lit("\n## "), t, F.lit("\n")))
        .when((F.col("size") > 12) & F.col("bold"), F.concat(F.lit("\n### "), t, F.lit("\n")))
        .when(F.col("bold") & (F.length(t) < 100), F.concat(F.lit("\n**"), t, F.lit("**\n")))
        .otherwise(t)
    )
    return x.select(doc, "page", "line", marked.alias("markdown"))


def markdown(spans: DataFrame, doc: str = "doc", limit: int = LIMIT) -> DataFrame:
    """(doc, pages, text): lines joined within pages, pages by a rule, cut at ``limit`` characters."""
    in_order = lambda key, value: F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda s: s[value])
    pages = lines(spans, doc).groupBy(doc, "page").agg(F.array_join(in_order("line", "markdown"), "\n").alias("body"))
    whole = pages.groupBy(doc).agg(F.count("*").alias("pages"), F.array_join(in_order("page", "body"), PAGE_BREAK).alias("text"))
    return whole.withColumn("text", truncated(F.col("text"), limit, MARKER))
