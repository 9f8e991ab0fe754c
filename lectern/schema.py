"""Canonical tables as Spark types."""

from __future__ import annotations

AUTHOR = "struct<name:string,openalex_id:string,orcid:string,h_index:int,works_count:int,cited_by_count:int>"
VENUE = "struct<name:string,issn_l:string,issns:array<string>,publisher:string,type:string,is_open_access:boolean>"
SOURCE_TYPES = ("peer_reviewed", "grey_literature", "preprint", "book", "book_chapter", "conference", "thesis", "report", "web", "unknown")

#: Columns of a paper with their types; missing strings are empty, missing lists too, a missing year is null.
PAPER = {
    "title": "string",
    "doi": "string",
    "year": "int",
    "authors": f"array<{AUTHOR}>",
    "abstract": "string",
    "cited_by_count": "bigint",
    "source_type": "string",
    "journal": "string",
    "issn": "string",
    "venue": VENUE,
    "openalex_id": "string",
    "s2_id": "string",
    "arxiv_id": "string",
    "is_open_access": "boolean",
    "pdf_url": "string",
    "tldr": "string",
    "influential_citation_count": "bigint",
    "source_api": "string",
    "references": "array<string>",
}
EMPTY = {"string": "''", "bigint": "0L", "boolean": "false"}

SJR = ["issn", "title", "sjr_score", "quartile", "h_index", "country", "area", "type", "publisher"]
QUALIS = ["issn", "title", "classification", "area"]
JQL = ["issn", "title", "subject", "ft50", "abs", "abdc", "cnrs", "fnege", "vhb", "hceres", "scopus_citescore"]
CACHE = "key string, entity_type string, value binary, created_at timestamp, expires_at timestamp"
SPAN = "page int, x double, y double, text string, size double, font string, flags int"


def as_paper(**given):
    """Columns of a paper in canonical order: those given, the others at their defaults; DOI and ISSN in their plain form."""
    from pyspark.sql import functions as F

    from lectern.functions.identifiers import normalize_doi, normalize_issn

    plain = {"doi": normalize_doi, "issn": normalize_issn}
    out = []
    for name, kind in PAPER.items():
        if name in given:
            value = plain.get(name, lambda c: c)(given[name].cast(kind))
        elif kind.startswith("array"):
            value = F.array().cast(kind)
        else:
            value = F.lit(None).cast(kind)
        if kind in EMPTY:
            value = F.coalesce(value, F.expr(EMPTY[kind]))
        elif kind.startswith("array"):
            value = F.coalesce(value, F.array().cast(kind))
        out.append(value.alias(name))
    return out
