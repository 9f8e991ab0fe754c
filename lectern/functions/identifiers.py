"""Identifiers: DOI, ISSN, arXiv, OpenAlex, Semantic Scholar, cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of identifiers.
DOI_PREFIXES = ["https://doi.org/", "http://doi.org/", "doi:"]
ARXIV = r"^(?:(?i)arxiv:)?(\d{4}\.\d{4,5})(v\d+)?$"
OPENALEX = r"^[Ww]\d+$"
S2 = r"^[0-9a-fA-F]{40}$"


def normalize_doi(doi: Column) -> Column:
    """Trimmed, without resolver prefixes in any case; the rest keeps its case."""
    out = F.trim(doi)
    for prefix in DOI_PREFIXES:
        out = F.regexp_replace(out, "(?i)^" + prefix.replace(".", r"\."), "")
    return out


def normalize_issn(issn: Column) -> Column:
    """Trimmed and upper-cased; eight characters without a hyphen get one."""
    x = F.upper(F.trim(issn))
    return F.when((F.length(x) == 8) & ~x.contains("-"), F.concat(F.substring(x, 1, 4), F.lit("-"), F.substring(x, 5, 4))).otherwise(x)


def resolve_id(raw: Column) -> Column:
    """Struct (id_type, value) of an identifier in any form; the first form that fits counts."""
    x = F.trim(raw)
    plain = normalize_doi(x)
    prefixed = x.rlike(r"(?i)^(https?://doi\.org/|doi:)")
    tail = F.element_at(F.split(F.element_at(F.split(x, r"openalex\.org/"), -1), "[?#]"), 1)
    of = lambda kind, value: F.struct(F.lit(kind).alias("id_type"), value.alias("value"))
    return (
        F.when(prefixed | (plain.startswith("10.") & plain.contains("/")), of("doi", plain))
        .when(x.rlike(ARXIV), of("arxiv", F.regexp_extract(x, ARXIV, 1)))
        .when(tail.rlike(OPENALEX), of("openalex", F.upper(tail)))
        .when(x.rlike(S2), of("s2", x))
        .otherwise(of("unknown", x))
    )


def s2_lookup_id(ident: Column) -> Column:
    """Semantic Scholar's form: DOIs get a DOI: prefix, other ids stay."""
    return F.when(ident.contains("/") & ~ident.startswith("DOI:"), F.concat(F.lit("DOI:"), ident)).otherwise(ident)


def openalex_short(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"^https://openalex\.org/", "")


def cache_key(url: Column, params: Column, entity_type: Column | None = None) -> Column:
    """SHA-256 of the url and the parameters in key order; with an entity type, entities don't share keys."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(params)))
    parts = [url, F.to_json(ordered)] if entity_type is None else [entity_type, url, F.to_json(ordered)]
    return F.sha2(F.concat_ws(":", *parts), 256)
