"""Bibliographic payloads -> papers: one declared schema and one projection a source.

Every reader takes a DataFrame with a string column of raw payloads (one
response each) or of single records, so the same code serves files
(``spark.read.text(path, wholetext=True)``), tables and streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import texts
from lectern.functions.identifiers import normalize_doi, openalex_short
from lectern.schema import as_paper

MAX_AUTHORS = 10

OPENALEX_WORK = (
    "struct<id:string,title:string,doi:string,publication_year:int,type:string,cited_by_count:bigint,"
    "authorships:array<struct<author:struct<display_name:string,id:string>>>,"
    "primary_location:struct<source:struct<display_name:string,issn_l:string>>,"
    "abstract_inverted_index:map<string,array<int>>,open_access:struct<is_oa:boolean,oa_url:string>,referenced_works:array<string>>"
)
CROSSREF_ITEM = (
    "struct<DOI:string,title:array<string>,`published-print`:struct<`date-parts`:array<array<int>>>,"
    "`published-online`:struct<`date-parts`:array<array<int>>>,author:array<struct<given:string,family:string>>,"
    "`is-referenced-by-count`:bigint,`container-title`:array<string>,ISSN:array<string>,type:string,"
    "`update-to`:array<struct<type:string,DOI:string>>>"
)
S2_PAPER = (
    "struct<paperId:string,title:string,year:int,authors:array<struct<name:string>>,citationCount:bigint,"
    "influentialCitationCount:bigint,journal:string,externalIds:struct<DOI:string,ArXiv:string>,"
    "tldr:struct<text:string>,openAccessPdf:struct<url:string>,publicationTypes:array<string>,fieldsOfStudy:array<string>>"
)
S2_EDGE = f"struct<isInfluential:boolean,intents:array<string>,contexts:array<string>,citingPaper:{S2_PAPER},citedPaper:{S2_PAPER}>"
SCIELO_DOC = "struct<title:string,doi:string,year_cluster:string,au:array<string>,journal_title:string>"
ARXIV_ENTRY = "struct<id:string,title:string,summary:string,published:string,author:array<struct<name:string>>>"
UNPAYWALL = (
    "struct<doi:string,title:string,oa_status:string,is_oa:boolean,journal_name:string,publisher:string,"
    "best_oa_location:struct<url:string,url_for_pdf:string,version:string,license:string,host_type:string>>"
)
TAVILY = "struct<results:array<struct<title:string,url:string,content:string,score:double>>>"
ENVELOPES = {
    "openalex": f"struct<results:array<{OPENALEX_WORK}>,meta:struct<count:bigint>>",
    "crossref": f"struct<message:struct<items:array<{CROSSREF_ITEM}>,`total-results`:bigint>>",
    "semantic_scholar": f"struct<data:array<{S2_PAPER}>,total:bigint>",
}


def _authors(names: Column, ids: Column | None = None) -> Column:
    """Author structs of the first names; ids run along."""

    def one(name: Column, ident: Column) -> Column:
        none = F.lit(None)
        return F.struct(
            F.coalesce(name, F.lit("")).alias("name"),
            F.coalesce(ident, F.lit("")).alias("openalex_id"),
            F.lit("").alias("orcid"),
            none.cast("int").alias("h_index"),
            none.cast("int").alias("works_count"),
            none.cast("int").alias("cited_by_count"),
        )

    first = F.slice(names, 1, MAX_AUTHORS)
    if ids is None:
        return F.transform(first, lambda n: one(n, F.lit("")))
    return F.zip_with(first, F.slice(ids, 1, MAX_AUTHORS), one)


def _unwrap(df: DataFrame, payload: str, envelope: str, items: str) -> DataFrame:
    """One row a record of the responses; what can't be parsed has none."""
    parsed = df.select(F.from_json(F.col(payload), envelope).alias("r"))
    return parsed.select(F.posexplode(F.col(f"r.{items}")).alias("rank", "w"))


def openalex_papers(works: DataFrame, work: str = "w", **overrides: Column) -> DataFrame:
    """Papers of OpenAlex works (a struct column); overrides replace columns."""
    w = F.col(work)
    source = w["primary_location"]["source"]
    columns = {
        "title": w["title"],
        "doi": w["doi"],
        "year": w["publication_year"],
        "authors": _authors(F.transform(w["authorships"], lambda a: a["author"]["display_name"]), F.transform(w["authorships"], lambda a: openalex_short(a["author"]["id"]))),
        "abstract": texts.abstract_text(w["abstract_inverted_index"]),
        "cited_by_count": w["cited_by_count"],
        "source_type": texts.mapped(w["type"], texts.OPENALEX_TYPES),
        "journal": source["display_name"],
        "issn": source["issn_l"],
        "openalex_id": openalex_short(w["id"]),
        "is_open_access": w["open_access"]["is_oa"],
        "source_api": F.lit("openalex"),
        "references": F.transform(w["referenced_works"], openalex_short),
    }
    return works.select(*as_paper(**columns | overrides))


def read_openalex(df: DataFrame, payload: str = "value") -> DataFrame:
    return openalex_papers(_unwrap(df, payload, ENVELOPES["openalex"], "results"))


def read_scielo_via_openalex(df: DataFrame, payload: str = "value") -> DataFrame:
    """OpenAlex works of the publisher: always open access, with the open copy's url."""
    works = _unwrap(df, payload, ENVELOPES["openalex"], "results")
    return openalex_papers(works, source_api=F.lit("scielo_via_openalex"), is_open_access=F.lit(True), pdf_url=F.col("w")["open_access"]["oa_url"])


def read_crossref(df: DataFrame, payload: str = "value") -> DataFrame:
    """Papers of CrossRef items; the year is that of print, else online."""
    items = _unwrap(df, payload, ENVELOPES["crossref"], "message.items")
    w = F.col("w")
    dated = F.coalesce(w["published-print"], w["published-online"])
    name = lambda a: F.trim(F.concat_ws(" ", F.coalesce(a["given"], F.lit("")), F.coalesce(a["family"], F.lit(""))))
    return items.select(
        *as_paper(
            title=F.get(w["title"], 0),
            doi=w["DOI"],
            year=F.get(F.get(dated["date-parts"], 0), 0),
            authors=_authors(F.transform(w["author"], name)),
            cited_by_count=w["is-referenced-by-count"],
            journal=F.get(w["container-title"], 0),
            issn=F.get(w["ISSN"], 0),
            source_type=texts.mapped(w["type"], texts.CROSSREF_TYPES),
            source_api=F.lit("crossref"),
        )
    )


def by_doi(papers: DataFrame, asked: DataFrame, doi: str) -> DataFrame:
    """The papers of asked DOIs, in any form and case."""
    keys = asked.select(F.lower(normalize_doi(F.col(doi))).alias("_key")).distinct()
    return papers.join(keys, F.lower(F.col("doi")) == F.col("_key"), "left_semi")


def crossref_retractions(df: DataFrame, payload: str = "value") -> DataFrame:
    """Retraction status of CrossRef works (one response each)."""
    w = F.from_json(F.col(payload), f"struct<message:{CROSSREF_ITEM}>")["message"]
    x = df.select(w.alias("w"))
    updates = F.transform(F.coalesce(F.col("w.update-to"), F.array()), lambda u: F.struct(F.coalesce(u["type"], F.lit("")).alias("type"), F.coalesce(u["DOI"], F.lit("")).alias("doi")))
    return x.select(
        F.col("w.DOI").alias("doi"),
        F.exists(updates, lambda u: u["type"] == "retraction").alias("retracted"),
        (F.coalesce(F.col("w.type"), F.lit("")) == "retraction").alias("is_retraction_notice"),
        F.coalesce(F.get(F.col("w.title"), 0), F.lit("")).alias("title"),
        updates.alias("updates"),
    )


def _journal_name(journal: Column) -> Column:
    """A journal that is an object or a plain string."""
    return F.when(journal.startswith("{"), F.get_json_object(journal, "$.name")).otherwise(journal)


def _s2(w: Column) -> dict[str, Column]:
    return {
        "title": w["title"],
        "doi": w["externalIds"]["DOI"],
        "year": w["year"],
        "authors": _authors(F.transform(w["authors"], lambda a: a["name"])),
        "cited_by_count": w["citationCount"],
        "influential_citation_count": w["influentialCitationCount"],
        "journal": _journal_name(w["journal"]),
        "s2_id": w["paperId"],
        "arxiv_id": w["externalIds"]["ArXiv"],
        "tldr": w["tldr"]["text"],
        "source_type": texts.s2_source_type(F.coalesce(w["publicationTypes"], F.array().cast("array<string>"))),
        "source_api": F.lit("semantic_scholar"),
        "pdf_url": w["openAccessPdf"]["url"],
    }


def read_semantic_scholar(df: DataFrame, payload: str = "value", fields: list[str] | None = None) -> DataFrame:
    """Papers of responses; with ``fields`` those of any of these fields of study."""
    found = _unwrap(df, payload, ENVELOPES["semantic_scholar"], "data")
    if fields:
        found = found.where(F.arrays_overlap(F.col("w.fieldsOfStudy"), F.array(*[F.lit(f) for f in fields])))
    return found.select(*as_paper(**_s2(F.col("w"))))


def read_s2_citations(df: DataFrame, payload: str = "value") -> DataFrame:
    """Citing papers with influence, intents and up to 3 contexts; those without a title are left out."""
    edges = _unwrap(df, payload, f"struct<data:array<{S2_EDGE}>>", "data")
    c = F.col("w.citingPaper")
    none = F.array().cast("array<string>")
    return edges.where(F.coalesce(c["title"], F.lit("")) != "").select(
        "rank",
        c["title"].alias("title"),
        F.slice(F.transform(c["authors"], lambda a: a["name"]), 1, 5).alias("authors"),
        c["year"].alias("year"),
        F.coalesce(c["externalIds"]["DOI"], F.lit("")).alias("doi"),
        F.coalesce(c["citationCount"], F.lit(0)).alias("citation_count"),
        F.coalesce(F.col("w.isInfluential"), F.lit(False)).alias("is_influential"),
        F.coalesce(F.col("w.intents"), none).alias("intents"),
        F.slice(F.coalesce(F.col("w.contexts"), none), 1, 3).alias("contexts"),
    )


def read_s2_references(df: DataFrame, payload: str = "value") -> DataFrame:
    """Referenced papers of responses with their place, for citation contexts."""
    keep = [c for c in df.columns if c != payload]
    parsed = df.select(*keep, F.from_json(F.col(payload), f"struct<data:array<{S2_EDGE}>>").alias("r"))
    edges = parsed.select(*keep, F.posexplode("r.data").alias("rank", "w"))
    none = F.array().cast("array<string>")
    return edges.select(
        *keep,
        "rank",
        F.coalesce(F.col("w.citedPaper.externalIds.DOI"), F.lit("")).alias("cited_doi"),
        F.coalesce(F.col("w.citedPaper.title"), F.lit("")).alias("cited_title"),
        F.coalesce(F.col("w.isInfluential"), F.lit(False)).alias("is_influential"),
        F.coalesce(F.col("w.intents"), none).alias("intents"),
        F.coalesce(F.col("w.contexts"), none).alias("contexts"),
    )


def _one_of(value: Column) -> Column:
    """A value that is a string or a list of strings: the first."""
    return F.when(value.startswith("["), F.get_json_object(value, "$[0]")).otherwise(value)


def read_scielo(df: DataFrame, payload: str = "value") -> DataFrame:
    """Papers of the direct search: docs or results, with list-or-string fields; other content gives none."""
    parsed = df.select(F.from_json(F.col(payload), f"struct<docs:array<{SCIELO_DOC}>,results:array<{SCIELO_DOC}>>").alias("r"))
    held = F.when(F.size(F.col("r.docs")) > 0, F.col("r.docs")).otherwise(F.col("r.results"))
    docs = parsed.select(F.posexplode(held).alias("rank", "w"))
    w = F.col("w")
    year = _one_of(w["year_cluster"])
    return docs.select(
        *as_paper(
            title=_one_of(w["title"]),
            doi=w["doi"],
            year=F.when(year.rlike(r"^\d+$"), year.try_cast("int")),
            authors=_authors(w["au"]),
            journal=_one_of(w["journal_title"]),
            source_type=F.lit("peer_reviewed"),
            source_api=F.lit("scielo_direct"),
            is_open_access=F.lit(True),
        )
    )


def read_arxiv(df: DataFrame, payload: str = "value") -> DataFrame:
    """Papers of Atom feeds: always grey literature; the id keeps its version."""
    feed = F.from_xml(F.col(payload), f"struct<entry:array<{ARXIV_ENTRY}>>")
    entries = df.select(feed.alias("r")).select(F.posexplode("r.entry").alias("rank", "w"))
    w = F.col("w")
    flat = lambda c: F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" "))
    ident = F.element_at(F.split(F.coalesce(w["id"], F.lit("")), "/abs/"), -1)
    return entries.select(
        *as_paper(
            title=flat(w["title"]),
            year=F.substring(w["published"], 1, 4).try_cast("int"),
            authors=_authors(F.filter(F.transform(w["author"], lambda a: a["name"]), lambda n: n != "")),
            abstract=F.substring(flat(w["summary"]), 1, 500),
            arxiv_id=ident,
            source_type=F.lit("grey_literature"),
            source_api=F.lit("arxiv"),
            pdf_url=F.when(ident != "", F.concat(F.lit("https://arxiv.org/pdf/"), ident)),
        )
    )


def read_unpaywall(df: DataFrame, payload: str = "value") -> DataFrame:
    """Open-access records; location fields are null where there is no open copy."""
    x = df.select(F.from_json(F.col(payload), UNPAYWALL).alias("w"))
    best = F.col("w.best_oa_location")
    filled = lambda c, other: F.when(best.isNotNull(), F.coalesce(c, F.lit(other)))
    url = F.coalesce(F.when(best["url_for_pdf"] != "", best["url_for_pdf"]), best["url"], F.lit(""))
    return x.select(
        F.col("w.doi").alias("doi"),
        F.coalesce(F.col("w.title"), F.lit("")).alias("title"),
        F.coalesce(F.col("w.oa_status"), F.lit("closed")).alias("oa_status"),
        F.coalesce(F.col("w.is_oa"), F.lit(False)).alias("is_oa"),
        F.coalesce(F.col("w.journal_name"), F.lit("")).alias("journal"),
        F.coalesce(F.col("w.publisher"), F.lit("")).alias("publisher"),
        F.when(best.isNotNull(), url).alias("pdf_url"),
        filled(best["version"], "unknown").alias("version"),
        filled(best["license"], "unknown").alias("license"),
        filled(best["host_type"], "unknown").alias("host_type"),
    )


def read_tavily(df: DataFrame, payload: str = "value") -> DataFrame:
    """Web results with 300 characters of content."""
    rows = df.select(F.from_json(F.col(payload), TAVILY).alias("r")).select(F.posexplode("r.results").alias("rank", "w"))
    return rows.select(
        "rank",
        F.coalesce(F.col("w.title"), F.lit("")).alias("title"),
        F.coalesce(F.col("w.url"), F.lit("")).alias("url"),
        F.substring(F.coalesce(F.col("w.content"), F.lit("")), 1, 300).alias("content"),
        F.coalesce(F.col("w.score"), F.lit(0.0)).alias("score"),
        F.lit("web_search").alias("source_type"),
    )


OPENALEX_SOURCE = (
    "struct<id:string,display_name:string,issn_l:string,issn:array<string>,works_count:bigint,cited_by_count:bigint,"
    "summary_stats:struct<h_index:int>,type:string,host_organization_lineage_names:array<string>,"
    "x_concepts:array<struct<display_name:string>>,is_oa:boolean>"
)
OPENALEX_AUTHOR = (
    "struct<id:string,display_name:string,orcid:string,works_count:bigint,cited_by_count:bigint,summary_stats:struct<h_index:int>,"
    "last_known_institutions:array<struct<display_name:string>>>"
)


def read_openalex_sources(df: DataFrame, payload: str = "value") -> DataFrame:
    """Journal records: the publisher is the first of its lineage, subjects are the first five concepts."""
    rows = _unwrap(df, payload, f"struct<results:array<{OPENALEX_SOURCE}>>", "results")
    w, empty = F.col("w"), F.lit("")
    return rows.select(
        openalex_short(w["id"]).alias("journal_id"),
        F.coalesce(w["display_name"], empty).alias("name"),
        F.coalesce(w["issn_l"], empty).alias("issn_l"),
        F.coalesce(w["issn"], F.array().cast("array<string>")).alias("issns"),
        w["works_count"].alias("works_count"),
        w["cited_by_count"].alias("cited_by_count"),
        w["summary_stats"]["h_index"].alias("h_index"),
        F.coalesce(w["type"], empty).alias("type"),
        F.coalesce(F.get(w["host_organization_lineage_names"], 0), empty).alias("publisher"),
        F.coalesce(F.slice(F.transform(w["x_concepts"], lambda c: c["display_name"]), 1, 5), F.array().cast("array<string>")).alias("subjects"),
        F.coalesce(w["is_oa"], F.lit(False)).alias("is_open_access"),
    )


def read_openalex_authors(df: DataFrame, payload: str = "value") -> DataFrame:
    """Author records."""
    rows = _unwrap(df, payload, f"struct<results:array<{OPENALEX_AUTHOR}>>", "results")
    w, empty = F.col("w"), F.lit("")
    return rows.select(
        openalex_short(w["id"]).alias("author_id"),
        F.coalesce(w["display_name"], empty).alias("name"),
        F.coalesce(w["orcid"], empty).alias("orcid"),
        w["works_count"].alias("works_count"),
        w["cited_by_count"].alias("cited_by_count"),
        w["summary_stats"]["h_index"].alias("h_index"),
        F.coalesce(F.get(w["last_known_institutions"], 0)["display_name"], empty).alias("institution"),
    )
