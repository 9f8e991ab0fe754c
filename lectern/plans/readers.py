"""Queries of the payload readers: responses are made from the test tables, read, and held against the tables.

Each response is built in the shape of its source, with missing fields,
other types and odd forms at fixed places.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from lectern.plans.register import query
from lectern.sources import rankings, works

#: Author names of a paper and its first one, as the oracles have them.
PEOPLE = "array_join(transform(authors, a -> a.name), '; ') AS people"


def _table(spark, d, name: str):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _payload(spark, d, record: str, table: str, envelope: str):
    """One response a row: the record's JSON in its envelope."""
    head, tail = envelope.split("%")
    return _table(spark, d, table).selectExpr(f"concat('{head}', to_json({record}), '{tail}') AS value")


OPENALEX = """named_struct('id', concat('https://openalex.org/W', o_orderkey), 'title', if(o_orderkey % 11 = 0, null, concat('Order number ', o_orderkey)),
    'doi', if(o_orderkey % 5 = 0, null, concat('https://doi.org/10.5555/w', o_orderkey)), 'publication_year', year(o_orderdate),
    'type', element_at(array('article', 'preprint', 'posted-content', 'book', 'book-chapter', 'proceedings-article', 'proceedings', 'dissertation', 'dataset'), cast(o_orderkey % 9 + 1 AS INT)),
    'cited_by_count', o_custkey, 'authorships', transform(sequence(1, cast(o_orderkey % 13 + 1 AS INT)), i -> named_struct('author', named_struct('display_name', concat('Clerk ', i), 'id', concat('https://openalex.org/A', i)))),
    'primary_location', if(o_orderkey % 7 = 0, null, named_struct('source', named_struct('display_name', o_orderpriority, 'issn_l', lpad(cast(o_custkey AS STRING), 8, '0')))),
    'abstract_inverted_index', if(o_orderkey % 3 = 0, null, map('totals', array(2), 'of', array(1, 3), o_orderstatus, array(4), 'Sum', array(0))),
    'open_access', if(o_orderkey % 4 = 0, null, named_struct('is_oa', o_orderstatus = 'F', 'oa_url', concat('https://oa.example/', o_orderkey))),
    'referenced_works', transform(sequence(0, cast(o_orderkey % 3 AS INT)), i -> concat('https://openalex.org/W', i)))"""
OPENALEX_SQL = """SELECT 'W' || o_orderkey AS openalex_id, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'Order number ' || o_orderkey END AS title,
    CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '10.5555/w' || o_orderkey END AS doi, year(o_orderdate)::INTEGER AS year,
    ['peer_reviewed', 'preprint', 'preprint', 'book', 'book_chapter', 'conference', 'conference', 'thesis', 'unknown'][o_orderkey % 9 + 1] AS source_type, o_custkey AS cited_by_count,
    array_to_string(list_transform(range(1, least(10, o_orderkey % 13 + 1) + 1), lambda i: 'Clerk ' || i || '/A' || i), '; ') AS people,
    CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END AS journal,
    CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE substr(lpad(o_custkey::VARCHAR, 8, '0'), 1, 4) || '-' || substr(lpad(o_custkey::VARCHAR, 8, '0'), 5) END AS issn,
    CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Sum of totals of ' || o_orderstatus END AS abstract, {oa} AS is_open_access, {pdf} AS pdf_url, '{api}' AS source_api,
    array_to_string(list_transform(range(0, o_orderkey % 3 + 1), lambda i: 'W' || i), ',') AS cited FROM orders"""


def _openalex(papers):
    people = F.array_join(F.transform("authors", lambda a: F.concat(a["name"], F.lit("/"), a["openalex_id"])), "; ").alias("people")
    names = ["openalex_id", "title", "doi", "year", "source_type", "cited_by_count", people, "journal", "issn", "abstract", "is_open_access", "pdf_url", "source_api"]
    return papers.select(*names, F.array_join("references", ",").alias("cited"))


@query(OPENALEX_SQL.format(oa="o_orderkey % 4 <> 0 AND o_orderstatus = 'F'", pdf="NULL::VARCHAR", api="openalex").replace("NULL::VARCHAR AS", "'' AS"))
def read_openalex_works(spark, d):
    return _openalex(works.read_openalex(_payload(spark, d, OPENALEX, "orders", '{"results":[%],"meta":{"count":1}}')))


@query(OPENALEX_SQL.format(oa="true", pdf="CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'https://oa.example/' || o_orderkey END", api="scielo_via_openalex"))
def read_scielo_via_openalex(spark, d):
    return _openalex(works.read_scielo_via_openalex(_payload(spark, d, OPENALEX, "orders", '{"results":[%],"meta":{"count":1}}')))


CROSSREF = """named_struct('DOI', concat('10.5555/c', o_orderkey), 'title', if(o_orderkey % 10 = 0, null, array(concat('Ordered ', o_orderkey), 'subtitle')),
    'published-print', if(o_orderkey % 3 = 0, null, named_struct('date-parts', array(array(year(o_orderdate), 5)))),
    'published-online', if(o_orderkey % 6 = 0, null, named_struct('date-parts', array(array(year(o_orderdate) - 1)))),
    'author', array(named_struct('given', 'Ada', 'family', concat('Surname', o_custkey)), named_struct('given', cast(null AS STRING), 'family', 'Group'), named_struct('given', 'Solo', 'family', cast(null AS STRING))),
    'is-referenced-by-count', o_custkey, 'container-title', if(o_orderkey % 4 = 0, null, array(o_orderpriority)), 'ISSN', array(lpad(cast(o_custkey AS STRING), 8, '0'), '9999-9999'),
    'type', element_at(array('journal-article', 'posted-content', 'book', 'book-chapter', 'proceedings-article', 'proceedings', 'dissertation', 'report'), cast(o_orderkey % 8 + 1 AS INT)),
    'update-to', if(o_orderkey % 9 = 0, array(named_struct('type', if(o_orderstatus = 'F', 'retraction', 'correction'), 'DOI', concat('10.5555/r', o_orderkey))), null))"""


@query(
    """SELECT '10.5555/c' || o_orderkey AS doi, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'Ordered ' || o_orderkey END AS title,
    (CASE WHEN o_orderkey % 3 <> 0 THEN year(o_orderdate) WHEN o_orderkey % 6 <> 0 THEN year(o_orderdate) - 1 END)::INTEGER AS year,
    'Ada Surname' || o_custkey || '; Group; Solo' AS people, o_custkey AS cited_by_count, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END AS journal,
    substr(lpad(o_custkey::VARCHAR, 8, '0'), 1, 4) || '-' || substr(lpad(o_custkey::VARCHAR, 8, '0'), 5) AS issn,
    ['peer_reviewed', 'preprint', 'book', 'book_chapter', 'conference', 'conference', 'thesis', 'unknown'][o_orderkey % 8 + 1] AS source_type, 'crossref' AS source_api FROM orders"""
)
def read_crossref_items(spark, d):
    papers = works.read_crossref(_payload(spark, d, CROSSREF, "orders", '{"message":{"items":[%],"total-results":1}}'))
    return papers.select("doi", "title", "year", F.expr(PEOPLE), "cited_by_count", "journal", "issn", "source_type", "source_api")


@query(
    """SELECT '10.5555/c' || o_orderkey AS doi, o_orderkey % 9 = 0 AND o_orderstatus = 'F' AS retracted, false AS is_retraction_notice,
    CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'Ordered ' || o_orderkey END AS title, CASE WHEN o_orderkey % 9 = 0 THEN '10.5555/r' || o_orderkey ELSE '' END AS notices FROM orders"""
)
def read_crossref_retractions(spark, d):
    x = works.crossref_retractions(_payload(spark, d, CROSSREF, "orders", '{"message":%}'))
    return x.select("doi", "retracted", "is_retraction_notice", "title", F.array_join(F.transform("updates", lambda u: u["doi"]), ",").alias("notices"))


@query(
    """SELECT '10.5555/c' || o_orderkey AS doi, 'Ada Surname' || o_custkey || '; Group; Solo' AS people, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END AS journal FROM orders WHERE o_orderkey % 50 = 0"""
)
def get_crossref_by_doi(spark, d):
    papers = works.read_crossref(_payload(spark, d, CROSSREF, "orders", '{"message":{"items":[%],"total-results":1}}'))
    asked = _table(spark, d, "orders").where("o_orderkey % 50 = 0").selectExpr("concat('https://doi.org/10.5555/C', o_orderkey) AS asked")
    found = works.by_doi(papers, asked, "asked")
    return found.select("doi", F.expr(PEOPLE), "journal")


S2 = """concat('{"paperId":"', sha1(cast(cast(o_orderkey AS STRING) AS BINARY)), '","title":"Study ', o_orderkey, '","year":', year(o_orderdate), ',"authors":[{"name":"A', o_custkey, '"},{"name":"B"}],"citationCount":', o_custkey,
    ',"influentialCitationCount":', o_orderkey % 5, ',"journal":', CASE o_orderkey % 3 WHEN 0 THEN 'null' WHEN 1 THEN concat('{"name":"', o_orderpriority, '","volume":"1"}') ELSE concat('"', o_orderpriority, '"') END,
    ',"externalIds":', CASE WHEN o_orderkey % 4 = 0 THEN 'null' ELSE concat('{"DOI":"10.5555/s', o_orderkey, '","ArXiv":"2401.', lpad(cast(o_orderkey % 100000 AS STRING), 5, '0'), '"}') END,
    ',"tldr":', if(o_orderkey % 2 = 0, 'null', '{"text":"in short"}'), ',"openAccessPdf":', if(o_orderkey % 5 = 0, '{"url":"https://pdf.example/x"}', 'null'),
    ',"publicationTypes":', element_at(array('["JournalArticle","Book"]', '["Review","Conference"]', '["Book"]', 'null', '["Dataset"]'), cast(o_orderkey % 5 + 1 AS INT)), '}')"""


@query(
    """SELECT sha1(o_orderkey::VARCHAR) AS s2_id, 'Study ' || o_orderkey AS title, year(o_orderdate)::INTEGER AS year, 'A' || o_custkey || '; B' AS people, o_custkey AS cited_by_count, o_orderkey % 5 AS influential_citation_count,
    CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS journal, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '10.5555/s' || o_orderkey END AS doi,
    CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '2401.' || lpad((o_orderkey % 100000)::VARCHAR, 5, '0') END AS arxiv_id, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'in short' END AS tldr,
    CASE WHEN o_orderkey % 5 = 0 THEN 'https://pdf.example/x' ELSE '' END AS pdf_url, ['peer_reviewed', 'conference', 'book', 'unknown', 'unknown'][o_orderkey % 5 + 1] AS source_type FROM orders"""
)
def read_semantic_scholar_papers(spark, d):
    made = _table(spark, d, "orders").selectExpr(f"""concat('{{"data":[', {S2}, '],"total":1}}') AS value""")
    papers = works.read_semantic_scholar(made)
    return papers.select("s2_id", "title", "year", F.expr(PEOPLE), "cited_by_count", "influential_citation_count", "journal", "doi", "arxiv_id", "tldr", "pdf_url", "source_type")


ATOM = """concat('<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>all</title><entry><id>http://arxiv.org/abs/2402.', lpad(cast(p_partkey % 100000 AS STRING), 5, '0'), 'v', p_size % 3 + 1,
    '</id><title>On ', p_name, '\\n and more</title><summary> ', repeat(concat(p_type, ' '), 60), '</summary><published>', 2000 + p_size % 25, '-03-01T00:00:00Z</published><author><name>', p_brand, '</name></author>',
    if(p_size % 2 = 0, '<author><name>Second</name></author>', ''), '</entry></feed>')"""


@query(
    r"""SELECT '2402.' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') || 'v' || (p_size % 3 + 1) AS arxiv_id, 'On ' || p_name || '  and more' AS title, substr(trim(repeat(p_type || ' ', 60)), 1, 500) AS abstract, (2000 + p_size % 25)::INTEGER AS year,
    p_brand || CASE WHEN p_size % 2 = 0 THEN '; Second' ELSE '' END AS people, 'grey_literature' AS source_type, 'https://arxiv.org/pdf/2402.' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') || 'v' || (p_size % 3 + 1) AS pdf_url FROM part"""
)
def read_arxiv_feed(spark, d):
    papers = works.read_arxiv(_table(spark, d, "part").selectExpr(f"{ATOM} AS value"))
    return papers.select("arxiv_id", "title", "abstract", "year", F.expr(PEOPLE), "source_type", "pdf_url")


SCIELO = """if(s_suppkey % 7 = 0, '<html>busy</html>', concat('{"', if(s_suppkey % 5 = 0, 'results', 'docs'), '":[{"doi":"10.5555/q', s_suppkey, '","au":["', s_name, '"],"title":',
    if(s_suppkey % 2 = 0, concat('["Nota ', s_suppkey, '","Note"]'), concat('"Nota ', s_suppkey, '"')), ',"year_cluster":', if(s_suppkey % 3 = 0, '"s.d."', concat('["', 2000 + s_nationkey, '"]')),
    ',"journal_title":', if(s_suppkey % 4 = 0, concat('["Revista ', s_nationkey, '"]'), concat('"Revista ', s_nationkey, '"')), '}]}'))"""


@query(
    """SELECT 'Nota ' || s_suppkey AS title, '10.5555/q' || s_suppkey AS doi, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE (2000 + s_nationkey)::INTEGER END AS year, s_name AS people, 'Revista ' || s_nationkey AS journal,
    'peer_reviewed' AS source_type, 'scielo_direct' AS source_api, true AS is_open_access FROM supplier WHERE s_suppkey % 7 <> 0"""
)
def read_scielo_direct(spark, d):
    papers = works.read_scielo(_table(spark, d, "supplier").selectExpr(f"{SCIELO} AS value"))
    return papers.select("title", "doi", "year", F.expr(PEOPLE), "journal", "source_type", "source_api", "is_open_access")


UNPAYWALL = """named_struct('doi', concat('10.5555/u', p_partkey), 'title', p_name, 'oa_status', if(p_size % 4 = 0, null, 'gold'), 'is_oa', p_size % 4 <> 0, 'journal_name', p_brand,
    'best_oa_location', if(p_size % 4 = 0, null, named_struct('url', 'https://land.example/', 'url_for_pdf', if(p_size % 3 = 0, null, concat('https://pdf.example/', p_partkey)), 'version', 'publishedVersion', 'host_type', if(p_size % 2 = 0, 'publisher', null))))"""


@query(
    """SELECT '10.5555/u' || p_partkey AS doi, p_name AS title, CASE WHEN p_size % 4 = 0 THEN 'closed' ELSE 'gold' END AS oa_status, p_size % 4 <> 0 AS is_oa, p_brand AS journal, '' AS publisher,
    CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 3 = 0 THEN 'https://land.example/' ELSE 'https://pdf.example/' || p_partkey END AS pdf_url, CASE WHEN p_size % 4 <> 0 THEN 'publishedVersion' END AS version,
    CASE WHEN p_size % 4 <> 0 THEN 'unknown' END AS license, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 'publisher' ELSE 'unknown' END AS host_type FROM part"""
)
def read_unpaywall_records(spark, d):
    return works.read_unpaywall(_payload(spark, d, UNPAYWALL, "part", "%"))


JOURNALS = """named_struct('id', concat('https://openalex.org/S', s_suppkey), 'display_name', s_name, 'issn_l', if(s_suppkey % 6 = 0, null, '1234-5678'), 'issn', array('1234-5678', '8765-4321'), 'works_count', s_suppkey * 10, 'cited_by_count', s_suppkey * 100,
    'summary_stats', named_struct('h_index', s_nationkey), 'type', 'journal', 'host_organization_lineage_names', if(s_suppkey % 3 = 0, null, array(concat('House ', s_nationkey), 'Group')),
    'x_concepts', transform(sequence(1, cast(s_suppkey % 8 + 1 AS INT)), i -> named_struct('display_name', concat('c', i))), 'is_oa', s_nationkey % 2 = 0)"""


@query(
    """SELECT 'S' || s_suppkey AS journal_id, s_name AS name, CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE '1234-5678' END AS issn_l, '1234-5678,8765-4321' AS issns, s_suppkey * 10 AS works_count, s_suppkey * 100 AS cited_by_count, s_nationkey AS h_index,
    CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'House ' || s_nationkey END AS publisher, array_to_string(list_transform(range(1, least(5, s_suppkey % 8 + 1) + 1), lambda i: 'c' || i), ',') AS subjects, s_nationkey % 2 = 0 AS is_open_access FROM supplier"""
)
def read_journal_records(spark, d):
    x = works.read_openalex_sources(_payload(spark, d, JOURNALS, "supplier", '{"results":[%]}'))
    return x.select("journal_id", "name", "issn_l", F.array_join("issns", ",").alias("issns"), "works_count", "cited_by_count", "h_index", "publisher", F.array_join("subjects", ",").alias("subjects"), "is_open_access")


def _workbook(rows: list[list[str]]) -> bytes:
    """The least that a workbook consists of: shared strings and one sheet."""
    strings = list(dict.fromkeys(x for r in rows for x in r if x))
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = "".join("<row>" + "".join(f'<c r="{"ABCD"[i]}{n + 1}" t="s"><v>{strings.index(x)}</v></c>' for i, x in enumerate(r) if x) + "</row>" for n, r in enumerate(rows))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {space}>" + "".join(f"<si><t>{x}</t></si>" for x in strings) + "</sst>")
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{sheet}</sheetData></worksheet>")
    return held.getvalue()


@query(
    """WITH x AS (SELECT s_suppkey // 2 AS k, s_suppkey, s_name, s_nationkey FROM supplier)
SELECT substr(lpad(k::VARCHAR, 8, '0'), 1, 4) || '-' || substr(lpad(k::VARCHAR, 8, '0'), 5) AS issn, arg_max(CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_name END, s_suppkey) AS title,
    arg_max(['A1', 'A2', 'B1', 'C'][s_nationkey % 4 + 1], s_suppkey) AS classification, arg_max('Area ' || s_nationkey, s_suppkey) AS area FROM x GROUP BY k"""
)
def read_qualis_workbook(spark, d):
    """One workbook a pair of suppliers; the later line of an ISSN counts."""
    grade = "element_at(array('A1', 'A2', 'B1', 'C'), cast(s_nationkey % 4 + 1 AS INT)) AS grade"
    rows = _table(spark, d, "supplier").selectExpr("s_suppkey div 2 AS k", "s_suppkey", "lpad(cast(s_suppkey div 2 AS STRING), 8, '0') AS issn", "if(s_suppkey % 5 = 0, '', s_name) AS title", grade, "concat('Area ', s_nationkey) AS area")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        lines = pdf.sort_values("s_suppkey")[["issn", "title", "area", "grade"]].to_numpy().tolist()
        return pd.DataFrame({"content": [_workbook([["ISSN", "Título", "Área de Avaliação", "Estrato"], *lines])]})

    books = rows.groupBy("k").applyInPandas(build, "content binary")
    return rankings.qualis_index(rankings.qualis_rows(books), "pos").select("issn", "title", "classification", "area")
