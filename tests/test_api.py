import json

import pytest
from pyspark.sql import functions as F

from lectern.api import Library, json_records
from lectern.operators import journals
from lectern.schema import as_paper
from lectern.sources import rankings


@pytest.fixture(scope="module")
def lib(spark):
    raw = [
        ("Deep learning for proteins", "10.1/a", 2020, "openalex", "W1", "Ann", 50, "0001-4273"),
        ("Deep learning for protein", "", 2020, "openalex", "W2", "Bob", 5, "0001-4273"),
        ("Deep learning for proteins", "10.1/A", 2020, "crossref", "", "Ann", 50, ""),
        ("Graph learning", "10.1/b", 2019, "openalex", "W3", "Ann", 20, "0022-1082"),
        ("Old deep learning", "", 1999, "arxiv", "", "Cy", 0, ""),
        ("Citing work one", "10.1/c", 2021, "openalex", "W4", "Dan", 1, ""),
        ("Citing work two", "10.1/d", 2022, "openalex", "W5", "Eve", 2, ""),
    ]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(raw)], "t string, d string, y int, s string, o string, a string, c int, i string, n int")
    author = "array(struct(a as name, '' as openalex_id, '' as orcid, cast(null as int) as h_index, cast(null as int) as works_count, cast(null as int) as cited_by_count))"
    arxiv = F.when(F.col("s") == "arxiv", "1999.00001v2").otherwise("")
    papers = df.select(*as_paper(title=F.col("t"), doi=F.col("d"), year=F.col("y"), source_api=F.col("s"), openalex_id=F.col("o"), arxiv_id=arxiv, authors=F.expr(author), cited_by_count=F.col("c"), issn=F.col("i")))
    edges = spark.createDataFrame(
        [("W4", "W1", 1, True, ["method"], ["x", "y", "z", "w"]), ("W4", "W3", 2, False, [], []), ("W5", "W1", 1, False, [], []), ("W5", "W3", 2, False, [], []), ("W5", "W9", 3, False, [], [])],
        "citing string, cited string, ord int, is_influential boolean, intents array<string>, contexts array<string>",
    )
    sjr_raw = spark.createDataFrame([(0, "Academy Journal", "00014273", "15,1", "Q1", "Business"), (1, "Journal of Finance", "00221082", "12.4", "Q2", "Finance")], "pos int, Title string, Issn string, SJR string, `SJR Best Quartile` string, Areas string")
    qualis = rankings.qualis_index(spark.createDataFrame([(0, "00014273", "A", "A1")], "pos int, issn string, titulo string, estrato string"), "pos")
    jql_raw = spark.createDataFrame([(0, "0022-1082", "Journal of Finance", "4*")], "pos int, issn string, journal string, ajg_abs2024 string")
    names = journals.name_index(rankings.sjr_names(sjr_raw, "pos"), rankings.jql_names(jql_raw, "pos"))
    records = spark.createDataFrame([(1, "Academy Journal", "0001-4273", ["0001-4273"])], "journal_id int, name string, issn_l string, issns array<string>")
    retracted = spark.createDataFrame([("10.1/b", True)], "doi string, retracted boolean")
    oa = spark.createDataFrame([("10.1/a", "gold", True, "u")], "doi string, oa_status string, is_oa boolean, pdf_url string")
    return Library(spark, papers, edges, rankings.sjr_index(sjr_raw, "pos"), qualis, rankings.jql_index(jql_raw, "pos"), names, records, retracted, oa)


def test_search_resolves_entities(lib):
    got = lib.search_papers("deep learning", "openalex,crossref,arxiv", year_from=2015).collect()
    assert [(r.title, r.source_api) for r in got] == [("Deep learning for proteins", "openalex"), ("Old deep learning", "arxiv")]


def test_search_summary(lib):
    r = lib.search_summary("deep learning", "openalex,crossref,arxiv,nowhere", year_from=2015, per_page=1).first()
    assert (r.total, r.returned, r.duplicates_removed, r.sources_queried) == (4, 2, 1, ["openalex", "crossref", "arxiv"])
    assert r.per_source == {"openalex": 1, "crossref": 1, "arxiv": 1}


def test_search_journal(lib):
    assert {r.openalex_id for r in lib.search_journal_papers("00014273").collect()} == {"W1", "W2"}


@pytest.mark.parametrize("ident,title", [("https://doi.org/10.1/B", "Graph learning"), ("https://openalex.org/W3", "Graph learning"), ("arXiv:1999.00001", "Old deep learning"), ("nothing", None)])
def test_get_paper(lib, ident, title):
    assert [r.title for r in lib.get_paper(ident).collect()] == ([title] if title else [])


def test_get_author(lib):
    assert [r.title for r in lib.get_author("ann", 2).orderBy("rank").collect()][0] == "Deep learning for proteins"


def test_journals(lib):
    r = lib.get_journal_info("0001-4273").first()
    assert (r.sjr, r.qualis, r.jql) == ("Q1", "A1", "N/A")
    assert [(lib.rank_journal(q).first().match_kind, lib.rank_journal(q).first().best_tier) for q in ("0001-4273", "journal of finance", "Journal of Finanse", "zz")] == [("issn", "A"), ("name", "S"), ("similar", "S"), ("none", "unknown")]
    assert [r.issn for r in lib.top_journals_for_field("fin").collect()] == ["0022-1082"]


def test_citations(lib):
    assert [r.work_id for r in lib.get_citations("10.1/a").orderBy("rank").collect()] == ["W5", "W4"]
    assert [r.work_id for r in lib.get_citations("10.1/d", "references").orderBy("rank").collect()] == ["W1", "W3"]
    got = lib.get_influential_citations("10.1/a").collect()
    assert [(r.is_influential, len(r.contexts)) for r in got] == [(False, 0), (True, 3)]
    there = lib.get_citation_context("10.1/c", "10.1/a").first()
    assert there.found and there.intents == ["method"] and there.cited_title == "Deep learning for proteins"
    gone = lib.get_citation_context("10.1/a", "10.1/c").collect()
    assert [(r.found, r.intents) for r in gone] == [(False, None)]


def test_network(lib):
    nodes, edges = lib.build_citation_network("10.1/d,10.1/zzz", 1)
    assert {(r.work_id, r.level) for r in nodes.collect()} == {("W5", 0), ("W1", 1), ("W3", 1)}
    assert {r.cited for r in edges.collect()} == {"W1", "W3", "W9"}
    assert {(r.work_id, r.title) for r in nodes.collect()} >= {("W3", "Graph learning")}
    assert lib.build_citation_network("10.1/d", 1, most_edges=2)[1].count() == 2
    assert tuple(lib.citation_network_counts("10.1/d", 1).first()) == (3, 3)


def test_co_citations(lib):
    assert [(r.paper_a, r.paper_b, r.co_citations) for r in lib.find_co_citation_clusters("10.1/a, 10.1/b").collect()] == [("W1", "W3", 2)]
    with pytest.raises(ValueError):
        lib.find_co_citation_clusters("10.1/a")


def test_verification(lib):
    assert lib.verify_citation("Ann", 2020, "deep learning for proteins").first().confidence == "high"
    got = lib.batch_verify_references(json.dumps([{"title": "graph learning", "year": 2019}, {"title": "made up entirely"}])).orderBy("ref_id").collect()
    assert [(r.verified, r.doi, r.matched_title) for r in got] == [(True, "10.1/b", "Graph learning"), (False, "", "")]
    # the author finds the work, the title alone is tested
    one = lib.verify_citation("Ann", 2019, "proteins of the deep").first()
    assert (one.verified, one.confidence, one.doi) == (True, "medium", "10.1/b")
    assert not lib.batch_verify_references(json.dumps([{"author": "Ann", "title": "proteins of the deep", "year": 2019}])).first().verified
    assert lib.check_retraction("https://doi.org/10.1/B").first().retracted
    assert lib.check_open_access("10.1/A").first().oa_status == "gold" and lib.check_open_access("10.9/z").first().oa_status == "closed"


def test_trends(lib):
    got = {(r.keyword, r.year): r["count"] for r in lib.get_keyword_trends("deep learning, graph", 2019, 2020).collect()}
    assert got == {("deep learning", 2019): 0, ("deep learning", 2020): 3, ("graph", 2019): 1, ("graph", 2020): 0}


def test_json_leaves_defaults_out(lib):
    got = json.loads(json_records(lib.get_paper("10.1/b").drop("work_id")).first().value)
    assert got["doi"] == "10.1/b" and "abstract" not in got and "is_open_access" not in got
