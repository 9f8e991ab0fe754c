import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.schema import PAPER
from lectern.settings import Settings
from lectern.sources import rankings, snapshots, works

WORK = {
    "id": "https://openalex.org/W70331",
    "title": "Soil moisture and frost",
    "doi": "https://doi.org/10.5555/SOIL.7",
    "publication_year": 2017,
    "type": "book-chapter",
    "cited_by_count": 8,
    "authorships": [{"author": {"display_name": "Ilse Maar", "id": "https://openalex.org/A9051"}}, {"author": {"display_name": "T. Okoro", "id": None}}, {"author": {"display_name": None, "id": "https://openalex.org/A88"}}],
    "primary_location": {"source": {"display_name": "Cold Ground Letters", "issn_l": "24150987"}},
    "abstract_inverted_index": {"ground;": [3], "Frost": [4, 0], "melts": [5], "lifts": [1], "wet": [2]},
    "open_access": {"is_oa": False, "oa_url": "https://x.example/y.pdf"},
    "referenced_works": ["https://openalex.org/W310", "https://openalex.org/W4"],
}


def payloads(spark, *values):
    return spark.createDataFrame([(v if isinstance(v, str) else json.dumps(v),) for v in values], "value string")


def test_openalex(spark):
    bare = {"id": "https://openalex.org/W9", "type": "preprint", "primary_location": None}
    df = works.read_openalex(payloads(spark, {"results": [WORK, bare], "meta": {"count": 2}}, "not json"))
    assert df.columns == list(PAPER)
    one, two = df.orderBy("openalex_id").collect()
    assert (one.year, one.cited_by_count, one.source_type, one.openalex_id) == (2017, 8, "book_chapter", "W70331")
    assert (one.doi, one.issn, one.abstract) == ("10.5555/SOIL.7", "2415-0987", "Frost lifts wet ground; Frost melts")
    assert [(a.name, a.openalex_id) for a in one.authors] == [("Ilse Maar", "A9051"), ("T. Okoro", ""), ("", "A88")]
    assert one.references == ["W310", "W4"] and not one.is_open_access
    assert (two.title, two.journal, two.source_type, two.authors, two.references, two.year) == ("", "", "preprint", [], [], None)


def test_scielo_via_openalex(spark):
    r = works.read_scielo_via_openalex(payloads(spark, {"results": [WORK]})).first()
    assert (r.source_api, r.is_open_access, r.pdf_url) == ("scielo_via_openalex", True, "https://x.example/y.pdf")


def test_crossref(spark):
    item = {
        "DOI": "10.1/x",
        "title": ["T"],
        "published-print": {"date-parts": [[2023, 5]]},
        "author": [{"given": "Jo", "family": "Doe"}, {"family": "Solo"}],
        "is-referenced-by-count": 7,
        "container-title": ["J"],
        "ISSN": ["1234-5678"],
        "type": "journal-article",
    }
    online = {"DOI": "10.1/y", "published-online": {"date-parts": [[2020]]}, "type": "posted-content"}
    undated = {"DOI": "10.1/z", "title": None}
    rows = works.read_crossref(payloads(spark, {"message": {"items": [item, online, undated], "total-results": 3}})).orderBy("doi").collect()
    assert [(r.title, r.year, r.source_type) for r in rows] == [("T", 2023, "peer_reviewed"), ("", 2020, "preprint"), ("", None, "unknown")]
    assert [a.name for a in rows[0].authors] == ["Jo Doe", "Solo"]


def test_retraction(spark):
    r = works.crossref_retractions(payloads(spark, {"message": {"DOI": "10.1/x", "title": ["T"], "type": "journal-article", "update-to": [{"type": "retraction", "DOI": "10.1/r"}]}})).first()
    assert r.retracted and not r.is_retraction_notice and [u.doi for u in r.updates] == ["10.1/r"]


def test_semantic_scholar(spark):
    p = {"paperId": "a" * 40, "title": "T", "year": 2021, "journal": {"name": "J"}, "publicationTypes": ["Review", "Conference"], "externalIds": {"DOI": "10.1/x", "ArXiv": "2101.00001"}, "tldr": {"text": "short"}, "openAccessPdf": {"url": "u"}}
    q = {"paperId": "b" * 40, "title": "U", "journal": "Plain name", "externalIds": None}
    one, two = works.read_semantic_scholar(payloads(spark, {"data": [p, q], "total": 2})).orderBy("title").collect()
    assert (one.journal, one.source_type, one.tldr, one.pdf_url, one.arxiv_id) == ("J", "conference", "short", "u", "2101.00001")
    assert (two.journal, two.source_type, two.doi) == ("Plain name", "unknown", "")


def test_s2_edges(spark):
    cite = {"isInfluential": True, "intents": ["method"], "contexts": ["1", "2", "3", "4"], "citingPaper": {"title": "C", "authors": [{"name": str(i)} for i in range(9)], "externalIds": {"DOI": "10.1/c"}}}
    untitled = {"citingPaper": {"title": None}}
    (r,) = works.read_s2_citations(payloads(spark, {"data": [cite, untitled]})).collect()
    assert r.is_influential and len(r.authors) == 5 and r.contexts == ["1", "2", "3"] and r.citation_count == 0
    ref = {"citedPaper": {"title": "D", "externalIds": {"DOI": "10.1/D"}}, "contexts": None}
    (e,) = works.read_s2_references(payloads(spark, {"data": [ref]})).collect()
    assert (e.rank, e.cited_doi, e.contexts) == (0, "10.1/D", [])


def test_scielo_direct(spark):
    docs = {"docs": [{"title": ["A", "B"], "doi": "10.1/s", "year_cluster": ["2019"], "au": ["X"], "journal_title": "J"}, {"title": "C", "year_cluster": "n.d."}]}
    one, two = works.read_scielo(payloads(spark, docs, "<html>")).orderBy("title").collect()
    assert (one.title, one.year, one.journal, one.is_open_access) == ("A", 2019, "J", True) and (two.title, two.year) == ("C", None)


def test_arxiv(spark):
    feed = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/2401.12345v1</id>
    <title>Deep\n Learning</title><summary> An abstract. </summary><published>2024-01-20T00:00:00Z</published><author><name>A</name></author><author><name>B</name></author></entry></feed>"""
    r = works.read_arxiv(payloads(spark, feed)).first()
    assert (r.arxiv_id, r.year, len(r.authors), r.source_type, r.pdf_url) == ("2401.12345v1", 2024, 2, "grey_literature", "https://arxiv.org/pdf/2401.12345v1")
    assert works.read_arxiv(payloads(spark, '<feed xmlns="http://www.w3.org/2005/Atom"></feed>')).count() == 0


def test_unpaywall_and_tavily(spark):
    one = {"doi": "10.1/x", "is_oa": True, "oa_status": "gold", "best_oa_location": {"url": "u", "license": None, "host_type": "publisher"}}
    rows = works.read_unpaywall(payloads(spark, one, {"doi": "10.1/y"})).orderBy("doi").collect()
    assert (rows[0].pdf_url, rows[0].license, rows[0].version) == ("u", "unknown", "unknown")
    assert (rows[1].oa_status, rows[1].is_oa, rows[1].pdf_url) == ("closed", False, None)
    t = works.read_tavily(payloads(spark, {"results": [{"title": "T", "content": "c" * 400}]})).first()
    assert len(t.content) == 300 and t.source_type == "web_search"


def test_sjr_csv(spark, tmp_path):
    path = tmp_path / "sjr.csv"
    path.write_text("Title;Issn;SJR;SJR Best Quartile;H index;Country;Areas;Type;Publisher\nAcademy of Management Journal;00014273, 19487169;15.123;Q1;200;US;Business;journal;X\nJournal of Finance;00221082;12.456;Q1;180;US;Finance;journal;Y\n;;;;;;;;\n")
    raw = rankings.read_sjr(spark, str(path))
    assert {r.issn for r in rankings.sjr_index(raw, "pos").collect()} == {"0001-4273", "1948-7169", "0022-1082"}
    assert {(r.name, r.issn) for r in rankings.sjr_names(raw, "pos").collect()} == {("academy of management journal", "0001-4273"), ("journal of finance", "0022-1082")}


def test_jql_csv(spark, tmp_path):
    path = tmp_path / "jql.csv"
    path.write_text("issn,journal,subject,ft2016,ajg_abs2024,abdc2025\n0001-4273,Academy of Management Journal,Management,Y,4*,A*\n0001-4273,Later line,Management,,3,\n")
    (r,) = rankings.jql_index(rankings.read_jql(spark, str(path)), "pos").collect()
    assert (r.title, r.abs, r.ft50 or "") == ("Later line", "3", "")


def test_qualis_xlsx(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda ref, i: f'<c r="{ref}" t="s"><v>{i}</v></c>'
    strings = ["ISSN", "Título", "Área de Avaliação", "Estrato", "0001-4273", "AMJ", "Adm", "A1", "A2"]
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        rows = [[cell("A1", 0), cell("B1", 1), cell("C1", 2), cell("D1", 3)], [cell("A2", 4), cell("B2", 5), cell("C2", 6), cell("D2", 7)], [cell("A3", 4), cell("D3", 8)]]
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>" + "".join(f"<row>{''.join(r)}</row>" for r in rows) + "</sheetData></worksheet>")
    (tmp_path / "q.xlsx").write_bytes(raw.getvalue())
    (r,) = rankings.qualis_index(rankings.read_qualis_xlsx(spark, str(tmp_path)), "pos").collect()
    assert (r.issn, r.classification, r.title) == ("0001-4273", "A2", "")


def test_jql_spans(spark):
    rows = [
        (8, 10.0, 100.0, "ISSN"),
        (8, 10.0, 120.0, "0001-4273 Academy of"),
        (8, 60.0, 121.0, "Management"),
        (8, 240.0, 120.0, "Org"),
        (8, 411.0, 122.9, "4*"),
        (8, 60.0, 130.0, "Journal"),
        (8, 60.0, 140.0, "continues"),
        (8, 411.0, 141.0, "9"),
        (9, 5.0, 20.0, "0022-108X"),
        (9, 58.0, 20.0, "Finance"),
        (9, 520.0, 20.0, "A"),
        (9, 5.0, 400.0, "9 of 23"),
    ]
    got = rankings.jql_from_spans(spark.createDataFrame(rows, "page int, x double, y double, text string")).orderBy("pos").collect()
    assert [(r.issn, r.journal, r.subject, r.ajg_abs2024, r.abdc2025) for r in got] == [("0001-4273", "Academy of Management continues", "Org", "4*", ""), ("0022-108X", "Finance", "", "", "A")]


def test_rows_are_grouped_by_their_first_span(spark):
    rows = [(1, float(i), 10.0 + 2 * i, str(i)) for i in range(5)]
    got = rankings.row_groups(spark.createDataFrame(rows, "page int, x double, y double, text string")).orderBy("at").collect()
    assert [r.row for r in got] == [0, 0, 1, 1, 2]


def test_harvest_source(spark, tmp_path):
    for name, n in (("openalex", 2), ("arxiv", 1)):
        (tmp_path / name).mkdir()
        for i in range(n):
            (tmp_path / name / f"{i}.json").write_text(json.dumps({"results": [WORK]}))
    spark.dataSource.register(snapshots.Harvest)
    df = spark.read.format("harvest").option("path", str(tmp_path)).load()
    assert {(r.source, r.n) for r in df.groupBy("source").agg(F.count("*").alias("n")).collect()} == {("openalex", 2), ("arxiv", 1)}
    assert df.rdd.getNumPartitions() == 2 and spark.read.format("harvest").option("path", str(tmp_path)).option("files", "1").load().rdd.getNumPartitions() == 3
    one = spark.read.format("harvest").option("path", str(tmp_path)).option("source", "openalex").load()
    assert works.read_openalex(one).count() == 2


def test_fields_of_study(spark):
    papers = [{"paperId": str(i), "title": f"P{i}", "fieldsOfStudy": f} for i, f in enumerate((["Geology"], ["Law", "History"], None, []))]
    got = works.read_semantic_scholar(payloads(spark, {"data": papers}), fields=["History", "Geology"])
    assert sorted(r.title for r in got.collect()) == ["P0", "P1"]
    assert works.read_semantic_scholar(payloads(spark, {"data": papers})).count() == 4


def test_pace_and_harvest(tmp_path):
    now, slept = [0.0], []
    sleep = lambda s: (slept.append(s), now.__setitem__(0, now[0] + s))
    pace = snapshots.Pace("arxiv", lambda: now[0], sleep)
    for _ in range(3):
        pace.wait()
    assert slept == pytest.approx([3.0, 3.0])
    fast = snapshots.Pace("openalex", lambda: 0.0, slept.append)
    slept.clear()
    for _ in range(10):
        fast.wait()
    assert not slept
    fast.wait()
    assert slept == pytest.approx([0.1])
    calls = {"a": lambda: (200, {}, "body"), "b": lambda: (404, {}, "gone")}
    assert snapshots.harvest("crossref", calls, str(tmp_path), pace=snapshots.Pace("crossref", lambda: 0.0, slept.append)) == ["b"]
    assert [p.name for p in (tmp_path / "crossref").iterdir()] == ["a.json"] and (tmp_path / "crossref" / "a.json").read_text() == "body"


def test_pdfs_are_saved_or_refused(tmp_path):
    path = str(tmp_path / "new" / "a.bin")
    got = snapshots.download_pdf("u", path, lambda u: (200, {"Content-Type": "application/pdf"}, b"%PDF" * (1 << 18)))
    assert got == {"saved_to": path, "size_mb": 1.0, "url": "u"} and (tmp_path / "new" / "a.bin").read_bytes()[:4] == b"%PDF"
    assert "error" in snapshots.download_pdf("u", path + "x", lambda u: (200, {"content-type": "text/html"}, b"<html>"))
    assert snapshots.download_pdf("u", path + ".pdf", lambda u: (200, {}, b"%PDF"))["size_mb"] == 0.0
    assert snapshots.download_pdf("u", path, lambda u: (404, {}, b""))["error"] == "HTTP 404"


def test_guides(spark, tmp_path):
    (tmp_path / "one.md").write_text("# One\n\ntext\n")
    (tmp_path / "two.txt").write_text("no")
    assert [tuple(r) for r in snapshots.guides(spark, str(tmp_path)).collect()] == [("one", "# One\n\ntext\n")]


def test_settings():
    s = Settings.of({"POLITE_EMAIL": " ann@uni.edu ", "LOG_LEVEL": "debug", "CACHE_ENABLED": "false", "OTHER": "x"})
    assert (s.polite_email, s.log_level, s.cache_enabled, s.user_agent) == ("ann@uni.edu", "DEBUG", False, "lectern (mailto:ann@uni.edu)")
    for wrong in ({}, {"POLITE_EMAIL": "nobody"}, {"POLITE_EMAIL": "ann@example.com"}, {"POLITE_EMAIL": "NoReply@uni.edu"}, {"POLITE_EMAIL": "a@b.c", "LOG_LEVEL": "loud"}, {"POLITE_EMAIL": "a@b.c", "LOG_FORMAT": "xml"}):
        with pytest.raises(ValueError):
            Settings.of(wrong)


def test_a_folder_of_files_is_read_in_order(spark, tmp_path):
    for i in (1, 0):
        (tmp_path / f"{i}.csv").write_text("issn,journal,subject,ajg_abs2024\n" + "".join(f"0001-4273,J{i}{n},S,{i}\n" for n in range(3)))
    raw = rankings.read_jql(spark, str(tmp_path))
    assert [(r.pos, r.journal) for r in raw.orderBy("pos").collect()] == [(0, "J00"), (1, "J01"), (2, "J02"), (3, "J10"), (4, "J11"), (5, "J12")]
    assert [r.title for r in rankings.jql_index(raw, "pos").collect()] == ["J12"]


def test_jql_is_written_as_it_is_read(spark, tmp_path):
    raw = spark.createDataFrame([(0, "0001-4273", "A, \"quoted\" journal", "4*"), (1, "0022-1082", "B", "")], "pos long, issn string, journal string, ajg_abs2024 string")
    rankings.write_jql(raw, str(tmp_path / "out"))
    back = rankings.read_jql(spark, str(tmp_path / "out"))
    assert {(r.issn, r.title, r.abs) for r in rankings.jql_index(back, "pos").collect()} == {("0001-4273", "A, \"quoted\" journal", "4*"), ("0022-1082", "B", "")}


def test_retries():
    waits, answers = [], iter([(429, {"Retry-After": "7"}, ""), (503, {}, ""), (200, {}, "body")])
    assert snapshots.with_retries(lambda: next(answers), waits.append, jitter=0.0) == "body" and waits == [7.0, 2.0]
    with pytest.raises(RuntimeError, match="404"):
        snapshots.with_retries(lambda: (404, {}, ""), waits.append)
    with pytest.raises(RuntimeError, match="500"):
        snapshots.with_retries(lambda: (500, {}, ""), waits.append)


def test_journal_and_author_records(spark):
    record = {"id": "https://openalex.org/S1", "display_name": "J", "issn_l": "0001-4273", "issn": ["0001-4273"], "summary_stats": {"h_index": 9}, "host_organization_lineage_names": ["P", "Q"], "x_concepts": [{"display_name": str(i)} for i in range(8)]}
    r, bare = works.read_openalex_sources(payloads(spark, {"results": [record, {"id": "S2"}]})).orderBy("journal_id").collect()
    assert (r.journal_id, r.publisher, r.subjects, r.h_index) == ("S1", "P", ["0", "1", "2", "3", "4"], 9)
    assert (bare.publisher, bare.subjects, bare.issns, bare.is_open_access) == ("", [], [], False)
    a = works.read_openalex_authors(payloads(spark, {"results": [{"id": "https://openalex.org/A1", "display_name": "Ann", "last_known_institutions": [{"display_name": "U"}]}]})).first()
    assert (a.author_id, a.name, a.institution, a.h_index) == ("A1", "Ann", "U", None)


def test_snapshots_are_rewritten(spark, tmp_path):
    path = tmp_path / "jql.csv"
    path.write_text("issn,journal,subject,ajg_abs2024\n0001-4273,AMJ,Management,4*\n")
    folder = str(tmp_path / "snap")
    assert rankings.update_snapshots(spark, folder, jql=str(path)) == ["jql", "jql_names"]
    path.write_text("issn,journal,subject,ajg_abs2024\n0001-4273,AMJ,Management,3\n")
    rankings.update_snapshots(spark, folder, jql=str(path))
    assert [r.abs for r in spark.read.parquet(f"{folder}/jql").collect()] == ["3"]


@pytest.mark.parametrize("gap", [3.0, 1.0, 0.3])
def test_row_groups_equal_the_fold(spark, gap):
    rng = random.Random(4)
    rows = [(page, rng.choice([1.0, 2.0, 3.5]), round(rng.uniform(-99, -80 + 20 * page), 1), rng.choice(["a", "b ", " "])) for page in (1, 2) for _ in range(400)]
    got = rankings.row_groups(spark.createDataFrame(rows, "page int, x double, y double, text string"), gap).collect()
    want = []
    for page in (1, 2):
        anchor, row = None, -1
        spans = sorted((round(y), x, y, t.strip()) for p, x, y, t in rows if p == page and t.strip())
        for at, (_, x, y, t) in enumerate(spans):
            if anchor is None or abs(y - anchor) > gap:
                anchor, row = y, row + 1
            want.append((page, row, at, x, t))
    assert sorted(tuple(r) for r in got) == want
