"""Registered queries of the library and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import identifiers, ranking, texts
from lectern.operators import cache, citations, curation, dedup, fulltext, journals, meta, search, verify
from lectern.plans.adapters import adapter, ctes
from lectern.plans.register import query
from lectern.sources import rankings

cites, works, papers, refs = adapter("cites"), adapter("works"), adapter("papers"), adapter("refs")
cache_log = adapter("cache_log")


def sjr(spark, d):
    return rankings.sjr_index(adapter("sjr_raw")(spark, d), "pos")


def names(spark, d):
    return journals.name_index(rankings.sjr_names(adapter("sjr_raw")(spark, d), "pos"), rankings.jql_names(adapter("jql_raw")(spark, d), "pos"))


def qualis(spark, d):
    return rankings.qualis_index(adapter("qualis_raw")(spark, d), "pos")


def jql(spark, d):
    return rankings.jql_index(adapter("jql_raw")(spark, d), "pos")


# --- SQL building blocks ---------------------------------------------------

NORM = "CASE WHEN length(upper(trim({0}))) = 8 AND NOT contains({0}, '-') THEN substr(upper(trim({0})), 1, 4) || '-' || substr(upper(trim({0})), 5, 4) ELSE upper(trim({0})) END"


def norm(x: str) -> str:
    return NORM.format(x)


INDEXES = (
    ctes("sjr_raw", "qualis_raw", "jql_raw")
    + f""",
sjr_x AS (SELECT *, {norm('raw')} AS issn FROM (SELECT pos, Title, SJR, "SJR Best Quartile" AS quartile, Areas, unnest(string_split(Issn, ',')) AS raw, unnest(range(0, len(string_split(Issn, ',')))) AS spot FROM sjr_raw)),
sjr AS (SELECT issn, trim(Title) AS title, SJR AS sjr_score, quartile, Areas AS area, pos FROM sjr_x QUALIFY row_number() OVER (PARTITION BY issn ORDER BY pos DESC, spot DESC) = 1),
qualis AS (SELECT {norm('issn')} AS issn, titulo AS title, estrato AS classification, area, pos FROM qualis_raw QUALIFY row_number() OVER (PARTITION BY {norm('issn')} ORDER BY pos DESC) = 1),
jql AS (SELECT {norm('issn')} AS issn, journal AS title, subject, ajg_abs2024 AS abs, pos FROM jql_raw QUALIFY row_number() OVER (PARTITION BY {norm('issn')} ORDER BY pos DESC) = 1)"""
)


def tier_sql(quartile: str, classification: str, rating: str) -> str:
    """Best tier as text."""
    q = f"CASE {quartile} WHEN 'Q1' THEN 2 WHEN 'Q2' THEN 3 WHEN 'Q3' THEN 4 ELSE CASE WHEN coalesce({quartile}, '') = '' THEN NULL ELSE 5 END END"
    c = f"CASE WHEN coalesce({classification}, '') = '' THEN NULL WHEN {classification} IN ('A1', 'A2') THEN 2 WHEN {classification} IN ('A3', 'A4') THEN 3 WHEN {classification} IN ('B1', 'B2') THEN 4 ELSE 5 END"
    a = f"CASE {rating} WHEN '4*' THEN 1 WHEN '4' THEN 2 WHEN '3' THEN 3 WHEN '2' THEN 4 ELSE CASE WHEN coalesce({rating}, '') = '' THEN NULL ELSE 5 END END"
    return f"coalesce(['S', 'A', 'B', 'C', 'D'][least({q}, {c}, {a})], 'unknown')"


METRICS = (
    INDEXES
    + f""",
metrics AS (SELECT issn, coalesce(nullif(s.title, ''), nullif(j.title, ''), nullif(q.title, ''), '') AS title, quartile, classification, abs,
    {tier_sql('quartile', 'classification', 'abs')} AS best_tier
    FROM sjr s FULL JOIN qualis q USING (issn) FULL JOIN jql j USING (issn)),
names AS (SELECT lower(trim(Title)) AS name, arg_max({norm("split_part(Issn, ',', 1)")}, pos) AS issn, min(pos) AS first_pos, 0 AS system FROM sjr_raw GROUP BY 1
    UNION ALL SELECT lower(trim(journal)), arg_max({norm('issn')}, pos), min(pos), 1 FROM jql_raw GROUP BY 1)"""
)

SCORE = "coalesce(try_cast(replace(sjr_score, ',', '.') AS DOUBLE), 0)"


def lcs_sql(a: str, b: str) -> str:
    """Longest common subsequence, row by row."""
    row = f"list_reduce(list_concat([[0::BIGINT]], list_transform(range(1, length({b}) + 1), lambda j: [j])), lambda nr, jj: list_append(nr, CASE WHEN unicode({b}[jj[1]]) = ch[1] THEN row[jj[1]] + 1 ELSE greatest(row[jj[1] + 1], nr[-1]) END))"
    return f"list_reduce(list_concat([list_transform(range(0, length({b}) + 1), lambda z: 0::BIGINT)], list_transform(range(1, length({a}) + 1), lambda i: [unicode({a}[i])::BIGINT])), lambda row, ch: {row})[-1]"


def similar_sql(a: str, b: str, percent: int, strict: bool) -> str:
    total, more, most = f"(length({a}) + length({b}))", ">" if strict else ">=", "<" if strict else "<="
    sure = f"200 * levenshtein({a}, {b}) {most} {100 - percent} * {total}"
    return f"CASE WHEN {a} = {b} THEN {total} > 0 WHEN abs(length({a}) - length({b})) > {100 - percent} * {total} // 100 THEN false WHEN levenshtein({a}, {b}) > {100 - percent} * {total} // 100 THEN false WHEN {sure} THEN true ELSE 200 * {lcs_sql(a, b)} {more} {percent} * {total} END"


# --- journals --------------------------------------------------------------

@query(
    INDEXES
    + f"""
SELECT s.issn, s.title, {SCORE} AS score, quartile, classification, abs AS abs_rating, {tier_sql('quartile', 'classification', 'abs')} AS best_tier
FROM (SELECT * FROM sjr WHERE contains(lower(area), 'economy') OR contains(lower(title), 'economy') ORDER BY {SCORE} DESC, pos LIMIT 20) s
LEFT JOIN qualis q ON s.issn = q.issn LEFT JOIN jql j ON s.issn = j.issn"""
)
def top_journals_for_field(spark, d):
    found = journals.top_for_field(sjr(spark, d), qualis(spark, d), jql(spark, d), "economy", 20)
    return found.select("issn", "title", "score", "quartile", "classification", "abs_rating", "best_tier")


@query(METRICS + " SELECT issn, title, quartile AS sjr_quartile, classification AS qualis_classification, abs AS jql_abs, best_tier FROM metrics")
def journal_metrics(spark, d):
    x = journals.metrics(sjr(spark, d), qualis(spark, d), jql(spark, d))
    return x.select("issn", "title", "sjr_quartile", "qualis_classification", "jql_abs", "best_tier")


def _issn_queries(spark, d):
    return spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("qid"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("q"))


@query(
    METRICS
    + f""" SELECT s_suppkey AS qid, m.issn, title, best_tier FROM supplier JOIN metrics m ON {norm("lpad(CAST(s_suppkey AS VARCHAR), 8, '0')")} = m.issn"""
)
def rank_lookup_issn(spark, d):
    x = journals.by_issn(_issn_queries(spark, d), journals.metrics(sjr(spark, d), qualis(spark, d), jql(spark, d)))
    return x.select("qid", "issn", "title", "best_tier")


def _name_queries(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("qid"), F.upper("c_name").alias("q"))


@query(METRICS + " SELECT c_custkey AS qid, c.name2 AS q, n.issn FROM (SELECT c_custkey, upper(c_name) AS name2 FROM customer) c JOIN names n ON lower(trim(c.name2)) = n.name QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY system) = 1")
def rank_lookup_exact_name(spark, d):
    return journals.by_name(_name_queries(spark, d), names(spark, d))


SIMILAR_Q = "SELECT n_nationkey AS qid, 'larg rings ' || n_nationkey AS q FROM nation UNION ALL SELECT 100 + r_regionkey, ['smal ring', 'red  widget', 'no such journal', 'customer#00000000', 'large gear '][r_regionkey + 1] FROM region"


def _similar_queries(spark, d):
    nation = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("qid"), F.concat(F.lit("larg rings "), F.col("n_nationkey").cast("string")).alias("q"))
    names = F.array(*[F.lit(x) for x in ("smal ring", "red  widget", "no such journal", "customer#00000000", "large gear ")])
    region = spark.read.parquet(f"{d}/region.parquet").select((100 + F.col("r_regionkey")).alias("qid"), F.get(names, F.col("r_regionkey")).alias("q"))
    return nation.union(region)


SIMILAR_SQL = (
    METRICS
    + f""", queries AS ({SIMILAR_Q}),
scored AS (SELECT qid, q, issn, system, first_pos, 200 * {lcs_sql('qn', 'name')} / (length(qn) + length(name)) AS score
    FROM (SELECT qid, q, lower(trim(q)) AS qn, name, issn, system, first_pos FROM queries, names
          WHERE abs(length(lower(trim(q))) - length(name)) <= 15 * (length(lower(trim(q))) + length(name)) // 100
            AND levenshtein(lower(trim(q)), name) <= 15 * (length(lower(trim(q))) + length(name)) // 100)),
best AS (SELECT * FROM scored WHERE score >= 85 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, system, first_pos) = 1)"""
)


@query(SIMILAR_SQL + " SELECT qid, q, issn FROM best")
def rank_lookup_fuzzy_name(spark, d):
    return journals.by_similar_name(_similar_queries(spark, d), names(spark, d)).select("qid", "q", "issn")


@query(
    SIMILAR_SQL
    + """, exact AS (SELECT qid, n.issn FROM queries JOIN names n ON lower(trim(q)) = name QUALIFY row_number() OVER (PARTITION BY qid ORDER BY system) = 1)
SELECT q.qid, coalesce(e.issn, b.issn, trim(q.q)) AS issn, CASE WHEN e.issn IS NOT NULL THEN 'name' WHEN b.issn IS NOT NULL THEN 'similar' ELSE 'none' END AS match_kind,
    CASE WHEN e.issn IS NOT NULL THEN trim(q.q) ELSE coalesce(m.title, '') END AS title, coalesce(m.best_tier, 'unknown') AS best_tier
FROM queries q LEFT JOIN exact e USING (qid) LEFT JOIN best b USING (qid) LEFT JOIN metrics m ON m.issn = coalesce(e.issn, b.issn)"""
)
def rank_journal_ladder(spark, d):
    x = journals.rank(_similar_queries(spark, d), journals.metrics(sjr(spark, d), qualis(spark, d), jql(spark, d)), names(spark, d))
    return x.select("qid", "issn", "match_kind", "title", "best_tier")


@query(
    INDEXES
    + """ SELECT qid, q, arg_min(issn, pos) AS issn FROM (SELECT p_partkey AS qid, p_name || ' quarterly' AS q FROM part) JOIN (SELECT title, issn, pos FROM jql UNION ALL SELECT title, max(issn), min(pos) FROM sjr GROUP BY title) t
ON length(q) > 10 AND (contains(lower(t.title), lower(q)) OR contains(lower(q), lower(t.title))) GROUP BY qid, q"""
)
def rank_lookup_partial_name(spark, d):
    q = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("qid"), F.concat("p_name", F.lit(" quarterly")).alias("q"))
    s = sjr(spark, d).groupBy("title").agg(F.max("issn").alias("issn"), F.min("pos").alias("pos"))
    return journals.by_partial_name(q, jql(spark, d).select("title", "issn", "pos").union(s.select("title", "issn", "pos")))


@query(METRICS + " SELECT best_tier, count(*) AS journals FROM metrics GROUP BY best_tier")
def best_tier_distribution(spark, d):
    return journals.metrics(sjr(spark, d), qualis(spark, d), jql(spark, d)).groupBy("best_tier").agg(F.count("*").alias("journals"))


@query(
    INDEXES
    + f""", k AS (SELECT p_partkey AS journal_id, unnest([lpad(CAST(p_partkey AS VARCHAR), 8, '0'), lpad(CAST(p_partkey * 2 AS VARCHAR), 8, '0'), lpad(CAST(p_partkey * 3 AS VARCHAR), 8, '0')]) AS raw, unnest([0, 1, 2]) AS spot FROM part),
n AS (SELECT journal_id, spot, {norm('raw')} AS issn FROM k)
SELECT p_partkey AS journal_id, coalesce((SELECT arg_min(quartile, spot) FROM n JOIN sjr USING (issn) WHERE journal_id = p_partkey), 'N/A') AS sjr,
    coalesce((SELECT arg_min(classification, spot) FROM n JOIN qualis USING (issn) WHERE journal_id = p_partkey), 'N/A') AS qualis,
    coalesce((SELECT arg_min(abs, spot) FROM n JOIN jql USING (issn) WHERE journal_id = p_partkey), 'N/A') AS jql FROM part"""
)
def journal_info_enriched(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    code = lambda n: F.lpad((F.col("p_partkey") * n).cast("string"), 8, "0")
    x = part.select(F.col("p_partkey").alias("journal_id"), code(1).alias("issn_l"), F.array(code(2), code(3)).alias("issns"))
    return journals.enriched(x, sjr(spark, d), qualis(spark, d), jql(spark, d)).select("journal_id", "sjr", "qualis", "jql")


@query(INDEXES + " SELECT issn, title, sjr_score, quartile, pos FROM sjr")
def multi_issn_explode_last_wins(spark, d):
    return sjr(spark, d).select("issn", "title", "sjr_score", "quartile", "pos")


@query(INDEXES + f" SELECT issn, {SCORE} AS score FROM sjr")
def sjr_scores(spark, d):
    return sjr(spark, d).select("issn", ranking.sjr_number(F.col("sjr_score")).alias("score"))


@query(INDEXES + " SELECT 'sjr' AS system, count(*) AS n FROM sjr UNION ALL SELECT 'qualis', count(*) FROM qualis UNION ALL SELECT 'jql', count(*) FROM jql")
def index_sizes(spark, d):
    of = lambda df, name: df.agg(F.lit(name).alias("system"), F.count("*").alias("n"))
    return of(sjr(spark, d), "sjr").union(of(qualis(spark, d), "qualis")).union(of(jql(spark, d), "jql"))


@query(INDEXES + " SELECT issn, title, area FROM qualis WHERE (contains('0000-0003', '-') AND issn = '0000-0003') OR contains(lower(title), 'supplier#00000001')")
def source_lookup(spark, d):
    q = qualis(spark, d)
    wanted = journals.source_lookup(q, F.lit("0000-0003"), "title") | journals.source_lookup(q, F.lit("Supplier#00000001"), "title")
    return q.where(wanted).select("issn", "title", "area")


# --- retrieval -------------------------------------------------------------

@query(ctes("works") + " SELECT work_id, year, type, cited_by_count FROM works WHERE year BETWEEN 1996 AND 1998 AND type = 'F' ORDER BY cited_by_count DESC, work_id LIMIT 25")
def search_year_type_topk(spark, d):
    q = search.Query(year_from=1996, year_to=1998, type="F")
    return search.search(works(spark, d), q).select("work_id", "year", "type", "cited_by_count")


@query(
    ctes("papers")
    + " SELECT id, title, cited_by_count FROM papers WHERE list_has_all(string_split_regex(lower(title), '\\s+'), ['the', 'of']) ORDER BY cited_by_count DESC, id LIMIT 25"
)
def search_text_tokens(spark, d):
    found = search.search(papers(spark, d), search.Query(text="Of the"), tie="id")
    return found.select("id", "title", "cited_by_count")


@query(
    ctes("works")
    + """ SELECT work_id, source_api, rank, CASE source_api WHEN 'urgent' THEN 0 ELSE 1 END::INTEGER AS source_order FROM (SELECT *, row_number() OVER (PARTITION BY source_api ORDER BY cited_by_count DESC, work_id)::INTEGER AS rank FROM works
WHERE source_api IN ('urgent', 'low') AND year >= 1995) WHERE rank <= 25"""
)
def search_union_sources(spark, d):
    q = search.Query(year_from=1995)
    return search.search_each(works(spark, d), q, ["urgent", "LOW", "nothing"]).select("work_id", "source_api", "rank", "source_order")


@query(ctes("works") + " SELECT work_id, issn, year, cited_by_count FROM works WHERE issn = '0000-0007' AND year >= 1993 ORDER BY cited_by_count DESC, work_id LIMIT 25")
def search_journal_papers(spark, d):
    found = search.search(works(spark, d), search.Query(issn="00000007", year_from=1993))
    return found.select("work_id", "issn", "year", "cited_by_count")


@query(ctes("works") + " SELECT source_api, count(*) AS total FROM works WHERE year BETWEEN 1994 AND 1999 GROUP BY source_api")
def search_summary_counts(spark, d):
    return search.summary(works(spark, d), search.Query(year_from=1994, year_to=1999))


@query(
    """WITH p AS (SELECT page_id, url, html, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host FROM pages)
SELECT page_id, url, host, substr(html, 1, 300) AS snippet FROM p WHERE host = 'example.org' OR ends_with(host, '.example.org') ORDER BY page_id LIMIT 20"""
)
def web_results_by_domain(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return search.web_results(pages, ["example.org"], 50, content="html").select("page_id", "url", "host", "snippet")


@query(
    ctes("works")
    + """ SELECT o_orderkey AS query_id, CASE o_orderkey % 3 WHEN 0 THEN 'doi' WHEN 1 THEN 'openalex' ELSE 'unknown' END AS id_type, w.work_id, w.doi FROM orders LEFT JOIN works w ON o_orderkey % 3 < 2 AND w.work_id = o_orderkey"""
)
def get_paper_by_identifier(spark, d):
    """Works by DOI and by the index's own id, as urls; what is neither finds nothing."""
    key = F.col("o_orderkey").cast("string")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("https://doi.org/10.5555/w"), key)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("https://openalex.org/w"), key)).otherwise(F.concat(F.lit("paper "), key))
    asked = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("query_id"), identifiers.resolve_id(raw).alias("r"))
    w = works(spark, d).select("work_id", "doi")
    ids = w.select(F.explode(F.array(F.struct(F.lit("doi").alias("t"), F.col("doi").alias("v")), F.struct(F.lit("openalex").alias("t"), F.concat(F.lit("W"), F.col("work_id").cast("string")).alias("v")))).alias("k"), "work_id", "doi")
    return asked.join(ids, (F.col("r.id_type") == F.col("k.t")) & (F.col("r.value") == F.col("k.v")), "left").select("query_id", "r.id_type", "work_id", "doi")


@query(ctes("papers") + " SELECT id, journal, cited_by_count FROM papers WHERE contains(lower(journal), 'e') AND year >= 2010 ORDER BY cited_by_count DESC, id LIMIT 40")
def search_container_title(spark, d):
    found = search.search(papers(spark, d), search.Query(journal="E", year_from=2010, per_page=40), tie="id")
    return found.select("id", "journal", "cited_by_count")


IDS_SQL = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'https://doi.org/10.1/A' || doc_id WHEN 1 THEN 'DOI:10.2/b' || doc_id WHEN 2 THEN 'arXiv:2401.' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') || 'v2'
    WHEN 3 THEN 'https://openalex.org/w' || doc_id WHEN 4 THEN substr(sha1(CAST(doc_id AS VARCHAR)), 1, 40) ELSE ' title ' || doc_id END AS raw FROM documents"""


def _ids(spark, d):
    i = F.col("doc_id").cast("string")
    raw = (
        F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("https://doi.org/10.1/A"), i))
        .when(F.col("doc_id") % 6 == 1, F.concat(F.lit("DOI:10.2/b"), i))
        .when(F.col("doc_id") % 6 == 2, F.concat(F.lit("arXiv:2401."), F.lpad((F.col("doc_id") % 100000).cast("string"), 5, "0"), F.lit("v2")))
        .when(F.col("doc_id") % 6 == 3, F.concat(F.lit("https://openalex.org/w"), i))
        .when(F.col("doc_id") % 6 == 4, F.sha1(i.cast("binary")))
        .otherwise(F.concat(F.lit(" title "), i))
    )
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", raw.alias("raw"))


@query(
    f"""WITH i AS ({IDS_SQL}) SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'doi' WHEN 1 THEN 'doi' WHEN 2 THEN 'arxiv' WHEN 3 THEN 'openalex' WHEN 4 THEN 's2' ELSE 'unknown' END AS id_type,
    CASE doc_id % 6 WHEN 0 THEN substr(raw, 17) WHEN 1 THEN substr(raw, 5) WHEN 2 THEN substr(raw, 7, 10) WHEN 3 THEN 'W' || doc_id WHEN 4 THEN raw ELSE trim(raw) END AS value FROM i"""
)
def resolve_id_types(spark, d):
    return _ids(spark, d).select("doc_id", identifiers.resolve_id(F.col("raw")).alias("r")).select("doc_id", "r.id_type", "r.value")


@query(f"WITH i AS ({IDS_SQL}) SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(trim(raw), '^https://doi\\.org/', '', 'i'), '^http://doi\\.org/', '', 'i'), '^doi:', '', 'i') AS doi FROM i")
def normalize_doi(spark, d):
    return _ids(spark, d).select("doc_id", identifiers.normalize_doi(F.col("raw")).alias("doi"))


@query(f"""SELECT p_partkey, {norm("(' ' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') || 'x ')")} AS issn FROM part""")
def normalize_issn(spark, d):
    raw = F.concat(F.lit(" "), F.lpad(F.col("p_partkey").cast("string"), 7, "0"), F.lit("x "))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", identifiers.normalize_issn(raw).alias("issn"))


@query("SELECT doc_id, CASE WHEN contains('10.1/' || doc_id, '/') THEN 'DOI:10.1/' || doc_id END AS s2_id FROM documents")
def s2_lookup_ids(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", identifiers.s2_lookup_id(F.concat(F.lit("10.1/"), F.col("doc_id").cast("string"))).alias("s2_id"))


# --- entity resolution -----------------------------------------------------

BY_DOI = (
    ctes("papers")
    + """, scored AS (SELECT *, ((doi <> '')::INT * 3 + (abstract <> '')::INT * 2 + (n_authors > 0)::INT + (cited_by_count > 0)::INT + (journal <> '')::INT + (year <> 0)::INT) AS score, lower(trim(doi)) AS k FROM papers),
u AS (SELECT *, min(id) OVER (PARTITION BY k) AS f FROM scored WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, id) = 1
    UNION ALL SELECT *, id FROM scored WHERE k = '')"""
)


@query(BY_DOI + " SELECT id, doi, score, f AS first_order FROM u")
def dedup_by_doi(spark, d):
    return dedup.by_doi(papers(spark, d), "id").select("id", "doi", "score", "first_order")


@query(BY_DOI + " SELECT (SELECT count(*) FROM papers) AS returned, count(*) AS kept, (SELECT count(*) FROM papers) - count(*) AS duplicates_removed FROM u")
def dedup_summary(spark, d):
    kept = dedup.by_doi(papers(spark, d), "id").agg(F.count("*").alias("kept"), F.lit(1).alias("_one"))
    every = papers(spark, d).agg(F.count("*").alias("returned"), F.lit(1).alias("_one"))
    return every.join(kept, "_one").select("returned", "kept", (F.col("returned") - F.col("kept")).alias("duplicates_removed"))


@query(
    ctes("papers")
    + f""", t AS (SELECT id, lower(trim(title)) AS t, year FROM papers)
SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.year = b.year AND b.id < a.id AND a.t <> '' AND b.t <> '' AND abs(length(a.t) - length(b.t)) <= 10 * (length(a.t) + length(b.t)) // 100
    AND {similar_sql('a.t', 'b.t', 90, True)}"""
)
def dedup_fuzzy_pairs(spark, d):
    t = papers(spark, d).select("id", F.lower(F.trim("title")).alias("t"), "year")
    return dedup.similar_pairs(t, t, F.col("b") < F.col("a"))


GREEDY = (
    BY_DOI.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", t AS MATERIALIZED (SELECT id, lower(trim(title)) AS t, year, k <> '' AS named FROM u),
pairs AS MATERIALIZED (SELECT a.id AS a, b.id AS b, b.named FROM t a JOIN t b ON a.year = b.year AND NOT a.named AND (b.named OR b.id < a.id) AND a.t <> '' AND b.t <> ''
    AND abs(length(a.t) - length(b.t)) <= 10 * (length(a.t) + length(b.t)) // 100 AND {similar_sql('a.t', 'b.t', 90, True)}),
open AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS n, coalesce((SELECT list(b) FROM pairs WHERE a = id), []) AS before FROM t WHERE NOT named AND id NOT IN (SELECT a FROM pairs WHERE named)),
g AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS kept UNION ALL SELECT o.n, CASE WHEN len(list_intersect(g.kept, o.before)) = 0 THEN list_append(g.kept, o.id) ELSE g.kept END FROM g JOIN open o ON o.n = g.n + 1)
SELECT id, title, doi, year FROM u WHERE k <> '' OR id IN (SELECT unnest(kept) FROM (SELECT kept FROM g ORDER BY n DESC LIMIT 1))"""
)


@query(GREEDY)
def dedup_greedy_full(spark, d):
    return dedup.greedy(papers(spark, d), "id").select("id", "title", "doi", "year")


@query(
    ctes("papers")
    + f""", t AS MATERIALIZED (SELECT id, lower(trim(title)) AS t, year, lower(trim('Author ' || id % 8)) AS author,
    ((doi <> '')::INT * 3 + (abstract <> '')::INT * 2 + (n_authors > 0)::INT + (cited_by_count > 0)::INT + (journal <> '')::INT + (year <> 0)::INT) AS score FROM papers)
SELECT a.id AS id, arg_min(b.id, [-b.score, b.id]) AS kept FROM t a JOIN t b ON a.author = b.author AND a.year = b.year AND a.id <> b.id AND a.t <> '' AND b.t <> ''
    AND abs(length(a.t) - length(b.t)) <= 10 * (length(a.t) + length(b.t)) // 100 AND {similar_sql('a.t', 'b.t', 90, True)} AND [-b.score, b.id] < [-a.score, a.id] GROUP BY a.id"""
)
def dedup_same_first_author(spark, d):
    people = F.concat(F.lit(" Author "), (F.col("id") % 8).cast("string"))
    return dedup.by_first_author(papers(spark, d).withColumn("first_author", people), "id")


# --- citations -------------------------------------------------------------

SEEDS = "SELECT work_id FROM works ORDER BY cited_by_count DESC, work_id LIMIT 20"


def _seeds(spark, d, n=20):
    return works(spark, d).orderBy(F.col("cited_by_count").desc(), "work_id").limit(n).select("work_id")


@query(
    ctes("works", "cites")
    + f""" SELECT c.cited AS seed, row_number() OVER (PARTITION BY c.cited ORDER BY w.cited_by_count DESC, w.work_id)::INTEGER AS rank, w.work_id, w.cited_by_count
FROM cites c JOIN ({SEEDS}) s ON c.cited = s.work_id JOIN works w ON w.work_id = c.citing QUALIFY rank <= 25"""
)
def citing_papers(spark, d):
    return citations.citing(cites(spark, d), works(spark, d), _seeds(spark, d)).select("seed", "rank", "work_id", "cited_by_count")


@query(
    ctes("works", "cites")
    + """, r AS (SELECT citing AS seed, row_number() OVER (PARTITION BY citing ORDER BY ord, cited)::INTEGER AS rank, cited FROM cites)
SELECT seed, rank, work_id, year FROM r JOIN works ON cited = work_id WHERE rank <= 25"""
)
def referenced_papers(spark, d):
    w = works(spark, d)
    return citations.references(cites(spark, d), w, w.select("work_id")).select("seed", "rank", "work_id", "year")


@query(ctes("cites") + " SELECT a.cited AS paper_a, b.cited AS paper_b, count(*) AS co_citations FROM cites a JOIN cites b ON a.citing = b.citing AND a.cited < b.cited GROUP BY ALL HAVING count(*) >= 2")
def co_citation_pairs(spark, d):
    return citations.co_citations(cites(spark, d))


@query(
    ctes("works", "cites")
    + f""", s AS ({SEEDS}) SELECT a.cited AS paper_a, b.cited AS paper_b, count(*) AS co_citations FROM cites a JOIN cites b ON a.citing = b.citing AND a.cited < b.cited
WHERE a.cited IN (SELECT work_id FROM s) AND b.cited IN (SELECT work_id FROM s) GROUP BY ALL HAVING count(*) >= 1 ORDER BY 3 DESC, 1, 2 LIMIT 50"""
)
def co_citation_clusters(spark, d):
    return citations.co_citations(cites(spark, d), _seeds(spark, d), 1, 50)


NETWORK = (
    ctes("works", "cites")
    + """, refs AS (SELECT citing, cited, row_number() OVER (PARTITION BY citing ORDER BY ord, cited) AS n FROM cites QUALIFY n <= 10),
seeds AS (SELECT work_id, row_number() OVER (ORDER BY cited_by_count DESC, work_id) AS ord FROM works QUALIFY ord <= 5),
l1 AS (SELECT cited AS work_id, min([ord, n]) AS place FROM refs JOIN seeds ON citing = work_id WHERE cited IN (SELECT work_id FROM works) AND cited NOT IN (SELECT work_id FROM seeds) GROUP BY cited),
l2 AS (SELECT cited AS work_id, min([place[1], place[2], n]) AS place FROM refs JOIN l1 ON citing = work_id WHERE cited IN (SELECT work_id FROM works) AND cited NOT IN (SELECT work_id FROM seeds) AND cited NOT IN (SELECT work_id FROM l1) GROUP BY cited),
nodes AS (SELECT work_id, 0 AS level, [ord] AS place FROM seeds UNION ALL SELECT work_id, 1, place FROM l1 UNION ALL SELECT work_id, 2, place FROM l2 ORDER BY level, place LIMIT 100)"""
)


def _network(spark, d):
    from pyspark.sql import Window as W

    w = works(spark, d)
    top = w.orderBy(F.col("cited_by_count").desc(), "work_id").limit(5)
    seeds = top.withColumn("ord", F.row_number().over(W.orderBy(F.col("cited_by_count").desc(), "work_id"))).select("ord", "work_id")
    return citations.network(cites(spark, d), w, seeds, 2, 100)


@query(NETWORK + " SELECT work_id, level::INTEGER AS level FROM nodes")
def citation_network_nodes(spark, d):
    return _network(spark, d)[0].select("work_id", "level")


@query(NETWORK + " SELECT citing, cited FROM refs JOIN nodes ON citing = work_id WHERE level < 2")
def citation_network_edges(spark, d):
    return _network(spark, d)[1].select("citing", "cited")


@query(NETWORK + " SELECT (SELECT count(*) FROM nodes) AS nodes_count, (SELECT count(*) FROM refs JOIN nodes ON citing = work_id WHERE level < 2) AS edges_count")
def citation_network_counts(spark, d):
    return citations.network_counts(*_network(spark, d))


@query(NETWORK + " SELECT citing, cited FROM (SELECT citing, cited, level, list_append(place, n) AS spot FROM refs JOIN nodes ON citing = work_id WHERE level < 2) ORDER BY level, spot LIMIT 20")
def citation_network_first_edges(spark, d):
    return _network(spark, d)[1].orderBy("level", "place").limit(20).select("citing", "cited")


@query(ctes("cites") + " SELECT cited, count(*) AS returned, count(*) FILTER (is_influential) AS influential_count FROM cites GROUP BY cited")
def influential_citations(spark, d):
    return citations.with_influence(cites(spark, d).withColumn("title", F.col("intent")))


@query(
    ctes("cites")
    + """, r AS (SELECT citing, row_number() OVER (PARTITION BY citing ORDER BY ord, cited) - 1 AS rank, '10.5555/w' || cited AS ref_doi, 'title ' || cited AS cited_title, is_influential FROM cites),
p AS (SELECT DISTINCT l_orderkey AS citing, 'doi:10.5555/W' || (l_partkey // 10) AS cited_doi FROM lineitem)
SELECT p.citing, cited_doi, count(r.rank) > 0 AS found, min(r.rank)::INTEGER AS rank, arg_min(cited_title, r.rank) AS cited_title, arg_min(is_influential, r.rank) AS is_influential
FROM p LEFT JOIN r ON p.citing = r.citing AND contains(ref_doi, lower(regexp_replace(cited_doi, 'doi:', '', 'i'))) GROUP BY ALL"""
)
def citation_context(spark, d):
    from pyspark.sql import Window as W

    rank = (F.row_number().over(W.partitionBy("citing").orderBy("ord", "cited")) - 1).alias("rank")
    doi = lambda c: F.concat(F.lit("10.5555/w"), F.col(c).cast("string"))
    r = cites(spark, d).select("citing", rank, doi("cited").alias("ref_doi"), F.concat(F.lit("title "), F.col("cited").cast("string")).alias("cited_title"), "is_influential")
    pairs = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("citing"), F.concat(F.lit("doi:10.5555/W"), F.expr("l_partkey div 10").cast("string")).alias("cited_doi")).distinct()
    return citations.context(r, pairs)


@query(
    ctes("works")
    + """ SELECT author_id, count(*) AS works_count, sum(cited_by_count)::BIGINT AS cited_by_count, count(*) FILTER (cited_by_count >= n) AS h_index
FROM (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY cited_by_count DESC, work_id) AS n FROM works) GROUP BY author_id"""
)
def author_profiles(spark, d):
    return citations.authors(works(spark, d))


@query(ctes("works") + " SELECT author_id, row_number() OVER (PARTITION BY author_id ORDER BY cited_by_count DESC, work_id)::INTEGER AS rank, work_id FROM works QUALIFY rank <= 20")
def author_works_topk(spark, d):
    return citations.author_works(works(spark, d), F.lit(True)).select("author_id", "rank", "work_id")


# --- verification, trends, open access -------------------------------------

TOKENS = "list_distinct(list_filter(string_split_regex(lower({0}), '\\s+'), lambda w: w <> ''))"
VERIFY = (
    ctes("papers", "refs")
    + f""", rt AS (SELECT ref_id, year, unnest({TOKENS.format("author || ' ' || title")}) AS word FROM refs),
pt AS (SELECT id, year, unnest({TOKENS.format("authors || ' ' || title")}) AS word FROM papers),
near AS (SELECT ref_id, id, count(*) AS overlap FROM rt JOIN pt ON rt.word = pt.word AND pt.year BETWEEN rt.year - 1 AND rt.year + 1 GROUP BY ref_id, id QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY overlap DESC, id) = 1),
same AS (SELECT ref_id, id, count(*) AS overlap FROM rt JOIN pt ON rt.word = pt.word AND pt.year = rt.year GROUP BY ref_id, id QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY overlap DESC, id) = 1),
v AS (SELECT r.ref_id, near.id AS near_id, same.id AS same_id, p.title AS near_title, p.doi AS near_doi, s.title AS same_title, s.doi AS same_doi, coalesce(contains(lower(r.title), lower(p.title)) OR contains(lower(p.title), lower(r.title))
    OR len(list_intersect({TOKENS.format('r.title')}, {TOKENS.format('p.title')})) > 2, false) AS fits
    FROM refs r LEFT JOIN near USING (ref_id) LEFT JOIN same USING (ref_id) LEFT JOIN papers p ON p.id = near.id LEFT JOIN papers s ON s.id = same.id),
verified AS (SELECT ref_id, fits OR same_id IS NOT NULL AS verified, CASE WHEN fits THEN 'high' WHEN same_id IS NOT NULL THEN 'medium' ELSE 'none' END AS confidence, CASE WHEN fits THEN near_id ELSE same_id END AS work_id,
    coalesce(CASE WHEN fits THEN near_doi ELSE same_doi END, '') AS doi, coalesce(CASE WHEN fits THEN near_title ELSE same_title END, near_title, '') AS matched_title FROM v)"""
)


def _verified(spark, d):
    return verify.verify(refs(spark, d), papers(spark, d).select(F.col("id").alias("work_id"), "title", "year", "authors", "doi"))


@query(VERIFY + " SELECT * FROM verified")
def verify_citations_batch(spark, d):
    return _verified(spark, d)


@query(VERIFY + " SELECT r.ref_id, fits AS verified, CASE WHEN fits THEN 'high' ELSE 'low' END AS confidence, CASE WHEN fits THEN near_doi ELSE '' END AS doi, coalesce(near_title, '') AS matched_title FROM v JOIN refs r USING (ref_id)")
def verify_references_strict(spark, d):
    x = verify.verify(refs(spark, d), papers(spark, d).select(F.col("id").alias("work_id"), "title", "year", "authors", "doi"), strict=True)
    return x.select("ref_id", "verified", "confidence", "doi", "matched_title")


@query(VERIFY + " SELECT count(*) AS total, count(*) FILTER (verified) AS verified, count(*) FILTER (NOT verified) AS unverified FROM verified")
def verify_summary(spark, d):
    return verify.verify_summary(_verified(spark, d))


@query("SELECT '10.5555/w' || l_orderkey AS doi, bool_or(l_returnflag = 'R') AS retracted, count(*) AS n_updates FROM lineitem GROUP BY l_orderkey")
def retraction_flags(spark, d):
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    kind = F.when(F.col("l_returnflag") == "R", "retraction").otherwise("correction")
    return verify.retraction_flags(line.select(F.concat(F.lit("10.5555/w"), F.col("l_orderkey").cast("string")).alias("doi"), kind.alias("type")))


@query(
    VERIFY
    + """ SELECT ref_id, CASE WHEN verified AND coalesce(work_id % 3 = 0, false) THEN 'VERIFIED + RETRACTED' WHEN verified THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS status,
    regexp_replace(list_extract(string_split(trim(author), ' '), -1), '[^a-zA-Z]', '', 'g') || year AS cite_key FROM verified JOIN refs USING (ref_id)"""
)
def verification_status(spark, d):
    x = _verified(spark, d).join(refs(spark, d), "ref_id")
    return x.select("ref_id", verify.status(F.col("verified"), F.col("work_id") % 3 == 0).alias("status"), texts.cite_key(F.col("author"), F.col("year")).alias("cite_key"))


@query(
    """SELECT '10.5555/w' || o_orderkey AS doi, coalesce(m.oa_status, 'closed') AS oa_status, coalesce(m.oa_status = 'gold', false) AS is_oa, coalesce(m.url, '') AS pdf_url
FROM orders LEFT JOIN (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'gold' ELSE 'green' END AS oa_status, 'https://oa.example/' || p_partkey AS url FROM part) m ON o_orderkey = p_partkey"""
)
def open_access_lookup(spark, d):
    dois = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("10.5555/w"), F.col("o_orderkey").cast("string")).alias("doi"))
    key = F.col("p_partkey").cast("string")
    gold = F.col("p_size") % 2 == 0
    held = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("https://doi.org/10.5555/W"), key).alias("doi"), F.when(gold, "gold").otherwise("green").alias("oa_status"), gold.alias("is_oa"), F.concat(F.lit("https://oa.example/"), key).alias("pdf_url"))
    return verify.open_access(dois, held)


@query(
    ctes("papers")
    + f""", k AS (SELECT unnest(['the of', 'de', 'nothing like it']) AS keyword), y AS (SELECT unnest(range(2005, 2016))::INTEGER AS year)
SELECT keyword, year, (SELECT count(*) FROM papers p WHERE p.year = y.year AND list_has_all({TOKENS.format('p.title')}, string_split(keyword, ' '))) AS count FROM k, y"""
)
def keyword_trends_grid(spark, d):
    return verify.keyword_trends(papers(spark, d), ["the of", "de", "nothing like it"], 2005, 2015)


# --- projections -----------------------------------------------------------

@query("SELECT item_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''), ' ') AS abstract FROM benchmark")
def abstract_from_inverted_index(spark, d):
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    placed = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.posexplode(words).alias("at", "word"))
    index = placed.groupBy("item_id", "word").agg(F.collect_list("at").alias("at")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("index"))
    return index.select("item_id", texts.abstract_text(F.col("index")).alias("abstract"))


@query(
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'peer_reviewed' WHEN 'O' THEN 'preprint' ELSE 'conference' END AS openalex, CASE o_orderstatus WHEN 'F' THEN 'peer_reviewed' WHEN 'O' THEN 'preprint' ELSE 'conference' END AS crossref,
    CASE o_orderstatus WHEN 'F' THEN 'peer_reviewed' WHEN 'O' THEN 'conference' ELSE 'unknown' END AS s2 FROM orders"""
)
def source_type_mapping(spark, d):
    s = F.col("o_orderstatus")
    pick = lambda f, o, p: F.when(s == "F", f).when(s == "O", o).otherwise(p)
    types = F.when(s == "F", F.array(F.lit("Book"), F.lit("JournalArticle"))).when(s == "O", F.array(F.lit("Conference"))).otherwise(F.array(F.lit("Review")))
    return spark.read.parquet(f"{d}/orders.parquet").select(
        "o_orderkey",
        texts.mapped(pick("article", "posted-content", "proceedings"), texts.OPENALEX_TYPES).alias("openalex"),
        texts.mapped(pick("journal-article", "posted-content", "proceedings-article"), texts.CROSSREF_TYPES).alias("crossref"),
        texts.s2_source_type(types).alias("s2"),
    )


@query("SELECT doc_id, CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || ' [...]' ELSE text END AS text FROM documents")
def truncate_fulltext(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", texts.truncated(F.col("text"), 1000, " [...]").alias("text"))


# --- cache -----------------------------------------------------------------

LATEST = ctes("cache_log") + ", latest AS (SELECT *, created_at + to_seconds(ttl) AS expires_at FROM cache_log QUALIFY row_number() OVER (PARTITION BY key ORDER BY created_at DESC, event_id DESC) = 1)"
AS_OF = "2024-01-30 12:00:00"


def _latest(spark, d):
    log = cache_log(spark, d)
    log = log.withColumn("expires_at", F.col("created_at") + F.make_dt_interval(secs=F.col("ttl")))
    return cache.latest(log, order=("created_at", "event_id"))


def _as_of(kind="timestamp_ntz"):
    return F.lit(AS_OF).cast(kind)


@query(LATEST + " SELECT key, entity_type, value, event_id FROM latest")
def cache_upsert_latest(spark, d):
    return _latest(spark, d).select("key", "entity_type", "value", "event_id")


@query(LATEST + f" SELECT key, event_id FROM latest WHERE expires_at > TIMESTAMP '{AS_OF}'")
def cache_live_at(spark, d):
    return cache.live(_latest(spark, d), _as_of()).select("key", "event_id")


@query(LATEST + f" SELECT entity_type, count(*) AS evicted FROM latest WHERE expires_at <= TIMESTAMP '{AS_OF}' GROUP BY entity_type")
def cache_evict(spark, d):
    return cache.expired(_latest(spark, d), _as_of()).groupBy("entity_type").agg(F.count("*").alias("evicted"))


@query(LATEST + f" SELECT CASE WHEN grouping(entity_type) = 1 THEN '*' ELSE entity_type END AS entity_type, count(*) AS entries, count(*) FILTER (expires_at > TIMESTAMP '{AS_OF}') AS live_entries FROM latest GROUP BY ROLLUP (entity_type)")
def cache_stats(spark, d):
    return cache.stats(_latest(spark, d), _as_of())


READ_THROUGH = (
    LATEST
    + f""", asked AS (SELECT user_id::VARCHAR || ':' || t AS key, t AS entity_type, user_id FROM (SELECT DISTINCT user_id FROM events) u, (SELECT unnest(['click', 'view', 'purchase', 'none']) AS t)),
a AS (SELECT asked.key, asked.entity_type, CASE WHEN l.key IS NOT NULL THEN l.value WHEN user_id % 5 <> 0 THEN 'fetched ' || asked.key END AS value, l.key IS NOT NULL AS from_cache, l.key IS NULL AND user_id % 5 = 0 AS failed
    FROM asked LEFT JOIN (SELECT * FROM latest WHERE expires_at > TIMESTAMP '{AS_OF}') l ON asked.key = l.key)"""
)


def _read_through(spark, d):
    table = _latest(spark, d)
    users = spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct()
    kinds = F.explode(F.array(*[F.lit(k) for k in ("click", "view", "purchase", "none")])).alias("entity_type")
    asked = users.select("user_id", kinds).select(F.concat_ws(":", F.col("user_id").cast("string"), "entity_type").alias("key"), "entity_type")

    def fetch(missing):
        failed = F.split("key", ":")[0].cast("bigint") % 5 == 0
        return missing.select("key", F.concat(F.lit("fetched "), "key").alias("value"), failed.alias("failed"))

    return cache.read_through(table, asked, fetch, _as_of(), {"click": 3600, "view": 86400, "purchase": 604800})


@query(READ_THROUGH + " SELECT key, entity_type, value, from_cache, failed FROM a")
def cache_read_through(spark, d):
    return _read_through(spark, d)[0]


@query(
    READ_THROUGH
    + f""" SELECT key, value, expires_at FROM latest WHERE key NOT IN (SELECT key FROM a WHERE NOT from_cache AND NOT failed)
UNION ALL SELECT key, value, TIMESTAMP '{AS_OF}' + to_seconds(CASE entity_type WHEN 'click' THEN 3600 WHEN 'view' THEN 86400 WHEN 'purchase' THEN 604800 ELSE 3600 END) FROM a WHERE NOT from_cache AND NOT failed"""
)
def cache_after_read_through(spark, d):
    return _read_through(spark, d)[1].select("key", "value", "expires_at")


@query("""SELECT doc_id, sha256('/works:' || '{"lang":"' || lang || '","page":"' || (doc_id % 7) || '"}') AS key FROM documents""")
def cache_key_sha256(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    params = F.create_map(F.lit("page"), (F.col("doc_id") % 7).cast("string"), F.lit("lang"), F.col("lang"))
    return docs.select("doc_id", identifiers.cache_key(F.lit("/works"), params).alias("key"))


# --- full text -------------------------------------------------------------

def _spans(spark, d):
    """Words of conversation turns as positioned spans: a conversation is a document, a turn a page, its lines lines."""
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    lines = turns.select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "role", F.posexplode(F.split("text", "\n")).alias("line", "row"))
    words = lines.select("doc", "page", "role", "line", F.posexplode(F.split("row", " ")).alias("at", "word"))
    size = F.when(F.col("line") == 0, 13.0 + 2 * (F.col("page") % 2)).otherwise(10.0)
    bold = F.when((F.col("role") == "user") & (F.col("line") <= 1), 16).otherwise(0)
    return words.select("doc", "page", "line", "at", F.concat("word", F.lit(" ")).alias("text"), size.alias("size"), F.lit("Serif").alias("font"), bold.alias("flags"))


@query(
    """WITH l AS (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS row, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM conversations),
m AS (SELECT conv_id, turn, line, trim(row) AS t, CASE WHEN line = 0 THEN 13 + 2 * (turn % 2) ELSE 10 END AS size, role = 'user' AND line <= 1 AS bold FROM l WHERE trim(row) <> ''),
d AS (SELECT *, CASE WHEN size > 14 AND bold THEN chr(10) || '## ' || t || chr(10) WHEN size > 12 AND bold THEN chr(10) || '### ' || t || chr(10) WHEN bold AND length(t) < 100 THEN chr(10) || '**' || t || '**' || chr(10) ELSE t END AS md FROM m),
p AS (SELECT conv_id, turn, string_agg(md, chr(10) ORDER BY line) AS body FROM d GROUP BY ALL),
w AS (SELECT conv_id, count(*) AS pages, string_agg(body, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS text FROM p GROUP BY ALL)
SELECT conv_id AS doc, pages, text FROM w"""
)
def spans_to_markdown(spark, d):
    return fulltext.markdown(_spans(spark, d))


@query(
    """WITH x AS (SELECT conv_id, turn, text, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS entry FROM conversations)
SELECT conv_id, entry, string_agg(text, ' ' ORDER BY turn) AS text, count(*) AS parts FROM x WHERE entry > 0 GROUP BY ALL"""
)
def continuation_merge(spark, d):
    from pyspark.sql import Window as W

    own = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    x = spark.read.parquet(f"{d}/conversations.parquet").withColumn("entry", F.count_if(F.col("role") == "user").over(own)).where("entry > 0")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"])
    return x.groupBy("conv_id", "entry").agg(F.array_join(parts, " ").alias("text"), F.count("*").alias("parts"))


@query(
    """WITH RECURSIVE s AS MATERIALIZED (SELECT page, text, x, y, row_number() OVER (PARTITION BY page ORDER BY round_even(y, 0), x, y, text) - 1 AS i
    FROM (SELECT (l_orderkey % 500)::INTEGER AS page, l_quantity AS x, l_extendedprice % 700 AS y, trim(l_returnflag) AS text FROM lineitem) WHERE text <> ''),
g AS (SELECT page, i, y AS anchor, 0 AS r, text FROM s WHERE i = 0 UNION ALL
    SELECT s.page, s.i, CASE WHEN abs(s.y - g.anchor) > 3 THEN s.y ELSE g.anchor END, g.r + (abs(s.y - g.anchor) > 3)::INTEGER, s.text FROM g JOIN s ON s.page = g.page AND s.i = g.i + 1)
SELECT page, r AS "row", count(*) AS spans, arg_min(text, i) AS "first" FROM g GROUP BY page, r"""
)
def anchored_row_grouping(spark, d):
    spans = spark.read.parquet(f"{d}/lineitem.parquet").select(
        (F.col("l_orderkey") % 500).cast("int").alias("page"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") % 700).alias("y"), F.col("l_returnflag").alias("text")
    )
    return rankings.row_groups(spans).groupBy("page", "row").agg(F.count("*").alias("spans"), F.min_by("text", "at").alias("first"))


# --- curation and meta-analysis --------------------------------------------

TIERED = METRICS + f""", tiered AS (SELECT m.issn, m.title, m.best_tier, s.sjr_score, {SCORE} AS score, CASE WHEN row_number() OVER (ORDER BY {SCORE} DESC, m.issn) <= 50 THEN 'S' WHEN best_tier = 'unknown' THEN 'Grey' ELSE best_tier END AS tier FROM metrics m LEFT JOIN sjr s USING (issn))"""


def _tiered(spark, d):
    m = journals.metrics(sjr(spark, d), qualis(spark, d), jql(spark, d))
    return curation.tiers(m.select("issn", "title", "best_tier", "sjr_sjr_score").withColumnRenamed("sjr_sjr_score", "sjr_score"))


@query(TIERED + " SELECT issn, score, tier FROM tiered")
def curation_tiers(spark, d):
    return _tiered(spark, d).select("issn", "score", "tier")


@query(
    TIERED
    + ","
    + ctes("works").removeprefix("WITH ")
    + """, r AS (SELECT author_id, coalesce(tier, 'Grey') AS tier FROM works LEFT JOIN tiered USING (issn)),
x AS (SELECT author_id, count(*) AS n, 100.0::DOUBLE * count(*) FILTER (tier IN ('S', 'A', 'B')) / count(*) AS top_percent, 100.0::DOUBLE * count(*) FILTER (tier IN ('C', 'D')) / count(*) AS low_percent, 100.0::DOUBLE * count(*) FILTER (tier = 'Grey') / count(*) AS grey_percent FROM r GROUP BY author_id)
SELECT author_id, n, round(top_percent, 6) AS top_percent, round(low_percent, 6) AS low_percent, round(grey_percent, 6) AS grey_percent, top_percent >= 70 AND low_percent <= 15 AND grey_percent <= 10 AS within_limits FROM x"""
)
def reference_mix(spark, d):
    r = works(spark, d).join(_tiered(spark, d).select("issn", "tier"), "issn", "left").withColumn("tier", F.coalesce("tier", F.lit("Grey")))
    x = curation.reference_mix(r, "author_id")
    return x.select("author_id", "n", *[F.round(c, 6).alias(c) for c in ("top_percent", "low_percent", "grey_percent")], "within_limits")


@query(
    ctes("works") + " SELECT work_id, type AS tier, row_number() OVER (PARTITION BY type ORDER BY influential DESC, cited_by_count DESC, work_id)::INTEGER AS rank FROM works"
)
def influence_tiebreak(spark, d):
    return curation.by_influence(works(spark, d).withColumnRenamed("type", "tier")).select("work_id", "tier", "rank")


@query(
    INDEXES
    + ", "
    + ctes("works").removeprefix("WITH ")
    + f""", records AS (SELECT DISTINCT {norm("lpad(CAST(p_partkey * 7 AS VARCHAR), 8, '0')")} AS issn FROM part)
SELECT DISTINCT issn FROM works WHERE issn NOT IN (SELECT issn FROM sjr WHERE quartile <> 'Q0') AND issn NOT IN (SELECT issn FROM qualis) AND issn NOT IN (SELECT issn FROM jql) AND issn NOT IN (SELECT issn FROM records)"""
)
def predatory_screen(spark, d):
    """Journals that no ranking grades and the sources' own records don't know (Q0 stands for a journal without a quartile)."""
    records = spark.read.parquet(f"{d}/part.parquet").select(identifiers.normalize_issn(F.lpad((F.col("p_partkey") * 7).cast("string"), 8, "0")).alias("issn"))
    return curation.unlisted(works(spark, d).select("issn").distinct(), sjr(spark, d).where("quartile <> 'Q0'"), qualis(spark, d), jql(spark, d), records)


@query(
    """WITH r AS (SELECT o_orderpriority AS stage, o_orderstatus AS reason FROM orders)
SELECT CASE WHEN grouping(stage) = 1 THEN '*' ELSE stage END AS stage, CASE WHEN grouping(reason) = 1 THEN '*' ELSE reason END AS reason, count(*) AS n FROM r GROUP BY ROLLUP (stage, reason)"""
)
def prisma_flow(spark, d):
    return curation.flow(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("stage"), F.col("o_orderstatus").alias("reason")))


def _methods(spark, d):
    return works(spark, d).withColumn("method", F.when(F.col("price") > 250000, "quantitative").otherwise("qualitative"))


@query(
    ctes("works", "cites")
    + """, refs AS (SELECT c.citing, w.year, w.source_api AS journal, v.year AS cited_year, v.source_api AS cited_journal FROM cites c JOIN works w ON c.citing = w.work_id JOIN works v ON c.cited = v.work_id),
n AS (SELECT citing, count(*) AS n FROM refs GROUP BY citing),
a AS (SELECT source_api, count(*) AS works, quantile_cont(coalesce(n, 0), 0.5)::DOUBLE AS median_references, 100.0::DOUBLE * count(*) FILTER (price > 250000) / count(*) AS quantitative_percent FROM works LEFT JOIN n ON work_id = citing GROUP BY source_api),
s AS (SELECT journal, 100.0::DOUBLE * count(*) FILTER (year - cited_year < 5) / count(*) AS recent_percent, 100.0::DOUBLE * count(*) FILTER (journal = cited_journal) / count(*) AS self_percent FROM refs GROUP BY journal)
SELECT source_api, works, median_references, round(quantitative_percent, 6) AS quantitative_percent, round(recent_percent, 6) AS recent_percent, round(self_percent, 6) AS self_percent FROM a LEFT JOIN s ON source_api = journal"""
)
def journal_profile(spark, d):
    x = curation.journal_profile(_methods(spark, d), cites(spark, d), "source_api")
    return x.select("source_api", "works", "median_references", *[F.round(c, 6).alias(c) for c in ("quantitative_percent", "recent_percent", "self_percent")])


@query(
    ctes("works", "cites")
    + """ SELECT w.source_api AS from_journal, v.source_api AS to_journal, count(*) AS n, row_number() OVER (PARTITION BY w.source_api ORDER BY count(*) DESC, v.source_api)::INTEGER AS rank
FROM cites c JOIN works w ON c.citing = w.work_id JOIN works v ON c.cited = v.work_id GROUP BY w.source_api, v.source_api QUALIFY rank <= 10"""
)
def journal_top_cited(spark, d):
    return curation.top_cited_journals(works(spark, d), cites(spark, d), "source_api")


@query(
    ctes("works")
    + """ SELECT author_id, CASE WHEN bool_or(source_api = 'urgent') AND bool_or(type = 'P') THEN 'HIGH' WHEN bool_or(source_api = 'urgent') OR bool_or(type = 'P') THEN 'MEDIUM' ELSE 'LOW' END AS likelihood FROM works GROUP BY author_id"""
)
def reviewer_likelihood(spark, d):
    x = works(spark, d).groupBy("author_id").agg(F.bool_or(F.col("source_api") == "urgent").alias("j"), F.bool_or(F.col("type") == "P").alias("t"))
    return x.select("author_id", curation.reviewer_likelihood(F.col("j"), F.col("t")).alias("likelihood"))


@query(
    """SELECT l_orderkey, l_partkey, l_linenumber, round(2 * r / sqrt(1 - r * r), 9) AS d_from_r, round(l_quantity / sqrt(l_quantity * l_quantity + 4), 9) AS r_from_d, round(ln(l_quantity) * sqrt(3) / pi(), 9) AS d_from_or
FROM (SELECT *, l_discount * 5 AS r FROM lineitem)"""
)
def effect_size_conversions(spark, d):
    x = spark.read.parquet(f"{d}/lineitem.parquet")
    q = F.col("l_quantity")
    return x.select("l_orderkey", "l_partkey", "l_linenumber", F.round(meta.d_from_r(F.col("l_discount") * 5), 9).alias("d_from_r"), F.round(meta.r_from_d(q), 9).alias("r_from_d"), F.round(meta.d_from_odds_ratio(q), 9).alias("d_from_or"))


STUDIES = "SELECT l_suppkey AS g, l_orderkey AS study, l_returnflag AS flag, l_quantity AS moderator, l_discount * 10 - l_tax * 5 AS effect, 0.1 + l_quantity / 100 AS se FROM lineitem"


def _studies(spark, d):
    x = spark.read.parquet(f"{d}/lineitem.parquet")
    return x.select(F.col("l_suppkey").alias("g"), F.col("l_orderkey").alias("study"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("moderator"), (F.col("l_discount") * 10 - F.col("l_tax") * 5).alias("effect"), (0.1 + F.col("l_quantity") / 100).alias("se"))


@query(
    f"""WITH s AS (SELECT *, 1 / (se * se) AS w FROM ({STUDIES})),
f AS (SELECT g, count(*) AS k, sum(w) AS sw, sum(w * effect) AS swd, sum(w * effect * effect) AS swdd, sum(w * w) AS sww FROM s GROUP BY g),
q AS (SELECT *, greatest(swdd - swd * swd / sw, 0) AS q FROM f),
t AS (SELECT *, CASE WHEN k > 1 AND sw - sww / sw > 0 THEN greatest(0, (q - (k - 1)) / (sw - sww / sw)) ELSE 0 END AS tau2, CASE WHEN q > 0 THEN greatest(0, (q - (k - 1)) / q) ELSE 0 END AS i2 FROM q),
p AS (SELECT s.g, sum(effect / (se * se + tau2)) / sum(1 / (se * se + tau2)) AS pooled, sqrt(1 / sum(1 / (se * se + tau2))) AS pooled_se FROM s JOIN t ON s.g = t.g GROUP BY s.g)
SELECT t.g, k, round(q, 6) AS q, round(tau2, 6) AS tau2, round(i2, 6) AS i2, round(pooled, 6) AS pooled, round(pooled - 1.96 * pooled_se, 6) AS low, round(pooled + 1.96 * pooled_se, 6) AS high FROM t JOIN p ON t.g = p.g"""
)
def meta_random_effects(spark, d):
    x = meta.random_effects(_studies(spark, d), "g")
    return x.select("g", "k", *[F.round(c, 6).alias(c) for c in ("q", "tau2", "i2", "pooled", "low", "high")])


@query(
    f"""WITH s AS (SELECT *, 1 / (se * se) AS w FROM ({STUDIES})), g AS (SELECT flag, sum(w) AS w, sum(w * effect) / sum(w) AS m FROM s GROUP BY flag)
SELECT count(*) - 1 AS df, round(greatest(sum(w * m * m) - sum(w * m) * sum(w * m) / sum(w), 0), 4) AS q_between FROM g"""
)
def meta_between_groups(spark, d):
    return meta.between_groups(_studies(spark, d), "flag").select("df", F.round("q_between", 4).alias("q_between"))


@query(f"WITH s AS (SELECT *, 1 / (se * se) AS w FROM ({STUDIES})) SELECT g, study, moderator, round(effect, 6) AS effect, round((sum(w * effect) OVER (PARTITION BY g) - w * effect) / (sum(w) OVER (PARTITION BY g) - w), 6) AS without FROM s")
def meta_leave_one_out(spark, d):
    return meta.leave_one_out(_studies(spark, d), "g").select("g", "study", "moderator", F.round("effect", 6).alias("effect"), F.round("without", 6).alias("without"))


@query(f"SELECT g, count(*) AS k, round(regr_slope(effect / se, 1 / se), 6) AS slope, round(regr_intercept(effect / se, 1 / se), 6) AS intercept FROM ({STUDIES}) GROUP BY g")
def egger_regression(spark, d):
    return meta.egger(_studies(spark, d), "g").select("g", "k", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query(
    f"""WITH s AS (SELECT g, sum(w) AS sw, sum(w * m) AS sx, sum(w * y) AS sy, sum(w * m * m) AS sxx, sum(w * m * y) AS sxy, count(*) AS k FROM (SELECT g, moderator AS m, effect AS y, 1 / (se * se) AS w FROM ({STUDIES})) GROUP BY g)
SELECT g, k, round((sw * sxy - sx * sy) / (sw * sxx - sx * sx), 6) AS slope, round((sy - (sw * sxy - sx * sy) / (sw * sxx - sx * sx) * sx) / sw, 6) AS intercept FROM s"""
)
def meta_regression(spark, d):
    return meta.meta_regression(_studies(spark, d), "g", "moderator").select("g", "k", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query(
    f"""WITH RECURSIVE s AS MATERIALIZED (SELECT g, effect, w, row_number() OVER (PARTITION BY g ORDER BY effect DESC, w) AS r FROM (SELECT g, effect, 1 / (se * se) AS w FROM ({STUDIES}))),
c AS (SELECT g, count(*) AS k, sum(w * effect) / sum(w) AS centre, 0::BIGINT AS missing, [0::BIGINT] AS seen, 0 AS i FROM s GROUP BY g
    UNION ALL
    SELECT n.g, n.k, sum(s.w * s.effect) / sum(s.w), n.now, list_append(n.seen, n.now), n.i + 1
    FROM (SELECT g, k, seen, i, least(greatest(0, round((4 * t - k * (k + 1)) / (2 * k - 1)))::BIGINT, k - 1) AS now
        FROM (SELECT g, k, seen, i, sum(CASE WHEN gap > 0 THEN place ELSE 0 END) AS t
            FROM (SELECT s.g, c.k, c.seen, c.i, round(s.effect - c.centre, 9) AS gap, rank() OVER (PARTITION BY s.g ORDER BY abs(round(s.effect - c.centre, 9))) AS place FROM s JOIN c ON s.g = c.g)
            GROUP BY g, k, seen, i)) n
    JOIN s ON s.g = n.g AND s.r > n.now WHERE NOT list_contains(n.seen, n.now) GROUP BY n.g, n.k, n.seen, n.now, n.i)
SELECT g, k, missing, round(centre, 6) AS adjusted FROM c QUALIFY row_number() OVER (PARTITION BY g ORDER BY i DESC) = 1"""
)
def trim_and_fill(spark, d):
    return meta.trim_and_fill(_studies(spark, d), "g").select("g", "k", "missing", F.round("adjusted", 6).alias("adjusted"))


@query(
    """WITH c AS (SELECT l_returnflag AS a, CASE WHEN l_quantity < 25 THEN 'A' ELSE 'N' END AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), t AS (SELECT sum(n) AS t, sum(n) FILTER (a = b) AS same FROM c),
e AS (SELECT sum(r.n * k.n) AS chance FROM (SELECT a, sum(n) AS n FROM c GROUP BY a) r JOIN (SELECT b, sum(n) AS n FROM c GROUP BY b) k ON r.a = k.b)
SELECT t::BIGINT AS n, round(same / t, 9) AS observed, round(chance / (t * t), 9) AS expected, round((same / t - chance / (t * t)) / (1 - chance / (t * t)), 9) AS kappa FROM t, e"""
)
def cohens_kappa(spark, d):
    x = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("a"), F.when(F.col("l_quantity") < 25, "A").otherwise("N").alias("b"))
    return curation.kappa(x).select("n", *[F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")])


@query(
    """WITH c AS (SELECT l_orderkey AS item, l_returnflag AS v, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), i AS (SELECT item, sum(n) AS m, sum(n * n) AS sq FROM c GROUP BY item HAVING sum(n) > 1),
o AS (SELECT sum((m * m - sq) / (m - 1)) AS inner_, sum(m) AS n FROM i), e AS (SELECT sum(n * n) AS sq FROM (SELECT v, sum(c.n) AS n FROM c JOIN i USING (item) GROUP BY v))
SELECT o.n::BIGINT AS n, round(1 - (inner_ / o.n) / ((o.n * o.n - sq) / (o.n * (o.n - 1))), 9) AS alpha FROM o, e"""
)
def krippendorffs_alpha(spark, d):
    x = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("item"), F.col("l_returnflag").alias("value"))
    return curation.alpha(x).select("n", F.round("alpha", 9).alias("alpha"))
