"""The tools a literature researcher calls, over a library of tables.

Every call returns a DataFrame and collects none.  Most are lazily evaluated;
entity resolution and citation verification run in rounds, whose number
depends on the rows, so ``search_papers`` and the ``verify`` calls start jobs.
Single-item calls are one-row cases of the batch operators.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.identifiers import normalize_doi, normalize_issn, resolve_id
from lectern.functions.texts import has_all_tokens, titles_match
from lectern.operators import citations, dedup, fulltext, journals, search, verify
from lectern.schema import PAPER


def json_records(papers: DataFrame) -> DataFrame:
    """One JSON text a paper, without the fields that have their default."""
    kept = []
    for name, kind in PAPER.items():
        if name not in papers.columns:
            continue
        c = F.col(f"`{name}`")
        if kind == "string":
            c = F.nullif(c, F.lit(""))
        elif kind == "bigint":
            c = F.nullif(c, F.lit(0).cast("bigint"))
        elif kind == "boolean":
            c = F.when(c, c)
        elif kind.startswith("array"):
            c = F.when(F.size(c) > 0, c)
        kept.append(c.alias(name))
    return papers.select(F.to_json(F.struct(*kept)).alias("value"))


@dataclass(frozen=True)
class Library:
    """Tables: papers in the canonical schema from all sources, citations, rankings, and so on.

    ``edges`` has (citing, cited, ord, is_influential, intents, contexts) over
    work ids; a work id is the first identifier that a paper has of OpenAlex,
    Semantic Scholar, arXiv and DOI.
    """

    spark: SparkSession
    papers: DataFrame
    edges: DataFrame | None = None
    sjr: DataFrame | None = None
    qualis: DataFrame | None = None
    jql: DataFrame | None = None
    names: DataFrame | None = None
    journal_records: DataFrame | None = None
    retractions: DataFrame | None = None
    oa_locations: DataFrame | None = None

    def works(self) -> DataFrame:
        some = lambda c: F.nullif(F.col(c), F.lit(""))
        ident = F.coalesce(some("openalex_id"), some("s2_id"), some("arxiv_id"), F.lower(normalize_doi(some("doi"))))
        return self.papers.withColumn("work_id", ident)

    def _rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    # --- search ---
    def _found(self, query: str, sources: str, year_from: int | None, year_to: int | None, journal_issn: str | None, sort: str, per_page: int) -> tuple[DataFrame, DataFrame, list[str]]:
        """All papers that fit, those that the sources return, and the sources asked for."""
        wanted = [s.strip().lower() for s in sources.split(",") if s.strip().lower() in search.CAPS]
        q = search.Query(sort=sort.partition(":")[0].replace("publication_date", "year").replace("relevance_score", "cited_by_count"), per_page=per_page)
        api = F.lower(F.col("source_api"))
        years = search.year_between(F.col("year"), year_from, year_to)
        kept = has_all_tokens(F.concat_ws(" ", "title", "abstract"), query)
        kept = kept & ((api == "arxiv") | ((api == "semantic_scholar") & F.lit(bool(year_to and not year_from))) | years)
        if journal_issn:
            kept = kept & ((api != "openalex") | (normalize_issn(F.col("issn")) == normalize_issn(F.lit(journal_issn))))
        fits = self.works().where(kept & api.isin(wanted))
        found = search.search_each(fits, q, wanted)
        order = F.row_number().over(W.orderBy("source_order", "rank"))  # at most the sum of the caps
        return fits, found.withColumn("ord", order).withColumn("n_authors", F.size("authors")), wanted

    def search_papers(self, query: str, sources: str = "openalex,crossref", year_from: int | None = None, year_to: int | None = None, journal_issn: str | None = None, sort: str = "cited_by_count:desc", per_page: int = 25) -> DataFrame:
        """Papers of the sources, each capped, resolved to one row an entity, in source and rank order.

        Years don't restrict arXiv; the ISSN restricts OpenAlex only; an
        upper year alone doesn't restrict Semantic Scholar.
        """
        _, ranked, _ = self._found(query, sources, year_from, year_to, journal_issn, sort, per_page)
        return dedup.greedy(ranked, "ord").orderBy("first_order").select(*PAPER, "ord")

    def search_summary(self, query: str, sources: str = "openalex,crossref", year_from: int | None = None, year_to: int | None = None, journal_issn: str | None = None, sort: str = "cited_by_count:desc", per_page: int = 25) -> DataFrame:
        """What search_papers() found, in one row: total, returned, duplicates_removed, sources_queried, per_source.

        ``total`` counts all papers that fit, ``per_source`` those of each
        source that it returned before they were resolved.
        """
        fits, ranked, wanted = self._found(query, sources, year_from, year_to, journal_issn, sort, per_page)
        one = F.lit(1).alias("_one")
        kept = dedup.greedy(ranked, "ord").agg(F.count("*").alias("returned"), one)
        total = fits.agg(F.count("*").alias("total"), one)
        counts = ranked.groupBy(F.lower("source_api").alias("s")).agg(F.count("*").alias("n"))
        counts = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("raw"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("s", "n")))).alias("per_source"), one)
        x = total.join(kept, "_one").join(counts, "_one")
        return x.select("total", "returned", (F.col("raw") - F.col("returned")).alias("duplicates_removed"), F.array(*[F.lit(s) for s in wanted]).alias("sources_queried"), "per_source")

    def search_journal_papers(self, issn: str, query: str = "", year_from: int | None = None, year_to: int | None = None, per_page: int = 25) -> DataFrame:
        q = search.Query(text=query, year_from=year_from, year_to=year_to, issn=issn, per_page=per_page)
        return search.search(self.works(), q).select(*PAPER)

    # --- get ---
    def get_paper(self, identifier: str) -> DataFrame:
        """The paper with a DOI, arXiv, OpenAlex or Semantic Scholar id."""
        x = self.works()
        r = resolve_id(F.lit(identifier))
        bare = F.regexp_replace("arxiv_id", r"v\d+$", "")
        same = (
            ((r["id_type"] == "doi") & (F.lower(normalize_doi(F.col("doi"))) == F.lower(r["value"])))
            | ((r["id_type"] == "arxiv") & (bare == r["value"]))
            | ((r["id_type"] == "openalex") & (F.col("openalex_id") == r["value"]))
            | ((r["id_type"] == "s2") & (F.col("s2_id") == r["value"]))
        )
        return x.where(same).orderBy(F.col("openalex_id") == "", F.col("cited_by_count").desc(), "source_api").limit(1)

    def get_author(self, name: str, per_page: int = 20) -> DataFrame:
        """Works of the most cited author whose name contains the text."""
        x = self.works().withColumn("_a", F.explode("authors")).withColumn("author_id", F.coalesce(F.nullif("_a.openalex_id", F.lit("")), "_a.name")).withColumn("author", F.col("_a.name")).drop("_a")
        hits = x.where(F.lower("author").contains(name.lower()))
        first = hits.groupBy("author_id").agg(F.sum("cited_by_count").alias("_n")).orderBy(F.col("_n").desc(), "author_id").limit(1).select("author_id")
        mine = hits.join(F.broadcast(first), "author_id")  # one row
        return citations.author_works(mine, F.lit(True), per_page)

    def get_journal_info(self, issn_or_name: str) -> DataFrame:
        """The journal's record with its entry in each ranking, N/A where it has none."""
        hit = self.journal_records.where(journals.source_lookup(self.journal_records, F.lit(issn_or_name), "name", "issn_l")).orderBy("journal_id").limit(1)
        return journals.enriched(hit, self.sjr, self.qualis, self.jql)

    def get_citations(self, identifier: str, direction: str = "citing", per_page: int = 25) -> DataFrame:
        seed = self.get_paper(identifier).select("work_id")
        walk = citations.citing if direction == "citing" else citations.references
        return walk(self.edges, self.works(), seed, per_page)

    def get_keyword_trends(self, keywords: str, year_from: int = 2015, year_to: int = 2025, most: int = 5) -> DataFrame:
        return verify.keyword_trends(self.works(), [k.strip() for k in keywords.split(",")][:most], year_from, year_to)

    # --- rank ---
    def rank_journal(self, issn_or_name: str) -> DataFrame:
        return journals.rank(self._rows([(0, issn_or_name)], "qid int, q string"), journals.metrics(self.sjr, self.qualis, self.jql), self.names)

    def top_journals_for_field(self, field: str, limit: int = 20) -> DataFrame:
        return journals.top_for_field(self.sjr, self.qualis, self.jql, field, limit)

    # --- verify ---
    def _cited(self) -> DataFrame:
        """What citations are verified against: title, year, names of authors, DOI."""
        return self.works().select("work_id", "title", "year", "doi", F.array_join(F.transform("authors", lambda a: a["name"]), " ").alias("authors"))

    def verify_citation(self, author: str, year: int, title_fragment: str, strict: bool = False) -> DataFrame:
        """Whether a citation exists: author and title find the candidates, the title alone is tested."""
        return verify.verify(self._rows([(0, author, title_fragment, year)], "ref_id int, author string, title string, year int"), self._cited(), strict)

    def batch_verify_references(self, references_json: str, most: int | None = 30) -> DataFrame:
        """Status, DOI and closest title of each reference of a JSON list; a missing year is taken as 2000.

        Only a fitting title verifies here, as the year alone does for a
        single citation.
        """
        refs = json.loads(references_json)[:most]
        rows = [(i, r.get("author", ""), r.get("title", ""), int(r.get("year", 2000))) for i, r in enumerate(refs)]
        return verify.verify(self._rows(rows, "ref_id int, author string, title string, year int"), self._cited(), strict=True)

    def check_retraction(self, doi: str) -> DataFrame:
        return self.retractions.where(F.lower(normalize_doi(F.col("doi"))) == F.lower(normalize_doi(F.lit(doi))))

    # --- cite ---
    def get_influential_citations(self, identifier: str, limit: int = 20, most: int | None = 100) -> DataFrame:
        """Citations of a paper with their influence, intents and up to three contexts; ``most`` bounds the limit, None lifts it."""
        seed = self.get_paper(identifier).select(F.col("work_id").alias("cited"))
        hits = self.edges.join(seed, "cited").join(self.works(), F.col("citing") == F.col("work_id")).where("title <> ''")
        shown = hits.select("title", F.slice(F.transform("authors", lambda a: a["name"]), 1, 5).alias("authors"), "year", "doi", F.col("cited_by_count").alias("citation_count"), "is_influential", "intents", F.slice("contexts", 1, 3).alias("contexts"))
        return shown.orderBy(F.col("citation_count").desc(), "title").limit(limit if most is None else min(limit, most))

    def get_citation_context(self, citing: str, cited: str) -> DataFrame:
        """One row on the reference of one paper to another: found, and its influence, intents and contexts if there is one."""
        seed = self.get_paper(citing).select(F.col("work_id").alias("citing"))
        target = self.get_paper(cited).select(F.col("work_id").alias("cited"), F.col("title").alias("cited_title"))
        hits = self.edges.join(seed, "citing").join(target, "cited").select(F.struct("citing", "cited", "cited_title", "is_influential", "intents", "contexts").alias("x"))
        first = hits.agg(F.min_by("x", F.col("x.cited")).alias("x"))
        return first.select(F.col("x").isNotNull().alias("found"), "x.*")

    def _network(self, seed_dois: str, depth: int, max_nodes: int) -> tuple[DataFrame, DataFrame]:
        seeds = self._rows([(i, d.strip()) for i, d in enumerate(seed_dois.split(","))], "ord int, doi string")
        key = lambda c: F.lower(normalize_doi(c))
        found = seeds.join(self.works().select(key(F.col("doi")).alias("_k"), "work_id"), key(F.col("doi")) == F.col("_k")).select("ord", "work_id")
        return citations.network(self.edges.select("citing", "cited", "ord"), self.works(), found, depth, max_nodes)

    def build_citation_network(self, seed_dois: str, depth: int = 1, max_nodes: int = 100, most_edges: int | None = 200) -> tuple[DataFrame, DataFrame]:
        """Nodes with their paper's fields and level, and the first edges; citation_network_counts() has the full counts."""
        nodes, edges = self._network(seed_dois, depth, max_nodes)
        held = nodes.join(self.works().dropDuplicates(["work_id"]), "work_id").orderBy("level", "place").select("work_id", "level", *PAPER)
        edges = edges.orderBy("level", "place")
        return held, (edges if most_edges is None else edges.limit(most_edges)).select("citing", "cited")

    def citation_network_counts(self, seed_dois: str, depth: int = 1, max_nodes: int = 100) -> DataFrame:
        """(nodes_count, edges_count) of a network, all edges counted."""
        return citations.network_counts(*self._network(seed_dois, depth, max_nodes))

    def find_co_citation_clusters(self, dois: str, min_co_citations: int = 2, limit: int = 50, most: int = 20) -> DataFrame:
        wanted = [d.strip() for d in dois.split(",")][:most]
        if len(wanted) < 2:
            raise ValueError("at least two DOIs are needed")
        key = lambda c: F.lower(normalize_doi(c))
        asked = self._rows([(d,) for d in wanted], "doi string").select(key(F.col("doi")).alias("_k"))
        found = self.works().withColumn("_k", key(F.col("doi"))).join(asked, "_k").select("work_id").distinct()
        return citations.co_citations(self.edges.select("citing", "cited").distinct(), found, min_co_citations, limit)

    # --- full text ---
    def check_open_access(self, doi: str) -> DataFrame:
        return verify.open_access(self._rows([(doi,)], "doi string"), self.oa_locations)

    @staticmethod
    def extract_text(spans: DataFrame, limit: int = fulltext.LIMIT) -> DataFrame:
        """Markdown of documents from their positioned spans."""
        return fulltext.markdown(spans, limit=limit)

    def title_matches(self, fragment: str) -> DataFrame:
        return self.works().where(titles_match(F.col("title"), F.lit(fragment)))
