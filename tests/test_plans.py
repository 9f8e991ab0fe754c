"""What the physical plans must and must not hold."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import citations, journals, search, verify
from lectern.plans import adapters, catalogue, register  # noqa: F401 - the catalogue registers its queries

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("works") / "w")
    adapters.adapter("works")(spark, SF).withColumn("abstract", F.lit("long text")).write.parquet(path)
    return spark.read.parquet(path)


def test_search_is_one_pushed_scan_and_a_top_k(table):
    p = plan(search.search(table, search.Query(year_from=1996, type="F")).select("work_id", "cited_by_count"))
    assert "GreaterThanOrEqual(year,1996)" in p and "EqualTo(type,F)" in p
    assert "TakeOrderedAndProject" in p and "Exchange" not in p
    assert "abstract" not in p.split("ReadSchema")[-1]


def test_sources_are_one_scan_with_limits_before_the_shuffle(table):
    p = plan(search.search_each(table, search.Query(), ["urgent", "low"]))
    assert p.count("FileScan") == 1 and p.index("WindowGroupLimit") < p.rindex("Exchange") < p.rindex("WindowGroupLimit")


#: Joins of single rows.
SINGLE_ROWS = {"citation_network_counts", "cohens_kappa", "dedup_summary", "krippendorffs_alpha"}
#: Workbooks are zip files, which only Python opens.
WORKBOOKS = {"read_qualis_workbook"}


@pytest.mark.parametrize("name", sorted(set(register.QUERIES) - SINGLE_ROWS))
def test_no_query_has_a_cartesian_product(spark, name):
    p = plan(register.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", sorted(set(register.QUERIES) - WORKBOOKS))
def test_no_query_runs_python_on_rows(spark, name):
    p = plan(register.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert not any(x in p for x in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups"))


def test_pairs_are_made_within_citing_works_only(spark):
    edges = adapters.adapter("cites")(spark, SF)
    p = plan(citations.co_citations(edges))
    assert "citing" in p and "NestedLoop" not in p


def test_trends_scan_once(table):
    p = plan(verify.keyword_trends(table.withColumn("title", F.col("source_api")), ["urgent", "low"], 1995, 1998))
    assert p.count("FileScan") == 1


def test_top_journals_read_few_columns(spark):
    p = plan(register.QUERIES["top_journals_for_field"](spark, SF))
    assert "TakeOrderedAndProject" in p
    assert journals.top_for_field is not None
