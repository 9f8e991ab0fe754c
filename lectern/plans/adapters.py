"""Bibliographic views of the star-schema tables.

Each adapter is one SQL text in the dialect that Spark and DuckDB share, so a
query and its oracle read the same rows.  Tables are named in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def _digits(key: str) -> str:
    return f"lpad(CAST({key} AS STRING), 8, '0')"


def _issn(key: str) -> str:
    return f"concat(substr({_digits(key)}, 1, 4), '-', substr({_digits(key)}, 5, 4))"


CITES = """
SELECT l_orderkey AS citing, l_partkey AS cited, min(l_linenumber) AS ord,
    max(l_quantity) > 40 AS is_influential, min(l_returnflag) AS intent
FROM {lineitem} WHERE l_orderkey <> l_partkey GROUP BY l_orderkey, l_partkey
"""

WORKS = f"""
SELECT o_orderkey AS work_id, concat('10.5555/w', CAST(o_orderkey AS STRING)) AS doi, CAST(year(o_orderdate) AS INT) AS year,
    o_custkey AS author_id, lower(substr(o_orderpriority, 3)) AS source_api, o_orderstatus AS type, {_issn('o_custkey')} AS issn,
    o_totalprice AS price, coalesce(n, 0) AS cited_by_count, coalesce(influential, 0) AS influential
FROM {{orders}} LEFT JOIN (SELECT cited, count(*) AS n, sum(CASE WHEN is_influential THEN 1 ELSE 0 END) AS influential
    FROM ({CITES}) GROUP BY cited) ON o_orderkey = cited
"""

SJR_RAW = f"""
SELECT p_partkey AS pos, p_name AS Title, concat({_digits('p_partkey')}, ', ', {_digits('p_partkey + 50000000')}) AS Issn,
    replace(CAST(p_retailprice AS STRING), '.', ',') AS SJR, concat('Q', CAST(p_size % 5 AS STRING)) AS `SJR Best Quartile`,
    CAST(p_size AS STRING) AS `H index`, p_brand AS Country, p_type AS Areas, 'journal' AS Type, p_brand AS Publisher
FROM {{part}}
"""

QUALIS_RAW = f"""
SELECT s_suppkey AS pos, {_digits('s_suppkey * 3')} AS issn, s_name AS titulo, CASE s_nationkey % 9 WHEN 0 THEN 'A1' WHEN 1 THEN 'A2'
    WHEN 2 THEN 'A3' WHEN 3 THEN 'A4' WHEN 4 THEN 'B1' WHEN 5 THEN 'B2' WHEN 6 THEN 'B3' WHEN 7 THEN 'B4' ELSE 'C' END AS estrato,
    n_name AS area
FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey
"""

JQL_RAW = f"""
SELECT c_custkey AS pos, {_issn('c_custkey * 2')} AS issn, c_name AS journal, c_mktsegment AS subject, '' AS ft2016, '' AS cnrs2020, '' AS hceres2021,
    CASE c_custkey % 6 WHEN 0 THEN '4*' WHEN 1 THEN '4' WHEN 2 THEN '3' WHEN 3 THEN '2' WHEN 4 THEN '1' ELSE '' END AS ajg_abs2024,
    '' AS abdc2025, '' AS fnege2025, '' AS vhb2024, '' AS scopus2024
FROM {{customer}}
"""

PAPERS = """
SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, CASE WHEN doc_id % 2 = 0 THEN concat('10.5555/', md5(text)) ELSE '' END AS doi,
    CAST(2000 + doc_id % 20 AS INT) AS year, source AS source_api, text AS abstract, CAST(doc_id % 3 AS INT) AS n_authors,
    n_chars AS cited_by_count, lang AS journal, concat('author', CAST(doc_id % 40 AS STRING)) AS authors
FROM {documents}
"""

REFS = """
SELECT item_id AS ref_id, split_part(text, '.', 1) AS title, CAST(2000 + item_id % 20 AS INT) AS year, concat('author', CAST(item_id % 60 AS STRING)) AS author
FROM {benchmark}
"""

CACHE_LOG = """
SELECT concat(CAST(user_id AS STRING), ':', event_type) AS key, event_type AS entity_type, props AS value, ts AS created_at, event_id,
    CASE event_type WHEN 'click' THEN 3600 WHEN 'view' THEN 86400 ELSE 604800 END AS ttl
FROM {events}
"""

ALL = {
    "cites": CITES,
    "works": WORKS,
    "sjr_raw": SJR_RAW,
    "qualis_raw": QUALIS_RAW,
    "jql_raw": JQL_RAW,
    "papers": PAPERS,
    "refs": REFS,
    "cache_log": CACHE_LOG,
}


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The SQL text over the tables that it names."""
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def adapter(name: str):
    def load(spark: SparkSession, sf_dir: str) -> DataFrame:
        return frame(spark, sf_dir, ALL[name])

    return load


def duckdb(sql: str) -> str:
    """The same text for DuckDB."""
    return re.sub(r"\{(\w+)\}", r"\1", sql).replace("`", '"')


def ctes(*names: str) -> str:
    """WITH clause of adapters for an oracle."""
    return "WITH " + ",\n".join(f"{n} AS ({duckdb(ALL[n])})" for n in names)
