import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.llm import host_rules, mixing, registry, shared, urls
from tests.oracle import compare

NULLS = [(None, None, None), (1, "", "a"), (1, "", "a"), (2, "x " * 30, None), (3, "the same eight words come here again and " * 4, "a")]


def test_host_rules_edges(spark):
    df = spark.createDataFrame([(*r, 7) for r in NULLS], "doc_id long, text string, source string, n_words int")
    rows = host_rules.judge(df).collect()
    assert len(rows) == 5 and all(r.n_words == 0 and r.base_failed and not r.kept for r in rows if r.doc_id in (None, 1))
    assert next(r for r in rows if r.doc_id == 2).n_repeat_words == 30
    assert next(r for r in rows if r.doc_id == 3).n_repeat_words == 32
    assert host_rules.judge(df.limit(0)).count() == 0


def test_a_bad_host_loses_its_good_documents_too(spark):
    good = "every word in this line is here only once so that no rule could fail on it at all today"
    rows = [(i, "x", "bad") for i in range(200)] + [(1000, good, "bad"), (1001, good, "fine")] + [(2000 + i, good, "fine") for i in range(200)]
    out = {r.doc_id: r for r in host_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not out[1000].kept and out[1000].host_rejected and out[1001].kept


def test_mixing_edges(spark):
    df = spark.createDataFrame([(*r, 1, 2) for r in NULLS], "doc_id long, text string, source string, copy int, rate int")
    out = mixing.replicate(df, size=3.0).collect()
    assert all(1 <= r.copy <= r.n_copies for r in out)
    assert mixing.replicate(df.limit(0)).count() == 0
    assert mixing.replicate(df, weights={"zzz": 1.0}).count() == 0


@pytest.mark.parametrize("ident", ["cast(null as long)", "7L"])
def test_texts_under_one_id_draw_for_themselves(spark, ident):
    df = spark.range(4000).selectExpr(f"{ident} AS doc_id", "concat('text ', id) AS text", "'a' AS source", "1 AS COPY", "2 AS _source", "3 AS `a.b`")
    out = mixing.replicate(df, size=1.0)
    assert out.columns == ["doc_id", "text", "source", "_source", "a.b", "rate", "n_copies", "copy", "shuffle_key"]
    rows = out.select("n_copies", "shuffle_key").collect()
    assert abs(len(rows) - 4000) < 300 and len({r.shuffle_key for r in rows}) == len(rows) and len({r.n_copies for r in rows}) > 3


def test_a_large_lookup_splits_its_hot_keys(spark, monkeypatch):
    """The ways beyond the broadcast bound give the same rows."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('w ', id % 7, repeat(' some words', 12)) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN null ELSE concat('s', id % 40) END AS source")
    pages = spark.range(3000).selectExpr("id AS page_id", "CASE WHEN id % 3 = 0 THEN concat('http://hot.org/de/', id) ELSE concat('http://h', id % 40, '.com/', IF(id % 2 = 0, 'de', 'fr'), '/') END AS url")
    rules = [("allow", "com/fr/"), ("block", "com/de/")]
    runs = [
        lambda: mixing.replicate(docs).drop("shuffle_key"),
        lambda: host_rules.judge(docs).select("doc_id", "kept", "n_words"),
        lambda: urls.judge(pages, rules),
    ]
    before = [sorted(map(str, f().collect())) for f in runs]
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(shared, "HOT_ROWS", 100)
    assert [sorted(map(str, f().collect())) for f in runs] == before
    # a hot key's rows are in several places, though all other columns follow from it
    x = spark.range(2000).selectExpr("'k' AS `the.key`", "id AS v")
    small = spark.createDataFrame([("k", 1), ("l", 2)], "`the.key` string, y int")
    got = shared.attach(x, small, "the.key", 2)
    assert got.where("y = 1").count() == 2000 and "_ways" not in got.columns


def test_mixing_meets_its_weights(spark):
    rows = [(i, "t", "big" if i % 10 else "small") for i in range(20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    n = Counter(r.source for r in mixing.replicate(df, weights={"big": 1, "small": 1}, size=1.0).select("source").collect())
    assert abs(n["big"] - 10000) < 500 and abs(n["small"] - 10000) < 500
    large = mixing.replicate(df.where("source = 'small'"), size=40.0).groupBy("doc_id").count().collect()
    mean = sum(r["count"] for r in large) / 2000
    var = sum((r["count"] - mean) ** 2 for r in large) / 2000
    assert abs(mean - 40) < 1 and abs(var - 40) < 6


def test_mixing_is_one_distribution(spark):
    t = spark.range(1).selectExpr("3.0D as rate").select(mixing._table(__import__("pyspark.sql.functions", fromlist=["x"]).col("rate")).alias("c")).first().c
    assert abs(t[0] - math.exp(-3)) < 1e-15 and abs(t[-1] - 1) < 1e-12


def test_urls_edges(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.ORG/x?y"), (4, "http://org"), (5, "http://m.example.org/es/"), (6, "http://example.org/en/12#t"), (None, "http://forg/"), (7, "http://x.com/de/http://org/")]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, host string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]).collect()}
    assert out[1][:3] == ("", "", None) and out[2][:3] == ("", "", None)
    assert out[3] == ("a.org", "/x", "org/", "allow") and out[4][:3] == ("org", "", None)
    assert out[5][2:] == ("example.org/es/", "block") and out[6][2:] == ("example.org/en/1", "block")
    assert out[None][2] is None and out[7][2] == "com/de/"
    assert urls.judge(df.limit(0), []).count() == 0


def test_an_unlabelled_host_follows_its_domain(spark):
    rows = [(i, f"http://h{i % 3}.bad.example/de/{i}") for i in range(300)] + [(1000, "http://h9.bad.example/en/"), (1001, "http://h.good.example/en/")]
    rows += [(2000 + i, f"http://h.good.example/fr/{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    out = {r.page_id: r.verdict for r in urls.judge(df, [("block", "bad.example/de/"), ("allow", "good.example/fr/")]).collect()}
    assert out[1000] == "block" and out[1001] == "allow"


def test_hosts_with_ports_users_addresses_and_long_suffixes(spark, tmp_path):
    hosts = ["a.b.co.uk", "b.co.uk", "co.uk", "x.b.co.uk:8080", "u:p@a.b.co.uk", "1.2.3.4", "1.2.3.4:80", "9.2.3.4", "shop.example.com", "example.com:443", "localhost", "", "a.com.br", "b.com.br"]
    rows = [(i, f"http://{h}/{'de' if i % 3 else 'fr'}/{i}") for i, h in enumerate(hosts * 40)]
    spark.createDataFrame([*rows, (9000, None)], "page_id long, url string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    assert compare(spark, str(tmp_path), registry.QUERIES["op9_urls"], registry.ORACLES["op9_urls"]) == len(rows) + 1
    place = F.col("h")
    got = {r.h: (r.s, r.d) for r in spark.createDataFrame([(h,) for h in hosts], "h string").select("h", urls._place(place).alias("p")).select("h", urls._suffix(F.col("p"), urls.Reputation.suffixes).alias("s"), "p").select("h", "s", urls._domain(F.col("p"), F.col("s")).alias("d")).collect()}
    assert got["x.b.co.uk:8080"] == got["u:p@a.b.co.uk"] == got["b.co.uk"] == ("co.uk", "b.co.uk") and got["co.uk"] == ("co.uk", "co.uk")
    assert got["1.2.3.4:80"] == ("1.2.3.4", "1.2.3.4") and got["shop.example.com"] == got["example.com:443"] == ("com", "example.com") and got["localhost"] == ("localhost", "localhost")
