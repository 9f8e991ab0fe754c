import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import identifiers, ranking, texts
from lectern.operators import cache, dedup, journals, meta, verify


def column(spark, expr, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalize(spark):
    assert column(spark, identifiers.normalize_doi, "https://doi.org/10.1/A", "HTTP://DOI.ORG/10.1/A", " doi:10.1/A", "10.1/A", "") == ["10.1/A"] * 4 + [""]
    assert column(spark, identifiers.normalize_issn, "00014273", "0001-4273", " 1234567x ", "123") == ["0001-4273", "0001-4273", "1234-567X", "123"]


def test_resolve_id(spark):
    got = column(spark, identifiers.resolve_id, "https://doi.org/10.1/x", "10.1/x", "arXiv:2401.12345v2", "2401.1234", "https://openalex.org/W12", "w12", "a" * 40, "hello")
    assert [(r.id_type, r.value) for r in got] == [("doi", "10.1/x"), ("doi", "10.1/x"), ("arxiv", "2401.12345"), ("arxiv", "2401.1234"), ("openalex", "W12"), ("openalex", "W12"), ("s2", "a" * 40), ("unknown", "hello")]


def test_best_tier(spark):
    rows = [("Q1", "", ""), ("Q9", None, None), (None, "B2", "2"), ("Q4", "A1", "4*"), ("", "", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q string, c string, a string")
    got = [r.t for r in df.select("i", ranking.best_tier(F.col("q"), F.col("c"), F.col("a")).alias("t")).orderBy("i").collect()]
    assert got == ["A", "D", "C", "S", "unknown"]
    assert column(spark, ranking.sjr_number, "15,5", "12.4", "1.234,5", "", None) == [15.5, 12.4, 0.0, 0.0, 0.0]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("percent,strict", [(90, True), (85, False)])
def test_similarity(spark, percent, strict):
    rng = random.Random(percent)
    pairs = [("", ""), ("", "a"), ("machine learning in medicine", "machine learning in medicin"), ("abc", "xyz")]
    for _ in range(300):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 30)))
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r.y for r in df.select("i", texts.similarity_at_least(F.col("a"), F.col("b"), percent, strict).alias("y")).orderBy("i").collect()]
    for (a, b), y in zip(pairs, got, strict=True):
        score, need = 200 * lcs(a, b), percent * (len(a) + len(b))
        assert y == ((score > need if strict else score >= need) and len(a) + len(b) > 0), (a, b)


def test_similarity_of_accented_texts_equals_sql(spark):
    import duckdb

    from lectern.plans.catalogue import similar_sql

    rng = random.Random(5)
    pairs = [("", "", 0)]
    for i in range(300):
        a = [rng.choice("abcdéóñü ") for _ in range(rng.randint(20, 60))]
        b = list(a)
        for at in rng.sample(range(len(b)), rng.randint(0, len(b) // 8)):
            b[at] = rng.choice(["", "e", "é", "ß"]) if rng.random() < 0.7 else b[at] + "ñ"
        pairs.append(("".join(a), "".join(b), i))
    df = spark.createDataFrame(pairs, "a string, b string, i int")
    got = {r.i: r.y for r in df.select("i", texts.similarity_at_least(F.col("a"), F.col("b"), 90, True).alias("y")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE p (a VARCHAR, b VARCHAR, i INT)")
    con.executemany("INSERT INTO p VALUES (?, ?, ?)", pairs)
    assert got == dict(con.execute(f"SELECT i, {similar_sql('a', 'b', 90, True)} FROM p").fetchall())


def naive_greedy(rows):
    """Rows (id, title, doi, year, abstract) kept by the plain loop."""
    best, order, rest = {}, [], []
    score = lambda r: 3 * bool(r[2]) + 2 * bool(r[4]) + bool(r[3])
    for r in rows:
        key = r[2].lower().strip()
        if not key:
            rest.append(r)
        elif key not in best:
            best[key] = r
            order.append(key)
        elif score(r) > score(best[key]):
            best[key] = r
    kept = [best[k] for k in order]
    for r in rest:
        t = r[1].strip().lower()
        like = lambda o, r=r, t=t: o[1].strip() and not (r[3] and o[3] and r[3] != o[3]) and 200 * lcs(t, o[1].strip().lower()) > 90 * (len(t) + len(o[1].strip()))
        if not t or not any(like(o) for o in kept):
            kept.append(r)
    return sorted(r[0] for r in kept)


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_dedup_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    stems = ["deep learning for protein folding", "a survey of graph neural networks", "on the origin of spreadsheets"]
    rows = []
    for i in range(60):
        t = list(rng.choice(stems))
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice("abcxyz ")
        rows.append((i, "".join(t) if rng.random() > 0.05 else " ", rng.choice(["", "", "10.1/A", "10.1/a", f"10.2/{i}"]), rng.choice([None, 0, 2001, 2002]), rng.choice(["", "x"])))
    df = spark.createDataFrame(rows, "id int, title string, doi string, year int, abstract string")
    df = df.withColumn("n_authors", F.lit(0)).withColumn("cited_by_count", F.lit(0)).withColumn("journal", F.lit(""))
    assert sorted(r.id for r in dedup.greedy(df, "id").collect()) == naive_greedy(rows)


def test_titles_match(spark):
    rows = [("AI Adoption Government", "Exploring AI adoption in government agencies"), ("", "x"), ("one two", "two three"), ("a b c", "c b a")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    assert [r.y for r in df.select("i", texts.titles_match(F.col("a"), F.col("b")).alias("y")).orderBy("i").collect()] == [True, True, False, True]


def test_cache_put_and_expiry(spark):
    schema = "key string, value string, created_at timestamp, expires_at timestamp"
    table = spark.sql("select 'a' key, 'old' value, timestamp'2024-01-01' created_at, timestamp'2024-01-02' expires_at union all select 'b', 'b', timestamp'2024-01-01', timestamp'2024-03-01'")
    new = spark.sql("select 'a' key, 'new' value, timestamp'2024-01-05' created_at, timestamp'2024-01-06' expires_at")
    after = cache.put(table, new)
    assert {r.key: r.value for r in after.collect()} == {"a": "new", "b": "b"}
    now = F.lit("2024-01-05 12:00:00").cast("timestamp")
    assert {r.key for r in cache.live(after, now).collect()} == {"a", "b"} and {r.key for r in cache.expired(table, now).collect()} == {"a"}
    assert table.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
    ttl = spark.sql("select timestamp'2024-01-01' t, 'journal' k").select(cache.expires_at(F.col("t"), F.col("k")).alias("e")).first().e
    assert str(ttl) == "2024-01-31 00:00:00"


def test_strict_verification(spark):
    works = spark.createDataFrame([(1, "entirely other words here", 2020)], "work_id long, title string, year int")
    refs = spark.createDataFrame([(7, "words about trees", 2020), (8, "nothing shared", 1990)], "ref_id long, title string, year int")
    assert {(r.ref_id, r.verified, r.confidence) for r in verify.verify(refs, works).collect()} == {(7, True, "medium"), (8, False, "none")}
    assert {(r.ref_id, r.verified, r.confidence) for r in verify.verify(refs, works, strict=True).collect()} == {(7, False, "low"), (8, False, "low")}


def test_lcs_of_texts_of_any_length(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcde😀é ") for _ in range(n))
    pairs = [(word(rng.randrange(n)), word(rng.randrange(n))) for n in (2, 30, 130, 200) for _ in range(15)] + [("", "a"), ("a", ""), ("x" * 60, "x" * 61), ("x" * 121, "x" * 121)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r.n for r in df.select("i", texts.lcs_length(F.col("a"), F.col("b")).alias("n")).collect()}
    assert [got[i] for i in range(len(pairs))] == [lcs(a, b) for a, b in pairs]


def test_ranks_within_tiers_of_any_share(spark):
    from lectern.operators import curation

    rng = random.Random(3)
    rows = [(i, rng.choice(["A", "A", "A", "B", None]), rng.randrange(4), rng.randrange(5)) for i in range(400)]
    df = spark.createDataFrame(rows, "work_id int, tier string, influential int, cited_by_count int").repartition(7)
    got = {r.work_id: r.rank for r in curation.by_influence(df).collect()}
    for tier in ("A", "B", None):
        own = sorted((r for r in rows if r[1] == tier), key=lambda r: (-r[2], -r[3], r[0]))
        assert [got[r[0]] for r in own] == list(range(1, len(own) + 1))


def test_partial_names_equal_brute_force(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["acta", "of", "soil", "letters", "bio", "journal", "x"])
    titles = [(" ".join(word() for _ in range(rng.randrange(0, 4))), f"i{n}", n) for n in range(120)]
    queries = [(n, " ".join(word() for _ in range(rng.randrange(1, 6)))) for n in range(80)]
    t, q = spark.createDataFrame(titles, "title string, issn string, pos int"), spark.createDataFrame(queries, "qid int, q string")
    got = {r.qid: r.issn for r in journals.by_partial_name(q, t).collect()}
    want = {}
    for i, n in queries:
        hits = [(p, issn) for title, issn, p in titles if title and len(n) > 10 and (n in title or title in n)]
        if hits:
            want[i] = min(hits)[1]
    assert got == want


def test_partial_names_broadcast_no_grams(spark, tmp_path):
    spark.createDataFrame([("soil letters", "i1", 1), ("acta", "i2", 2)], "title string, issn string, pos int").write.parquet(str(tmp_path / "t"))
    q = spark.createDataFrame([(1, "the soil letters quarterly"), (2, "the soil letters quarterly"), (2, "the soil letters quarterly")], "qid int, q string")
    x = journals.by_partial_name(q, spark.read.parquet(str(tmp_path / "t")))
    joins = x._jdf.queryExecution().sparkPlan().toString()
    assert joins.count("BroadcastHashJoin") == 1 and "BroadcastHashJoin [size" in joins  # the sizes, at most g rows
    assert sorted((r.qid, r.issn) for r in x.collect()) == [(1, "i1"), (2, "i1")]


@pytest.mark.parametrize("own", [True, False])
def test_similar_pairs_equal_brute_force(spark, own):
    rng = random.Random(11)
    stems = ["".join(rng.choice("abcdeéó ") for _ in range(n)) + "x" for n in (12, 40, 160, 170, 300)]

    def rows(first):
        out = []
        for i in range(first, first + 70):
            t = list(rng.choice(stems))
            for at in rng.sample(range(len(t)), rng.randint(0, len(t) // 9)):
                t[at] = rng.choice(["", "z", t[at] + "q"])
            out.append((i, "".join(t).strip() if rng.random() > 0.05 else "", rng.choice([None, 0, 2001, 2001, 2002])))
        return out + [(first + 70 + i, *out[i][1:]) for i in range(9)]  # copies

    left = rows(0)
    right = left if own else rows(500)
    frame = lambda x: spark.createDataFrame(x, "id int, t string, year int")
    a = frame(left)
    got = [tuple(r) for r in dedup.similar_pairs(a, a if own else frame(right), F.col("b") < F.col("a") if own else F.lit(True)).collect()]
    octets = lambda t: t.encode().decode("latin-1")

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            new = [i]
            for j, d in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return row[-1]

    want = []
    for i, t, y in left:
        for j, u, z in right:
            n = len(t) + len(u)
            if t and u and (j < i or not own) and not (y and z and y != z) and abs(len(t) - len(u)) <= n // 10:
                if t == u or 200 * lcs(t, u) > 90 * n and edits(octets(t), octets(u)) <= 10 * n // 100:
                    want.append((i, j))
    assert want and sorted(got) == sorted(want)


def test_unlike_texts_are_told_apart_before_the_edit_distance(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("abcdefghij ") for _ in range(200)), 2001) for i in range(30)]
    a = spark.createDataFrame(rows, "id int, t string, year int")
    p = dedup.similar_pairs(a, a, F.col("b") < F.col("a"))
    assert p.count() == 0
    text = dedup._lettered(dedup._texts(a, ()))
    names = text.columns
    both = text.select(*[F.col(c).alias(f"{c}a") for c in names]).crossJoin(text.select(*[F.col(c).alias(f"{c}b") for c in names])).where("ta < tb")
    apart = sum((F.abs(F.col(f"c{i}a") - F.col(f"c{i}b")) for i in range(len(dedup.LETTERS) + 1)), F.lit(0))
    grams = F.size("gramsa") + F.size("gramsb") - 2 * F.size(F.array_intersect("gramsa", "gramsb"))
    assert both.where((100 * apart < 10 * 400) & (100 * grams < 7 * 10 * 400)).count() == 0


def test_more_complete_papers_of_one_first_author(spark):
    title = "the long title of a paper on frozen soil"
    rows = [(1, title, 2001, " Maar ", "", 0), (2, title + "s", 2001, "maar", "10.1/x", 3), (3, title, 2001, "Okoro", "10.1/y", 9), (4, title, None, "MAAR", "", 0), (5, title, 2002, "Maar", "", 0), (6, title, 2001, None, "", 0)]
    df = spark.createDataFrame(rows, "id int, title string, year int, first_author string, doi string, cited_by_count int").selectExpr("*", "'' AS abstract", "1 AS n_authors", "'' AS journal")
    assert sorted(tuple(r) for r in dedup.by_first_author(df, "id").collect()) == [(1, 2), (4, 2)]


def test_no_folder_of_one_machine_on_a_cluster(tmp_path):
    from types import SimpleNamespace as Of

    from lectern.folders import shared_folder

    made = []
    context = lambda master, own: Of(master=master, setCheckpointDir=made.append, _jsc=Of(sc=lambda: Of(getCheckpointDir=lambda: Of(isDefined=lambda: bool(own or made), get=lambda: own or made[-1]))))
    session = lambda at, master="yarn", own=None: Of(conf=Of(get=lambda name, other: at), sparkContext=context(master, own))
    assert shared_folder(session("hdfs:///shared/")) == "hdfs:///shared" and shared_folder(session(None, own="s3://x/y")) == "s3://x/y"
    for master in ("yarn", "spark://a:7077", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session(None, master))
    assert shared_folder(session(None, "local[4]")) == made[0]


def test_title_fragment_is_tested_alone(spark):
    works = spark.createDataFrame([(1, "AI Adoption in Government", 2023, "Ann Doe", "10.1/x")], "work_id long, title string, year int, authors string, doi string")
    asked = [(1, "", "AI Adoption", 2023), (2, "Doe", "AI Adoption", 2023), (3, "Doe", "AI Adoption", 2022), (4, "Doe", "Public Sector", 2023), (5, "Doe", "Public Sector", 2022), (6, "Poe", "Forests", 2023)]
    refs = spark.createDataFrame(asked, "ref_id long, author string, title string, year int")
    got = {r.ref_id: (r.verified, r.confidence, r.doi, r.matched_title) for r in verify.verify(refs, works).collect()}
    found = "AI Adoption in Government"
    assert [got[i] for i in (1, 2, 3)] == [(True, "high", "10.1/x", found)] * 3
    assert got[4] == (True, "medium", "10.1/x", found)  # the author alone, of the very year
    assert got[5] == (False, "none", "", found) and got[6] == (False, "none", "", "")
    assert not any(r.verified for r in verify.verify(refs.where("ref_id > 3"), works, strict=True).collect())


@pytest.mark.parametrize("rows", [20_000, 0])
def test_candidates_equal_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(verify, "BROADCAST_ROWS", rows)
    rng = random.Random(2)
    words = ["the"] * 20 + ["of"] * 10 + [f"w{i}" for i in range(40)]
    title = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 7)))
    works = [(i, title(), 2000 + rng.randrange(4)) for i in range(150)]
    refs = [(i, title(), 2000 + rng.randrange(4)) for i in range(60)]
    df = lambda x, c: spark.createDataFrame(x, f"{c} long, title string, year int")
    got = {r.ref_id: r for r in verify.candidates(df(refs, "ref_id"), df(works, "work_id")).collect()}
    for i, t, y in refs:
        for name, slack in (("near", 1), ("same", 0)):
            each = [(-len(set(t.split()) & set(u.split())), j) for j, u, z in works if abs(y - z) <= slack and set(t.split()) & set(u.split())]
            have = got[i][name] if i in got else None
            assert ((-have.overlap, have.work_id) if have else None) == min(each, default=None), (i, name)


def test_random_effects_of_equal_studies(spark):
    df = spark.createDataFrame([("g", 0.5, 0.1)] * 4, "g string, effect double, se double")
    r = meta.random_effects(df, "g").first()
    assert (r.k, r.tau2, r.i2) == (4, 0.0, 0.0) and abs(r.pooled - 0.5) < 1e-12 and abs(r.pooled_se - 0.05) < 1e-12


def test_no_cartesian_product_in_rank_lookup(spark):
    names = spark.createDataFrame([("journal of finance", "0022-1082", 0, 0)], "name string, issn string, first_pos long, system int")
    q = spark.createDataFrame([(1, "Journal of Finanse"), (2, "zzz")], "qid long, q string")
    x = journals.by_similar_name(q, names)
    assert "CartesianProduct" not in x._jdf.queryExecution().toString() and [(r.qid, r.issn) for r in x.collect()] == [(1, "0022-1082")]
