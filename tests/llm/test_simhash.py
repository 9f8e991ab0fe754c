import numpy as np
import xxhash

from lectern.llm import registry, simhash
from lectern.llm.components import components


def brute(text):
    words = (text or "").encode()
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in words)
    import re

    w = re.findall(rb"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprint():
    for t in ("", " \n", "One", "one TWO", "a b c", "Ünï A b\x0bc\td e\xa0f " * 9, None):
        assert simhash.fingerprint((t or "").encode()) == brute(t)


def test_query_equals_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    fps = {i: brute(t) for i, t in texts.items()}
    want = brute_components(fps)
    rows = registry.op6_simhash(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == want[r.doc_id]


def _through(fps):
    import pyarrow as pa

    rows = []
    for mask, places in simhash.CHOICES:
        for x in fps:
            rows.append((mask << 32 | sum(((x >> 8 * p) & 255) << 8 * i for i, p in enumerate(places)), x))
    rows.sort()
    k = np.array([r[0] for r in rows], np.int64)
    x = np.array([r[1] for r in rows], np.uint64).view(np.int64)
    out = []
    for i in range(0, len(k), 97):
        out.append(pa.RecordBatch.from_arrays([pa.array(k[i : i + 97]), pa.array(x[i : i + 97])], names=["k", "fp"]))
    found = [r for batch in simhash._link_postings(iter(out)) for r in batch.to_pylist()]
    # long postings are dealt by each byte that they don't fix, as link() does
    long = sorted((r["k"], p << 8 | (r["a"] >> 8 * p) & 255, r["a"]) for r in found if r["k"] is not None for p in range(8) if p >= simhash.POSITIONS or not r["k"] >> 32 >> p & 1)
    again = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*long[i : i + 97], strict=True)], names=["k", "v", "fp"]) for i in range(0, len(long), 97)]
    found = [r for r in found if r["k"] is None] + [r for batch in simhash._link_splits(iter(again)) for r in batch.to_pylist()]
    links = [(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in found]
    root = {x: x for x in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in fps}, links


def test_links_connect_what_brute_force_connects(monkeypatch):
    rng = np.random.default_rng(5)
    centres = [int(c) for c in rng.integers(0, 1 << 63, 12)]
    fps = set()
    for _ in range(600):
        x = centres[rng.integers(12)]
        for b in rng.choice(64, rng.integers(0, 6), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    want = {fps[i]: fps[r] for i, r in brute_components(dict(enumerate(fps))).items()}
    assert _through(fps)[0] == want
    monkeypatch.setattr(simhash, "SHORT", 3)
    assert _through(fps)[0] == want
    monkeypatch.setattr(simhash, "MEDIUM", 4)
    assert _through(fps)[0] == want


def test_a_long_text_in_blocks_has_the_same_fingerprint():
    rng = np.random.default_rng(2)
    text = " ".join(f"W{i}x" for i in rng.integers(0, 50, 400)) + "\x0b" + "q" * 90 + " é end"
    for block in (1, 7, 64, 1 << 20):
        assert simhash.fingerprint(text.encode(), block=block) == brute(text)
    assert simhash.fingerprint(b"a " * 2, block=1) == brute("a a")


def test_long_postings_are_dealt_by_a_fifth_byte(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHORT", 2)
    monkeypatch.setattr(simhash, "MEDIUM", 3)
    rng = np.random.default_rng(9)
    centres = [int(c) for c in rng.integers(0, 1 << 62, 4)]
    fps = sorted({centres[rng.integers(4)] ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False)) for _ in range(250)})
    want = {fps[i]: fps[r] for i, r in brute_components(dict(enumerate(fps))).items()}
    rooted = simhash._rooted(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    assert {r.fp: r.root for r in rooted} == want


def test_each_pair_is_linked_once():
    _, links = _through([5, 4, 7, 255 << 40])
    assert sorted(tuple(sorted(x)) for x in links) == [(4, 5), (4, 7), (5, 7)]


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(100, 130)]
    star = [(7, i) for i in range(8, 60)]
    rows = path + star + [(1, 1), (501, 500), (500, 501)]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 131)}, **{i: 7 for i in range(7, 60)}, 500: 500, 501: 500}


def test_edges(spark):
    rows = [(5, None, 1), (3, "", 1), (None, " ", 1), (9, "some words of a text", 1), (9, "some words of a text", 1), (2, "quite another text is this one here", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.cluster(df).collect())
    assert got == [(-1, 3), (2, 2), (3, 3), (5, 3), (9, 9), (9, 9)]
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [2, 3, 9]  # the null id has no words either
    assert simhash.cluster(df.limit(0)).count() == 0


def test_repeated_ids_of_different_texts_lose_none(spark):
    a, b, c = ("alpha beta gamma delta epsilon", "one two three four five six", "red green blue black white")
    rows = [(1, a, "x"), (1, b, None), (1, b, None), (2, b, "x"), (3, c, "x"), (3, c, "y"), (2, c, "x"), (4, a, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = {(1, a, "x"), (1, b, None), (2, c, "x")}
    for parts in (1, 5):
        got = [tuple(r) for r in simhash.deduplicate(df.repartition(parts)).collect()]
        assert len(got) == len(want) and set(got) == want
