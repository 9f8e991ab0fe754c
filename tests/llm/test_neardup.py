import random

import numpy as np
import pytest

import corpus_pipeline
from lectern.llm import neardup, shingle_kernel


def sets(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, percent=80):
    """Ids that are the smallest of their component."""
    all_ = {i: sets(t) for i, t in rows}
    ids = sorted(all_)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            x, y = all_[i], all_[j]
            if 100 * len(x & y) >= percent * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [i for i in ids if find(i) == i]


def test_stage_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = sorted(r.doc_id for r in corpus_pipeline.remove_near_duplicates(spark, docs, sf_dir).collect())
    assert got == want


@pytest.mark.parametrize(("short", "share", "stars"), [(16, 4096, 16), (2, 5, 2), (2, 7, 0)])
def test_edited_copies_equal_brute_force(spark, monkeypatch, short, share, stars):
    monkeypatch.setattr(neardup, "SHORT", short)
    monkeypatch.setattr(neardup, "SHARE", share)
    monkeypatch.setattr(neardup, "STARS", neardup.STARS[:stars] or [tuple(range(6))])
    rng = random.Random(7)
    line = " ".join(f"common{i}" for i in range(30))
    rows = [(1000, ""), (1001, None), (1002, "One"), (1003, "one"), (1004, "a b c d"), (1005, "a b c d e f g h i"), (1006, "a b c d e f g h")]
    for c in range(12):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([30, 120, 300]))]
        for _ in range(rng.choice([1, 3, 40])):
            own = list(words)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = f"edit{rng.random()}"
            rows.append((len(rows), " ".join(own) + rng.choice(["", " " + line])))
    got = neardup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == brute(rows)


def test_threshold_is_exact(spark):
    # 40 shingles and 32 of them: 0.8; 41 and 32 of them: below
    words = [f"w{i}" for i in range(45)]
    rows = [(1, " ".join(words[:44])), (2, " ".join(words[:36]))]
    assert [r.doc_id for r in neardup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [1]
    rows = [(1, " ".join(words[:45])), (2, " ".join(words[:36]))]
    assert neardup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).count() == 2


def test_index_meets_nearly_all_pairs_at_the_threshold():
    """Pairs of similarity 0.8 exactly: two equal bytes in a group, and within tally and distance."""
    rng, p, met = np.random.default_rng(3), neardup.Near(), 0
    for _ in range(2000):
        n = int(rng.integers(5, 40)) * 9  # 8 of 10 shared: n - x on each side
        names = rng.integers(0, 1 << 63, 10 * n // 9, dtype=np.uint64)
        a, b = names[:n], names[n // 9 :]
        assert abs(len(np.intersect1d(a, b)) / len(np.union1d(a, b)) - 0.8) < 1e-9
        f = shingle_kernel.simhash(np.concatenate([np.sort(a), np.sort(b)]), np.array([n, n]), neardup.WORDS)
        same = (f.view(np.uint8).reshape(2, -1)[0] == f.view(np.uint8).reshape(2, -1)[1]).reshape(neardup.GROUPS, neardup.WIDTH)
        x = np.bitwise_count(f[0] ^ f[1])
        met += same.sum(1).max() >= 2 and same.sum() >= p.bytes and x.sum() <= p.bits(64 * neardup.WORDS) and x[-2:].sum() <= p.bits(128)
    assert met >= 0.99 * 2000


def test_kernel_counts_shingles_of_any_cut(monkeypatch):
    rng = random.Random(1)
    texts = ["", " \n", "One", "a B c d e", "x" * 200 + " y z", "Ünï A b\x0bc\td e\xa0f " * 40]
    texts += [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(900))) for _ in range(20)]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    whole = [(flat.copy(), n.copy()) for _, flat, n in shingle_kernel.sets(raw, 5)]
    assert np.concatenate([n for _, n in whole]).tolist() == [len(sets(t)) for t in texts]
    monkeypatch.setattr(shingle_kernel, "BLOCK", 64)
    cut = [(flat, n) for _, flat, n in shingle_kernel.sets(raw, 5)]
    assert (np.concatenate([f for f, _ in whole]) == np.concatenate([f for f, _ in cut])).all()
    flat, n = (np.concatenate([x[i] for x in cut]) for i in (0, 1))
    fps = shingle_kernel.simhash(flat, n, 2)
    monkeypatch.setattr(shingle_kernel, "ROWS", 7)
    assert (shingle_kernel.simhash(flat, n, 2) == fps).all()
    first = shingle_kernel.simhash(flat[: n[:6].sum()], n[:6], 2)
    assert (first == fps[:6]).all() and not fps[0].any()


def test_parities_bound_the_differences_from_below():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(0, 1500)), dtype=np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, int(rng.integers(0, 60)), dtype=np.uint64))))
        x = shingle_kernel.parities(np.concatenate((a, b)), np.array([len(a), len(b)]), neardup.PARITIES)
        assert np.bitwise_count(x[0] ^ x[1]).sum() <= len(np.setxor1d(a, b))


def test_null_and_repeated_ids_and_clashing_names(spark):
    a = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    b = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(None, a, 1), (None, a, 2), (None, b, 1), (1, a, 1), (1, b, 2), (1, b, 2), (2, b, 3), (None, None, 1), (None, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row int")
    for parts in (1, 4):
        got = sorted(map(str, neardup.deduplicate(df.repartition(parts)).collect()))
        assert len(got) == 3 and sum("doc_id=1" in g for g in got) == 2


def test_empty(spark):
    assert neardup.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0
