import random

from lectern.llm import mih


def brute(items, queries, k):
    out = []
    for qid, q in queries:
        near = sorted(((q ^ c) & ((1 << 64) - 1)).bit_count() << 40 | i for i, c in items if i != qid)[:k]
        out += [(qid, r + 1, x & ((1 << 40) - 1), x >> 40) for r, x in enumerate(near)]
    return sorted(out)


def run(spark, items, queries, k):
    schema = "id long, code long"
    got = mih.search(spark.createDataFrame(items, schema), spark.createDataFrame(queries, schema), k)
    return sorted(tuple(r) for r in got.collect())


def test_equals_brute_force(spark):
    rng = random.Random(1)
    centres = [rng.getrandbits(64) - (1 << 63) for _ in range(6)]

    def near():
        x = rng.choice(centres)
        for b in rng.sample(range(63), rng.choice([0, 0, 2, 9])):
            x ^= 1 << b
        return x

    items = [(i, near() if i % 3 else rng.getrandbits(64) - (1 << 63)) for i in range(900)]
    queries = items[::60] + [(5000, rng.getrandbits(64) - (1 << 63))]
    assert run(spark, items, queries, 7) == brute(items, queries, 7)


def test_copies_ties_and_few_items(spark):
    items = [(i, 5) for i in range(50)] + [(60, 4), (61, -1)]
    queries = [(3, 5), (40, 5), (61, -1)]
    assert run(spark, items, queries, 4) == brute(items, queries, 4)
    assert run(spark, items[:3], items[:3], 10) == brute(items[:3], items[:3], 10)


def test_nulls_repeats_and_empty(spark):
    assert run(spark, [(1, 7), (1, 7), (None, 7), (2, None), (4, 6)], [(1, 7), (1, 7), (None, 1)], 3) == [(1, 1, 4, 1)]
    assert run(spark, [], [], 3) == [] and run(spark, [], [(1, 1)], 3) == []


def test_sign_codes(spark):
    df = spark.createDataFrame([(1, [0.5, -1.0, 0.0, None, 2.0]), (2, None), (3, [1.0] * 70)], "id long, v array<float>")
    got = {r.id: r.code for r in mih.sign_codes(df, "v").collect()}
    assert got == {1: 0b10001, 2: None, 3: -1}
