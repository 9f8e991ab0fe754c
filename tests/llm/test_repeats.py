import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import registry, repeat_kernel, repeats


def brute(docs, w):
    """{id: (n_bytes, n_removed, n_spans, kept)} of (id, bytes) rows."""
    seen, out = set(), {}
    for i, raw in sorted(docs):
        gone = bytearray(len(raw))
        for p in range(len(raw) - w + 1):
            if raw[p : p + w] in seen:
                gone[p : p + w] = b"\1" * w
            seen.add(raw[p : p + w])
        spans = sum(g and not h for g, h in zip(gone, b"\0" + gone[:-1]))
        out[i] = (len(raw), sum(gone), spans, bytes(c for c, g in zip(raw, gone) if not g))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abc ") for _ in range(rng.randint(3, 40))) for _ in range(12)]
    docs = []
    for i in range(n):
        text = "".join(rng.choice(parts) if rng.random() < 0.6 else "".join(rng.choice("xyzé") for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(0, 8)))
        docs.append((i * 7 % 61, text))
    docs += [(100 + i, docs[i][1]) for i in range(6)] + [(200, "ab" * 60), (201, ""), (202, "a" * 55)]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("group", [20_000, 3])
@pytest.mark.parametrize("share", [0, 3, 1])
def test_equals_brute_force(monkeypatch, seed, group, share):
    docs = corpus(seed)
    want = brute([(i, t.encode()) for i, t in docs], 10)
    p = repeats.Params(window=10, gram=4)
    # the rounds run in this process, in small batches, as Spark would hand them over sorted
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "HELD", 50)
    monkeypatch.setattr(repeat_kernel, "CHUNK", 64)

    def batches(rows, names, types, by, size=7):
        rows = sorted(rows, key=lambda r: tuple(r[c] for c in by))
        for i in range(0, len(rows), size):
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows[i : i + size]], t) for n, t in zip(names, types)], names=names)

    def rows(found):
        return [r for b in found for r in b.to_pylist()]

    i64 = pa.int64()
    texts = dict(docs)
    given = [{"doc": i, "raw": t} for i, t in docs]
    grams = Counter(r["k"] for r in rows(repeats._grams(p, batches(given, ["doc", "raw"], [i64, pa.string()], ["raw"], 5))))
    # no gram is hot, the common ones are, or all are
    hot = np.sort(np.array([k for k, n in grams.items() if share and n >= share], np.int64))
    starts = rows(repeats._starts(p, hot, batches(given, ["doc", "raw"], [i64, pa.string()], ["raw"], 5)))
    ranked = rows(repeats._rank_grams(batches(starts, repeats.ROUND1, [i64] * 5, ["k", "f", "doc", "lo"])))
    grouped = {}
    for r in ranked:
        if r["at"] >= 0:
            grouped.setdefault(r["doc"], []).append({c: r[c] for c in ("lo", "hi", "at", "rank")})
    listed = pa.list_(pa.struct([(c, i64) for c in ("lo", "hi", "at", "rank")]))
    some = [{"doc": d, "raw": texts[d], "open": g} for d, g in grouped.items()]
    halves = rows(repeats._open_stretches(p, batches(some, ["doc", "raw", "open"], [i64, pa.string(), listed], ["doc"])))
    windows = rows(repeats._rank_stretches(p, batches(halves, [*repeats.HALVES, "raw"], [i64] * 5 + [pa.binary()], ["k", "n", "doc", "lo"], 4)))
    late = rows(repeats._rank_hot_windows(batches(windows, repeats.WINDOWS, [i64] * 5, ["n1", "n2", "doc", "lo"])))
    got = {i: bytearray(len(t.encode())) for i, t in docs}
    for r in [r for r in ranked if r["at"] < 0] + late:
        got[r["doc"]][r["lo"] : r["hi"] + 10] = b"\1" * (r["hi"] + 10 - r["lo"])
    for i, t in docs:
        assert bytes(c for c, g in zip(t.encode(), got[i]) if not g) == want[i][3], (i, t)


@pytest.mark.parametrize("large", [0, 2, 1])
def test_windows_of_a_hot_gram_are_rows_only_if_its_pair_is_large(large):
    line = "stands everywhere"
    rng = random.Random(9)
    # round the line: six texts, each in 8 documents that differ beside it, and 60 of their own
    ends = ["".join(rng.choice("abcdefgh") for _ in range(40)) for _ in range(66)]
    docs = [(i, (f"{i:03d}" + ends[i % 6] + line + ends[i % 6] + f"{i:03d}") if i < 48 else ends[i - 42] + line + ends[i - 42][::-1]) for i in range(102)]
    want = brute([(i, t.encode()) for i, t in docs], 30)
    p = repeats.Params(window=30, gram=8)

    def batches(rows, schema, by):
        rows = sorted(rows, key=lambda r: tuple(r[c] for c in by))
        for i in range(0, len(rows), 7):
            yield pa.RecordBatch.from_pylist(rows[i : i + 7], schema)

    def rows(found):
        return [r for b in found for r in b.to_pylist()]

    longs = lambda names, *more: pa.schema([*[(n, pa.int64()) for n in names], *more])
    given = lambda: batches([{"doc": i, "raw": t} for i, t in docs], longs(["doc"], ("raw", pa.string())), ["doc"])
    grams = Counter(r["k"] for r in rows(repeats._grams(p, given())))
    hot = np.sort(np.array([k for k, n in grams.items() if n >= 60], np.int64))
    assert len(hot)
    ranked = rows(repeats._rank_grams(batches(rows(repeats._starts(p, hot, given())), longs(repeats.ROUND1), ["k", "f", "doc", "lo"])))
    opened = {}
    for r in ranked:
        if r["at"] >= 0:
            opened.setdefault(r["doc"], []).append({c: r[c] for c in ("lo", "hi", "at", "rank")})
    listed = pa.list_(pa.struct([(c, pa.int64()) for c in ("lo", "hi", "at", "rank")]))
    some = [{"doc": d, "raw": dict(docs)[d], "open": g} for d, g in opened.items()]
    halves = lambda *given: rows(repeats._open_stretches(p, batches(some, longs(["doc"], ("raw", pa.string()), ("open", listed)), ["doc"]), 0, 1, *given))
    pairs = Counter((r["k"], r["n"]) for r in halves())
    found = [pair for pair, n in pairs.items() if large and n >= large]
    large_names = np.sort(repeats._pair_names(np.array([k for k, _ in found], np.int64), np.array([n for _, n in found], np.int64)))
    windows = rows(repeats._rank_stretches(p, batches(halves(large_names), longs(repeats.HALVES, ("raw", pa.binary())), ["k", "n", "doc", "lo"])))
    assert any(r["hi"] < 0 for r in windows) == (large > 0)
    late = rows(repeats._rank_hot_windows(batches(windows, longs(repeats.WINDOWS), ["n1", "n2", "doc", "lo"])))
    got = {i: bytearray(len(t)) for i, t in docs}
    for r in [r for r in ranked if r["at"] < 0] + late:
        got[r["doc"]][r["lo"] : r["hi"] + 30] = b"\1" * (r["hi"] + 30 - r["lo"])
    assert sum(n for _, n, _, _ in want.values()) and {i: sum(g) for i, g in got.items()} == {i: w[1] for i, w in want.items()}


def test_large_pairs_are_found_and_lose_no_window(spark, monkeypatch):
    line, rng = "this one line stands in every document of them all", random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(12))
    docs = [(i, word() + line + word()) for i in range(200)]
    p = repeats.Params(window=30, gram=8, hot_least=1, hot_share=0.5)
    bare = spark.createDataFrame(docs, "_key long, _body string")
    seen = []
    found = repeats.large_pairs
    monkeypatch.setattr(repeats, "large_pairs", lambda *given: seen.append(found(*given)) or seen[-1])
    for group in (20_000, 20):
        monkeypatch.setattr(repeats, "GROUP", group)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove(bare.toDF("doc_id", "text"), p).collect()}
        assert got == brute([(i, t.encode()) for i, t in docs], 30)
    assert len(seen) == 2 and len(seen[1])


@pytest.mark.parametrize("window", [3, 8, 10, 16, 33, 100])
def test_doubled_ranks_are_exact(window):
    rng = np.random.default_rng(window)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    data[150:290] = data[:140]
    ranks = repeat_kernel.doubled_ranks(data, window)
    seen = {}
    for i, r in enumerate(ranks.tolist()):
        assert seen.setdefault(r, data[i : i + window].tobytes()) == data[i : i + window].tobytes()
    assert len(ranks) == 400 - window + 1 and len(seen) == len(set(seen.values())) and len(repeat_kernel.doubled_ranks(data[:2], 3)) == 0


@pytest.mark.parametrize("hot_least", [64, 2])
def test_operator_equals_brute_force(spark, hot_least):
    docs = corpus(3)
    want = brute([(i, t.encode()) for i, t in docs], 10)
    df = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id long, text string, n_spans int")
    got = repeats.remove(df, repeats.Params(window=10, gram=4, hot_least=hot_least)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]


def test_query_equals_brute_force(spark, sf_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = brute(texts.items(), 100)
    for r in registry.op3_repeats(spark, sf_dir).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans) == want[r.doc_id][:3]
        assert r.kept_sha256 == hashlib.sha256(want[r.doc_id][3]).hexdigest()


def test_null_and_repeated_ids(spark):
    t, u = "0123456789abcdef", "xx0123456789abcd"
    first, second = sorted([t, u], key=lambda x: hashlib.sha256(x.encode()).hexdigest())
    rows = [(5, t), (5, u), (5, t), (None, None), (None, "0123456789"), (7, "")]
    got = [(r.doc_id, r.text, bytes(r.kept).decode()) for r in repeats.remove(spark.createDataFrame(rows, "doc_id long, text string"), repeats.Params(window=10, gram=4)).collect()]
    seen = brute([(0, b"0123456789"), (1, first.encode()), (2, second.encode())], 10)
    want = [(5, first, seen[1][3].decode()), (5, second, seen[2][3].decode()), (5, t, dict([(first, seen[1][3]), (second, seen[2][3])])[t].decode())]
    assert sorted(x for x in got if x[0] == 5) == sorted(want)
    assert sorted((x[1] or "", x[2]) for x in got if x[0] is None) == [("", ""), ("0123456789", "0123456789")]


def test_any_ids_and_one_gram_in_every_document(spark):
    line = "this one line stands in every document of them all"
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 12))) + line + " ".join(word() for _ in range(rng.randint(0, 12))) for _ in range(80)]
    ids = [None, None, 1 << 62, 1 << 62, -(1 << 62), -(1 << 63), 7, 7, 7] + [i << 40 for i in range(71)]
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, _key string")
    order = sorted(range(80), key=lambda n: (ids[n] is not None, ids[n] or 0, hashlib.sha256(texts[n].encode()).hexdigest()))
    want = brute([(place, texts[n].encode()) for place, n in enumerate(order)], 10)
    want = Counter((ids[n], texts[n], want[place]) for place, n in enumerate(order))
    for p in (repeats.Params(window=10, gram=4), repeats.Params(window=10, gram=4, hot_least=1, hot_share=0.0)):
        got = repeats.remove(df, p).collect()
        assert Counter((r.doc_id, r.text, (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in got) == want
    named = df.selectExpr("concat('id', lpad(cast(row_number() over (order by text) as string), 4, '0')) AS doc_id", "text", "1 AS `N_bytes`", "2 AS `a.b`")
    rows = sorted(named.collect())
    want = brute([(i, r.text.encode()) for i, r in enumerate(rows)], 10)
    got = repeats.remove(named, repeats.Params(window=10, gram=4))
    assert got.columns == ["doc_id", "text", "a.b", "n_bytes", "n_removed", "n_spans", "kept"]
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.orderBy("doc_id").collect()] == [want[i] for i in range(80)]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove(df).count() == 0
