import zlib

import numpy as np
import pytest

from lectern.llm import langid, quality, registry, simhash

SF = "/root/testdata/sf0.01"


def test_codewords_are_far_apart():
    for k in (2, 3, 4, 7, 12, 40):
        c = langid.codewords(k, 1)
        apart = (c.shape[1] - c @ c.T) / 2
        assert apart[~np.eye(k, dtype=bool)].min() >= (1 if k == 2 else 2 if k == 3 else 4)


def test_counts_in_parts_equal_counts_at_once(monkeypatch):
    from lectern.llm import ngrams

    rng = np.random.default_rng(0)
    raw = rng.integers(0, 256, 5000).astype(np.uint8)
    count = ngrams.Counter(512, 3, ngrams.shapes(), 1)
    whole = count(raw)
    monkeypatch.setattr(ngrams, "PART", 700)
    assert (count(raw) == whole).all()


def test_held_out_languages(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = registry.op1_langid(spark, SF).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95


def test_langid_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where("doc_id < 400"))
    odd = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (2, "12 $$ !!", "z"), (3, "É", None), (3, "É", None)], "doc_id long, text string, lang_pred string")
    out = langid.predict(odd, model).collect()
    assert [r.lang_pred for r in out if r.text is None or r.doc_id in (None, 2)] == ["und"] * 3
    assert all(r.lang_pred in model.languages for r in out if r.doc_id == 3)
    assert langid.predict(odd.limit(0), model).count() == 0
    assert langid.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}


def test_one_language_only(spark):
    docs = spark.createDataFrame([(i, "some words here", "xx") for i in range(5)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs)).collect()} == {"xx"}


def test_held_out_quality(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = registry.op4_quality(spark, SF).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.93


def test_exact_blocked_cosines():
    rng = np.random.default_rng(0)
    x = np.abs(rng.standard_normal((60, 24))).astype(np.float32)
    p = quality.Params(buckets=16, rank=4, neighbours=5, block=7)
    y = rng.integers(0, 2, 60)
    m = quality.train(x, y, 0.5, p)
    whole = m.score(x)
    for i in range(60):
        sims = m.latent(x[i : i + 1])[0] @ m.vectors.T
        near = np.argsort(-sims)[:5]
        w = np.maximum(sims[near], 1e-3) ** p.sharpness * m.votes[near]
        assert whole[i] == pytest.approx((w * y[near]).sum() / w.sum(), rel=1e-4)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 3.0), (None, "", 3.0), (2, "a b c", 3.0), (2, "a b c", 3.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(2, 1), (1, 0), (None, 1), (9, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert len(quality.score(docs, model).collect()) == 4
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.fit(docs, labels.limit(0)) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}


def brute_counts(raw, table, codes, buckets):
    """n-grams of one text between two spaces, by loops."""
    order = len(codes)
    text = [32] + [int(table[b]) for b in raw] + [32]
    out = np.zeros(buckets, int)
    for i in range(len(text) - order + 1):
        gram = text[i : i + order]
        if any(b != 32 for b in gram):
            h = 0
            for k, b in enumerate(gram):
                h ^= int(codes[k][b])
            out[h] += 1
    return out


def test_language_query_equals_brute_force(spark, sf_dir):
    """Every document of the small table: features, bit classifiers and decoding by loops."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in registry.op1_langid(spark, sf_dir).collect()}
    known = [r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    model = langid.fit(docs.where(docs.doc_id.isin(known)))
    codes = model.counter().codes
    letters = [32] * 256
    for b in range(256):
        if b >= 128 or chr(b).isalpha():
            letters[b] = b | 32 if b < 128 else b
    for r in sorted(docs.collect(), key=lambda r: len(r.text or ""))[:120]:
        raw = (r.text or "").encode()
        got = rows[r.doc_id]
        if not any(c.isalpha() for c in r.text or ""):
            assert (got.lang_pred, got.score) == ("und", 0.0)
            continue
        n = brute_counts(raw, letters, codes, model.params.buckets)
        x = [np.float32(np.sqrt(v / max(1, n.sum()))) for v in n]
        loss = []
        for row in range(len(model.languages)):
            total = 0.0
            for bit in range(model.code.shape[1]):
                z = sum(float(v) * float(model.weights[i, bit]) for i, v in enumerate(x) if v) + model.bias[bit]
                total += model.trust[row, bit] * np.log1p(np.exp(-model.code[row, bit] * z))
            loss.append(total * model.code.shape[1])
        share = np.exp(-np.array(loss)) / np.exp(-np.array(loss)).sum()
        assert got.lang_pred == model.languages[int(share.argmax())]
        assert got.score == pytest.approx(share.max(), rel=1e-4)


def test_codewords_correct_a_wrong_bit():
    """Decoding finds the language of each codeword with any one bit turned."""
    code = langid.codewords(7, 1)
    trust = np.full(code.shape, 1 / code.shape[1])
    p = langid.Params()
    model = langid.Model([str(i) for i in range(7)], code, np.eye(code.shape[1], dtype=np.float32), np.zeros(code.shape[1]), trust, p)
    for i, row in enumerate(code):
        for bit in range(len(row)):
            turned = row.copy()
            turned[bit] *= -1
            assert model.decode(5 * turned[None].astype(np.float32))[0].argmax() == i


def test_quality_query_equals_brute_force(spark, sf_dir):
    """Every document of the small table: features by loops, all cosines, votes by sorting."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = {r.doc_id: r for r in registry.op4_quality(spark, sf_dir).collect()}
    learnt = [r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 0]
    m = quality.fit(docs, labels.where(labels.doc_id.isin(learnt)))
    p, codes = m.params, m.counter().codes
    shapes = [48 if 48 <= b < 58 else b for b in range(256)]
    for r in sorted(docs.collect(), key=lambda r: len(r.text or ""))[:120]:
        raw = (r.text or "").encode()
        n = brute_counts(raw, shapes, codes, p.buckets)
        grams = np.log1p(n).astype(np.float32) * m.idf
        grams = grams / max(float(np.sqrt((grams * grams).sum())), 1e-9)
        x = np.concatenate((grams, p.shape_weight * quality.shape(np.frombuffer(raw, np.uint8)))) - m.centre
        latent = x @ m.basis
        latent = latent / max(float(np.sqrt((latent * latent).sum())), 1e-9)
        sims = [float((latent * v).sum()) for v in m.vectors]
        near = sorted(range(len(sims)), key=lambda i: -sims[i])[: p.neighbours]
        weight = [max(sims[i], 1e-3) ** p.sharpness * m.votes[i] for i in near]
        want = sum(w * m.labels[i] for w, i in zip(weight, near, strict=True)) / sum(weight)
        assert rows[r.doc_id].score == pytest.approx(want, abs=2e-3)
        assert rows[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_samples_are_the_same_in_any_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    p = langid.Params(train_rows=80)
    a, b = langid.fit(docs, p), langid.fit(docs.repartition(7), p)
    assert a.languages == b.languages and (a.weights == b.weights).all() and (a.trust == b.trust).all()
    q = quality.Params(labelled_rows=60)
    a, b = quality.fit(docs, labels, q), quality.fit(docs.repartition(7), labels.repartition(3), q)
    assert (a.vectors == b.vectors).all() and (a.labels == b.labels).all() and len(a.labels) <= 60


def test_null_and_repeated_ids_of_labelled_rows(spark):
    rows = [(None, f"wort {i} das ist ein satz", "de") for i in range(60)] + [(None, f"word {i} this is one line", "en") for i in range(60)] + [(7, "this is one line too", "en")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, langid.Params(train_rows=40))
    assert model.languages == ["de", "en"]
    got = langid.predict(docs.dropDuplicates(), model).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.9
    many = docs.selectExpr("7L AS doc_id", "text")
    labels = spark.createDataFrame([(7, 1), (7, 1), (8, 0)], "doc_id long, quality int")
    assert len(quality.fit(many.union(spark.createDataFrame([(8, "x")], many.schema)), labels).labels) == 2
    few = langid.fit(docs, langid.Params(languages=1))
    assert few.languages == ["en"]


def test_columns_of_any_name_and_type(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    odd = spark.sql("SELECT 1L AS doc_id, 'this is a line' AS text, named_struct('a-b', 'x') AS `odd.name`, 2 AS SCORE, 3 AS Lang_Pred, 4 AS FP, 5 AS _text, 6 AS `a``b`")
    got = langid.predict(odd, langid.fit(docs))
    assert got.columns == ["doc_id", "text", "odd.name", "FP", "_text", "a`b", "lang_pred", "score", "ambiguous"]
    assert got.collect()[0]["odd.name"]["a-b"] == "x"
    scored = quality.score(odd, None)
    assert set(scored.columns) == {"doc_id", "odd.name", "Lang_Pred", "FP", "_text", "a`b", "score", "predicted"} and scored.count() == 1
    prints = simhash.fingerprints(odd)
    assert set(prints.columns) == {"doc_id", "odd.name", "SCORE", "Lang_Pred", "_text", "a`b", "fp"} and prints.first()["odd.name"]["a-b"] == "x"
