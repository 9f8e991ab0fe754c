import hashlib
import math
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from lectern.llm import bpe, langid
from tests.llm.test_pii import base
from tests.llm.test_neardup import brute


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The input and every stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(900001, "12 345 !!", None, "src1", 9), (900002, None, "en", "src1", 0)], docs.schema)
    now = docs.union(extra)
    out = [now.collect()]
    for _, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.written(stage(spark, now, sf_dir))
        out.append(now.collect())
    return out


def test_columns(stages):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(s[0].asDict().keys() == dict.fromkeys(names).keys() for s in stages[:-1])


def test_language_stage(stages):
    before, after = ({r.doc_id: r for r in s} for s in stages[:2])
    assert not {900001, 900002} & set(after)
    assert len(after) >= len(before) - 2 - 0.02 * len(before)
    assert all(after[i].text == before[i].text for i in after)


def test_near_duplicate_stage(stages):
    assert sorted(r.doc_id for r in stages[2]) == brute([(r.doc_id, r.text) for r in stages[1]])


def test_pii_stage(stages):
    before, after = ({r.doc_id: r for r in s} for s in stages[2:4])
    assert set(before) == set(after)
    for i, r in after.items():
        assert not base(r.text) and r.n_chars == len(r.text)
        if not base(before[i].text) and "password" not in before[i].text and "token" not in before[i].text:
            assert r.text == before[i].text


def test_mixing_stage(stages):
    n = Counter(r.source for r in stages[3])
    total, roots = sum(n.values()), sum(math.sqrt(v) for v in n.values())
    want = Counter()
    for r in stages[3]:
        rate = math.sqrt(n[r.source]) * total / roots / n[r.source]
        u = (int(hashlib.md5(f"{r.doc_id}:{hashlib.md5(r.text.encode()).hexdigest()}:1:draw42".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        p = c = math.exp(-rate)
        k = 0
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        want[r.doc_id] = k
    assert Counter(r.doc_id for r in stages[4]) == +want


def test_encoding_stage(stages):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        codec = bpe.Codec(f.read(), public_tokenizers.PATTERN)
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in stages[4]}
    assert len(stages[5]) == len(stages[4])
    for r in stages[5]:
        assert r.ids == whole.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty_input(spark, sf_dir):
    now = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.written(stage(spark, now, sf_dir))
    assert now.count() == 0 and langid.fit(spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)) is None
