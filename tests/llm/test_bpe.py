import hashlib
import random
from itertools import chain

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import bpe, registry

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def raw():
    with open(PATH, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def whole(raw):
    codec = bpe.Codec(raw, public_tokenizers.PATTERN)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


@pytest.fixture(scope="module")
def small(raw):
    return bpe.Codec(raw, public_tokenizers.PATTERN, chunk=16, overlap=6)


def test_chunks_give_the_ids_of_the_whole_text(small, whole):
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", "the ", " ", "  ", "\n", "é", "1", "!!", "'ll", "　", "wordy", "😀"]) for _ in range(rng.randint(0, 120)))
        assert small.encode(text) == whole.encode_ordinary(text)
        assert small.decode(small.encode(text)) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_round_trip(text):
    with open(PATH, "rb") as f:
        codec = bpe._codec(f.read(), public_tokenizers.PATTERN)
    codec.chunk, codec.overlap = 32, 8
    assert codec.decode(codec.encode(text)) == text.encode()


def test_one_pretoken_longer_than_all_chunks(small, whole):
    for text in ("a" * 700, "xyz" * 300 + " end", " " * 600 + "b", "ab" * 400 + "!" * 600 + "é" * 400):
        assert small.encode(text) == whole.encode_ordinary(text)


def test_very_long_pretoken_is_not_quadratic(raw):
    codec = bpe.Codec(raw, public_tokenizers.PATTERN)
    text = "q" * 300_000
    assert codec.decode(codec.encode(text)) == text.encode()


def test_texts_go_through_chunks(spark, sf_dir, raw, whole):
    codec = bpe.Codec(raw, public_tokenizers.PATTERN)
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    counts = []
    for t in texts:
        pieces = list(codec.pieces(t))
        assert "".join(chain.from_iterable(pieces)) == t
        counts.append(len(pieces))
        assert len(pieces) > (len(t) > codec.chunk)  # a text longer than a chunk has several
    assert sum(c > 1 for c in counts) > len(texts) / 2
    # pre-tokens of the pieces are those of the whole text
    for t in texts[:50]:
        assert [x for p in codec.pieces(t) for x in p] == codec.pattern.findall(t)


def test_every_code_point_is_classed_alike(raw, whole):
    codec = bpe.Codec(raw, public_tokenizers.PATTERN)
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for at in range(0, len(points), 20_000):
        text = " ".join(f"a{x}1{x}{x}" for x in points[at : at + 20_000])
        assert codec.encode(text) == whole.encode_ordinary(text)


@pytest.mark.parametrize("unit", [" ", "q", "!", "\n"])
def test_long_runs_grow_linearly(raw, unit):
    codec = bpe.Codec(raw, public_tokenizers.PATTERN)
    scanned = []
    plain = codec._tokens
    codec._tokens = lambda text, start, end: scanned.append(end - start) or plain(text, start, end)
    for n in (20_000, 200_000):
        scanned.clear()
        text = "a b " + unit * n + " end of it"
        assert codec.decode(codec.encode(text)) == text.encode()
        assert sum(scanned) < 6 * len(text)


def test_extra_columns_of_any_name_and_type(spark):
    df = spark.sql("SELECT 1L AS doc_id, 'some text' AS text, named_struct('a-b', 'x') AS `odd.name`, 'y' AS IDS, 2 AS Decoded")
    got = bpe.encode(df, PATH, public_tokenizers.PATTERN)
    assert got.columns == ["doc_id", "odd.name", "text", "ids", "decoded"]
    assert bytes(got.first().decoded) == b"some text" and got.first()["odd.name"]["a-b"] == "x"


def test_query(spark, sf_dir, whole):
    rows = registry.op8_bpe(spark, sf_dir).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = whole.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_nulls_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, 5), (None, "", 6), (1, None, 5)], "doc_id long, text string, ids int")
    rows = bpe.encode(df, PATH, public_tokenizers.PATTERN).collect()
    assert {r.text for r in rows} == {None, ""}
    assert len(rows) == 3 and all(r.ids == [] and bytes(r.decoded) == b"" for r in rows)
    assert bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
