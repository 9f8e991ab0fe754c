"""Corpus pipeline: stages of the corpus operators, each written and read again.

Language identification rejects documents without a language; of each group
of near-duplicates one stays; personal data is replaced; sources are mixed to
target weights; the mixture is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, langid, mixing, neardup, pii
from lectern.llm.shared import documents, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, or between two languages, go.

    A null lang is filled with the predicted one.
    """
    model = langid.fit(docs, langid.Params(margin=0.02))
    found = langid.predict(docs, model)
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous")) if model else found
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of texts that share 0.8 of their 5-word shingles (Jaccard); op6's 3-bit links are the query's alone."""
    return neardup.deduplicate(docs).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data replaced by its kind; n_chars follows the text."""
    found = pii.redact(docs)
    return found.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to source shares that go as the square root of their size, shuffled."""
    return mixing.replicate(docs, temperature=0.5, size=1.0, seed=42).select(*docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and the digest of the bytes that they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN)
    return found.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", remove_near_duplicates),
    ("pii", redact_personal_data),
    ("source_mixing", mix_sources),
    ("bpe", encode_texts),
]

#: SQL can express neither the learned language classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the whole documents table."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
