"""From raw documents to packed training sequences: quality, near-duplicates, repeated passages, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame with the columns of `documents`; the last returns packed pieces.
`run` stores every stage as Parquet in the shared folder and reads it back for the next, so that a lost executor repeats one
stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import minhash, mixing, packing, quality, substrings
from plumbline.llm.common import table
from plumbline.session import discard, settle


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score below 0.3) go. It learns from the labels outside the held-out fold."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar documents stays: five-word shingles, similarity 0.8."""
    return minhash.drop_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 50 words that start in an earlier document too are cut out; no document goes."""
    return substrings.remove_repeats(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with raked shares of source, language and topic, of 70 in 100 of the tokens."""
    return mixing.sample_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: Trained models, tokenizers and packing have no SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`: rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, settle(stage(spark, docs, sf_dir), name)
        discard(before)
    return docs
