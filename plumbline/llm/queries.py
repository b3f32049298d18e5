"""The registered corpus queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers

from plumbline.llm import (
    bin_completion,
    filter_audit,
    fingerprints,
    minhash,
    mixing,
    packing,
    quality,
    resampling,
    substrings,
    token_store,
    toxicity,
    url_rules,
    vectors,
)
from plumbline.llm.common import Query, table
from plumbline.llm.sql import SQL


def op1_vector_components(spark, sf_dir):
    """Links and components of embeddings with a cosine of 0.9 and more."""
    return vectors.vector_components(table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark, sf_dir):
    """Toxicity of every text."""
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_packing(spark, sf_dir):
    """Documents in windows of 2048 ids."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_token_store(spark, sf_dir):
    """Documents written as token blocks and read back."""
    return token_store.read_tokens(token_store.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op5_fingerprints(spark, sf_dir):
    """Fingerprints of documents, of their edited texts, and likeness to the next."""
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_url_rules(spark, sf_dir):
    """A verdict for each page's url."""
    return url_rules.judge_urls(table(spark, sf_dir, "pages"))


def op7_minhash(spark, sf_dir):
    """Near-duplicate classes on shingles of two words."""
    return minhash.duplicate_classes(table(spark, sf_dir, "documents"), shingle=2)


def op8_substrings(spark, sf_dir):
    """Words covered by passages of 50 words that start in an earlier document too."""
    return substrings.substring_report(table(spark, sf_dir, "documents"))


def op9_mixing(spark, sf_dir):
    """Probability and draw of every document after raking to source, language and topic."""
    return mixing.mixing_report(table(spark, sf_dir, "documents"))


def op10_quality(spark, sf_dir):
    """Quality of every text."""
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_filter_audit(spark, sf_dir):
    """Effects of five filters in all their orders, by source."""
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_bin_completion(spark, sf_dir):
    """Documents in as few windows of 2048 ids as bin completion finds."""
    return bin_completion.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_resampling(spark, sf_dir):
    """Importance weights towards the benchmark texts, and 5 in 100 documents drawn by them."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def all_queries() -> dict[str, Query]:
    found = {n: f for n, f in globals().items() if n.startswith("op")}
    return {n: Query(f, SQL.get(n)) for n, f in sorted(found.items())}
