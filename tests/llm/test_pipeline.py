"""The pipeline's stages, each on its own input, and as a whole."""

from __future__ import annotations

import os
from collections import defaultdict

import corpus_pipeline
import edges
import pytest
from pyspark.sql import functions as F

from plumbline.session import settle


@pytest.fixture(scope="module")
def edge_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("edge"))
    edges.documents(spark).write.parquet(f"{d}/documents.parquet")
    edges.labels(spark).write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    edges.no_documents(spark).write.parquet(f"{d}/documents.parquet")
    edges.labels(spark, []).write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_are_five():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "mixing", "packing"]


@pytest.mark.parametrize("kind", ["edge", "empty", "small"])
def test_every_stage_keeps_the_columns(spark, small, edge_dir, empty_dir, kind):
    d = {"edge": edge_dir, "empty": empty_dir, "small": small}[kind]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    schema, n = [(c, t) for c, t in docs.dtypes], docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = settle(stage(spark, docs, d), name)
        assert docs.dtypes == schema, name
        assert docs.count() <= n
        n = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert len({(r.doc_id, r.start) for r in packed}) <= len(packed)
    by_doc = defaultdict(int)
    for r in packed:
        by_doc[r.doc_id] += r.length
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert set(by_doc) == set(ids)
    if kind == "small":
        assert len(ids) > 50
        assert edges.sorted_rows(corpus_pipeline.run(spark, d)) == sorted((tuple(r) for r in packed), key=lambda t: tuple((x is None, str(x)) for x in t))


def test_good_documents_pass_the_first_stage(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    kept = corpus_pipeline.STAGES[0][1](spark, docs, small).join(labels, "doc_id")
    share = labels.join(docs, "doc_id").groupBy("quality").count().join(kept.groupBy("quality").agg(F.count("*").alias("k")), "quality", "left")
    found = {r.quality: (r.k or 0) / r["count"] for r in share.collect()}
    assert found[1] > 0.95 and found.get(0, 0) < 0.3


def test_queries_without_the_corpus_folders(spark):
    """The entry module drops the corpus queries when their package is missing, and nothing else imports it."""
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for folder, _, names in os.walk(f"{root}/plumbline"):
        if folder.endswith("llm"):
            continue
        for n in names:
            if n.endswith(".py"):
                with open(f"{folder}/{n}") as f:
                    assert "plumbline.llm" not in f.read()
