"""Quality classifier over supervised subword embeddings.

Every word, every pair of neighbouring words, and every run of three and four characters inside a word (its edges included)
has a learned vector, found by hashing. Characters are code points. A text is the average of its vectors; softmax over the two classes is trained by stochastic gradient descent in numpy. Averaging
and the output layer are both linear, so the trained vectors are folded into one number per bucket for scoring.

The model is fitted in one task on at most SAMPLE labelled documents, taken in order of a hash of their id. Scoring reads
every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fresh, held_out, lean, modest, small_side, utf8
from plumbline.llm.words import Words

SAMPLE = 4000
BITS, KINDS, DIM, EPOCHS, RATE = 16, 4, 8, 6, 1.0
_ODD3, _ODD4, _ODD1 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def characters(line: bytes) -> np.ndarray:
    """A number for each character: ASCII stands for itself, other code points are spread so that sums of shifted ones differ."""
    if line.isascii():
        return np.frombuffer(line, np.uint8).astype(np.uint32)
    c = np.frombuffer(line.decode().encode("utf-32-le"), "<u4")
    return np.where(c < 128, c, c * _ODD1)


def grams(raw: bytes) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """(buckets, which of them count) of words, word pairs, runs of three and runs of four characters.

    A pair of equal words has one bucket whatever the word. A run counts if it has no space inside; its edges may be spaces.
    """
    w = Words(raw)
    if not w.n:
        return []
    shift = np.uint64(64 - BITS)
    pairs = w.grams(2) >> shift
    if w.n > 1:
        pairs[w.hashes[1:] == w.hashes[:-1]] = 0
    c = characters(b" " + w.line + b" ")
    inside = c != 32
    three = c[:-2] + (c[1:-1] << np.uint32(8)) + (c[2:] << np.uint32(16))
    four = three[:-1] + (c[3:] << np.uint32(24))
    down = np.uint32(32 - BITS)
    return [
        ((w.hashes >> shift).astype(np.intp), None),
        (pairs.astype(np.intp), None),
        ((three * _ODD3 >> down).astype(np.intp), inside[1:-1]),
        ((four * _ODD4 >> down).astype(np.intp), inside[1:-2] & inside[2:-1]),
    ]


def features(raw: bytes) -> np.ndarray:
    """All buckets that count, each kind in a range of its own."""
    parts = [(k << BITS) + (at if use is None else at[use]) for k, (at, use) in enumerate(grams(raw))]
    return np.concatenate(parts) if parts else np.zeros(0, np.intp)


@dataclass(frozen=True)
class Model:
    """Log odds of class 1: the bias plus the mean of the text's buckets."""

    weights: np.ndarray
    bias: float

    def score(self, raw: bytes) -> float:
        total, n = 0.0, 0
        for k, (at, use) in enumerate(grams(raw)):
            found = self.weights[k << BITS : (k + 1) << BITS].take(at)
            total += float(found.sum() if use is None else found @ use.astype(np.float32))
            n += len(at) if use is None else int(np.count_nonzero(use))
        z = self.bias + total / max(1, n)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(texts: list[bytes], labels: list[int], seed: int = 7) -> Model:
    """Without both classes the score is the share of class 1, half a document added to each class."""
    y = np.array(labels, np.int64)
    ones = int(y.sum())
    if not 0 < ones < len(y):
        return Model(np.zeros(KINDS << BITS, np.float32), float(np.log((ones + 0.5) / (len(y) - ones + 0.5))))
    docs = []
    for t in texts:
        at, count = np.unique(features(t), return_counts=True)
        docs.append((at.astype(np.int32), (count / max(1, count.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (KINDS << BITS, DIM)).astype(np.float32)
    output, bias = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    bias[:] = np.log([len(y) - ones, ones]) - np.log(len(y))
    steps, step = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            at, share = docs[i]
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            mean = share @ vectors[at]
            z = mean @ output + bias
            p = np.exp(z - z.max())
            slope = p / p.sum()
            slope[y[i]] -= 1
            back = output @ slope
            output -= rate * np.outer(mean, slope)
            bias -= np.float32(0.1) * rate * slope
            # the step on a bucket follows its share of the text
            vectors[at] -= (rate * share)[:, None] * back * np.float32(len(at) ** 0.5)
    return Model((vectors @ (output[:, 1] - output[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def training_sample(labels: DataFrame, target: str, most: int) -> DataFrame:
    """At most `most` rows (doc_id, label) outside the held-out fold, in order of a hash of the id. Ids with a null label or
    with labels that differ are left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label"))
    known = known.where(~held_out("doc_id") & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("m"))
    return known.where("label = m").select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", most: int = SAMPLE) -> Model:
    """Train on the sample's whole texts, in one task; the model's 1 MB comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((tuple(r.values()) for b in batches for r in b.to_pylist()), key=lambda r: (r[0], r[2]))
        m = train([r[2] for r in rows], [r[1] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()], pa.binary()), pa.array([m.bias])], names=["weights", "bias"])

    sample = training_sample(labels, target, most)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).join(small_side(sample, most), "doc_id")
    found = text.select("doc_id", "label", "text").repartition(1).mapInArrow(run, "weights binary, bias double").first()
    return Model(np.frombuffer(found[0], np.float32), found[1]) if found else train([], [])


def score_texts(docs: DataFrame, model, out: str = "score") -> DataFrame:
    """`docs` with the model's score of every whole text added; null is empty, all columns stay."""
    schema = docs.select("*", F.lit(0.0).alias(out)).schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            s = [model.score((t.as_py() or "").encode()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, out])

    return modest(docs).mapInArrow(run, schema)


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, target: str = "quality") -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of `docs`.

    Null and empty texts get the score of a text without words; very long ones are scored whole. Equal texts score alike, so
    repeated rows and ids do; a score at the threshold counts as reached. Without labels the score is 0.5; an empty table gives
    no rows. Other columns are ignored, whatever their names.
    """
    scored = score_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels, target))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents whose score reaches the threshold, with their columns; rows are judged as in `quality_report`."""
    score = fresh("score", docs)
    return score_texts(docs, fit(docs, labels), score).where(F.col(score) >= threshold).drop(score)
