"""Draw documents that look like a target: importance weights over hashed runs of words, made distinct by Gumbel noise.

A text is normalised once to words joined by one space. One scan of it stores the running CRC-32 before and after every word.
The CRC of any run of words then comes from two of them: appending n bytes to a prefix multiplies its CRC by x^(8n) modulo the
CRC's polynomial over GF(2), so that the prefix before the run, shifted by the run's length, cancels out of the prefix after it.
Nothing but buckets of features is gathered: one sum a bucket over all texts and over the target, then one gain a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import lean, modest, utf8, width
from plumbline.session import discard, settle

BUCKETS, LONGEST_RUN, LEAST_WORDS, DRAWN_IN_100 = 10_000, 3, 20, 5
#: The reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Runs of up to so many bytes are shifted by one table; longer ones by a table for each binary digit of their length.
_NEAR = 256
#: Words worked off at a time.
_SLICE = 1 << 20
#: Bytes to what words keep: letters in lower case, digits, all bytes of other scripts; the rest parts words.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = t >> np.uint32(1) ^ np.where(t & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return t


class Shift:
    """Multiplication of CRCs by x^(8n): linear, so four look-ups, one for each byte of a CRC."""

    def __init__(self):
        step = _byte_table()
        identity = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
        near = [identity]
        for _ in range(_NEAR - 1):
            last = near[-1]
            near.append(last >> np.uint32(8) ^ step[last & np.uint32(255)])
        self.near = np.stack(near).reshape(-1)  # by length, byte of the CRC, value
        self.powers = [near[1]]  # by 1, 2, 4 ... bytes

    @staticmethod
    def _times(c: np.ndarray, table: np.ndarray) -> np.ndarray:
        return table[0][c & 255] ^ table[1][c >> 8 & 255] ^ table[2][c >> 16 & 255] ^ table[3][c >> 24]

    def _power(self, k: int) -> np.ndarray:
        while len(self.powers) <= k:
            self.powers.append(self._times(self.powers[-1], self.powers[-1]))
        return self.powers[k]

    def __call__(self, c: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Each CRC shifted by its number of bytes, of any size."""
        at = np.minimum(n, _NEAR - 1) << 10
        out = self.near[at + (c & 255)]
        for k in range(1, 4):
            out ^= self.near[at + (k << 8) + (c >> np.uint32(8 * k) & 255)]
        far = np.flatnonzero(n >= _NEAR)
        if len(far):
            moved, left = c[far], n[far]
            for k in range(int(left.max()).bit_length()):
                odd = left >> k & 1 == 1
                moved[odd] = self._times(moved[odd], self._power(k))
            out[far] = moved
        return out


class Runs:
    """Words of several texts, with running CRCs; `buckets(n)` hashes every run of n words that lies in one text."""

    _shift: Shift | None = None

    def __init__(self):
        self.before, self.after, self.size, self.text = [], [], [], []
        self.n_words: list[int] = []
        Runs._shift = Runs._shift or Shift()

    def add(self, raw: bytes) -> None:
        words = raw.translate(_NORMAL).split()
        c = 0
        for w in words:
            self.before.append(c)
            c = crc32(w, c)
            self.after.append(c)
            c = crc32(b" ", c)
        self.size += map(len, words)
        self.n_words.append(len(words))

    def close(self) -> Runs:
        self.before, self.after = np.array(self.before, np.uint32), np.array(self.after, np.uint32)
        self.size = np.array(self.size, np.int64)
        self.text = np.repeat(np.arange(len(self.n_words)), self.n_words)
        self.ends = np.cumsum(self.size + 1)
        return self

    def buckets(self, n: int, modulus: int) -> tuple[np.ndarray, np.ndarray]:
        """(text of each run of n words, bucket of its CRC)."""
        if len(self.size) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        last = len(self.size) - n + 1
        length = self.ends[n - 1 :] - self.ends[:last] + self.size[:last]
        inside = self.text[n - 1 :] == self.text[:last]
        crc = self.after[n - 1 :][inside] ^ self._shift(self.before[:last][inside], length[inside])
        return self.text[:last][inside], crc % np.uint32(modulus)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, Runs]]:
    """Texts of a batch, some at a time: (first, past the last, their runs)."""
    first, runs, held = 0, Runs(), 0
    texts = batch.column(column)
    for i in range(len(texts)):
        runs.add(texts[i].as_py())
        held += runs.n_words[-1]
        if held >= _SLICE:
            yield first, i + 1, runs.close()
            first, runs, held = i + 1, Runs(), 0
    if first < len(texts):
        yield first, len(texts), runs.close()


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> DataFrame:
    """Rows (bucket, n) over the runs of 1 to `longest` words of all texts; each task sends at most a row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in lean(batches):
            for _, _, runs in _slices(b, 0):
                for n in range(1, longest + 1):
                    total += np.bincount(runs.buckets(n, buckets)[1], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])

    counted = modest(texts).select(utf8(text_col).alias("raw")).mapInArrow(run, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * ln(ratio)) for each bucket: smoothed share in the target over smoothed share in the corpus.

    Two numbers for each of `buckets` buckets come to the driver, whatever the corpus.
    """
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, into in ((corpus, s), (target, t)):
        for r in counts.collect():
            into[r["bucket"]] = r["n"]
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST_RUN) -> DataFrame:
    """Rows (doc_id, row, n_words, n_features, weight): the gains of each document's runs summed; `row` is its own number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for b in lean(batches):
            words, features, weight = (np.zeros(len(b), np.int64) for _ in range(3))
            for first, end, runs in _slices(b, 1):
                words[first:end] = runs.n_words
                for n in range(1, longest + 1):
                    text, bucket = runs.buckets(n, len(gain))
                    features[first:end] += np.bincount(text, minlength=end - first)
                    # sums of integers in doubles: exact below 2^53
                    weight[first:end] += np.bincount(text, gain[bucket], end - first).astype(np.int64)
            cols = [b.column(0), *(pa.array(x) for x in (np.arange(row, row + len(b)), words, features, weight))]
            row += len(b)
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row", "n_words", "n_features", "weight"])

    read = modest(docs).select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("raw"))
    return read.mapInArrow(run, "doc_id long, row long, n_words long, n_features long, weight long")


def noise(doc_id: str = "doc_id", seed: str = "42"):
    """floor(1000 * Gumbel noise) from a hash of the id; a missing id is hashed as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, drawn_in_100: int = DRAWN_IN_100) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank among those drawn (null for the others), all long.

    Drawn are `drawn_in_100` of 100 documents of at least `least_words` words, rounded down: the highest scores, ties to smaller
    ids, missing ids last, rows alike in any order. Ranks are positions in ranges of the score plus one offset a range. A null
    or empty text has no features and weight 0; a word or run of any length is hashed whole. Rows with equal ids are separate
    documents. An empty corpus gives no rows; an empty target leaves every bucket at what the corpus alone says. Other columns
    are ignored.
    """
    gain = gains(bucket_counts(docs, buckets=buckets), bucket_counts(target, buckets=buckets), buckets)
    scored = settle(weigh(docs, gain).withColumn("score", F.col("weight") + noise()), "weighed")
    fit = F.col("n_words") >= least_words
    n = scored.where(fit).count() * drawn_in_100 // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    ranged = scored.where(fit).repartitionByRange(width(docs.sparkSession), *order).sortWithinPartitions(*order)
    placed = settle(ranged.withColumn("place", F.monotonically_increasing_id()), "ranked")
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())  # a row a range
    base, before = {}, 0
    for p, size in sizes:
        base[p] = before
        before += size
    offsets = docs.sparkSession.createDataFrame([(p, b) for p, b in base.items()], "part long, base long")
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.col("base") + within + 1)
    out = ["doc_id", "n_features", "weight", "score"]
    ranked = ranked.select(*out, F.when(F.col("rank") <= n, F.col("rank")).alias("rank"))
    return ranked.unionByName(scored.where(~fit).select(*out, F.lit(None).cast("long").alias("rank")))
