"""Near-duplicate documents by MinHash, exact within the candidates and with components of any size.

1. Each document's distinct word shingles give a digest of the whole set and HASHES minima under universal hash functions
   (multiply, add, upper half), folded into BANDS band hashes of ROWS minima. Equal sets are one class from here on, known by
   its smallest doc_id: copies cost no pairs.
2. Classes that share a band hash meet in a bucket, whose smallest class is its pivot. Every member is verified against the
   pivot on full sets, once however many buckets they share; links of 0.8 and more give components.
3. What is left are members of one bucket that ended in different components. With their shingles ordered from rare to common,
   two sets of similarity 0.8 have their first common shingle so early in both that what follows can still hold the overlap
   they need. Members of open buckets are joined on such shingles alone, within classes of size, then verified on full sets,
   and components are joined. So no link among candidates is lost, though no bucket is expanded into pairs.

At a similarity of 0.8, seven rows and 48 bands miss a pair with probability 1.3e-5 = (1 - 0.8^7)^48.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fresh, lean, modest, small_side, utf8
from plumbline.llm.components import components
from plumbline.llm.words import Words, digest, mix
from plumbline.session import discard, settle

ROWS, BANDS = 7, 48
HASHES = ROWS * BANDS
SIMILAR = 80  # in hundredths
#: Slots in which the pool's shingles are counted, and the ratio between classes of size.
SLOTS, STEP = 1 << 18, 1.1
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"
_CHUNK = 2048


def shingle_set(raw: bytes, shingle: int) -> np.ndarray:
    """The distinct shingles of a text (A-Z lower-cased), as sorted 64-bit hashes."""
    return Words(raw.translate(_LOWER)).shingles(shingle)


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(SLOTS - 1)).astype(np.int64)


class Minima:
    def __init__(self, seed: int = 1):
        draw = np.random.default_rng(seed).integers(0, 1 << 63, (3, HASHES), dtype=np.int64).view(np.uint64)
        self.a, self.b, self.fold = draw[0] * np.uint64(2) + np.uint64(1), draw[1], draw[2] * np.uint64(2) + np.uint64(1)

    def bands(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), _CHUNK):
            part = shingles[None, at : at + _CHUNK] * self.a[:, None]
            part += self.b[:, None]
            np.minimum(least, part.min(1), out=least)
        least = (least >> np.uint64(32)) * self.fold
        return mix(least.reshape(BANDS, ROWS).sum(1) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sign_documents(docs: DataFrame, shingle: int) -> DataFrame:
    """A row per document: size and digest of its shingle set, and its band hashes; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima = Minima()
        for batch in lean(batches):
            rows, bands = [], []
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingle_set(raw.as_py(), shingle)
                rows.append((doc, len(s), *digest(s.tobytes())))
                bands.append(minima.bands(s).view(np.int64) if len(s) else np.zeros(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in bands])]).astype(np.int32)
            flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
            cols = [pa.array(c, pa.int64()) for c in (list(zip(*rows)) or [[]] * 4)]
            yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(ends), flat)], names=["doc_id", "n_shingles", "d1", "d2", "bands"])

    return settle(modest(docs).select(F.col("doc_id").cast("long"), utf8().alias("text")).mapInArrow(run, _SIGNED), "signatures")


def _sets(docs: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """(id, shingles) of the documents that occur in `pairs`; their texts alone leave the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            sets = [shingle_set(raw.as_py(), shingle).tobytes() for raw in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])

    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    ids = settle(ids, "ids")
    text = docs.select(F.col("doc_id").cast("long").alias("id"), utf8().alias("text")).join(small_side(ids, ids.count()), "id", "left_semi")
    return text.mapInArrow(run, "id long, shingles binary")


def verify(docs: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """(a, b, shared, together): sizes of intersection and union of each pair's full sets; stored.

    Where several rows have one id, each of their sets is compared and the likest counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            out, last, y = [], None, None
            for a, b, s, t in zip(*batch.columns):
                x = np.frombuffer(s.as_py(), np.uint64)
                if last is None or b != last[0] or t != last[1]:
                    last, y = (b, t), np.frombuffer(t.as_py(), np.uint64)
                at = np.searchsorted(y, x)
                shared = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                out.append((a.as_py(), b.as_py(), shared, len(x) + len(y) - shared))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "shared", "together"])

    sets = settle(_sets(docs, pairs, shingle), "sets")
    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("s")), "a")
    both = one.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("t")), "b").select("a", "b", "s", "t")
    checked = both.mapInArrow(run, "a long, b long, shared long, together long")
    likest = F.max_by(F.struct("shared", "together"), F.col("shared") / F.col("together"))
    checked = settle(checked.groupBy("a", "b").agg(likest.alias("r")).select("a", "b", "r.*"), "verified")
    discard(sets)
    return checked


def _overlap(n: int, m: int) -> int:
    """The smallest intersection that makes sets of n and m similar."""
    return -(-SIMILAR * (n + m) // (100 + SIMILAR))


def _size_class(n: int) -> int:
    return int(np.log(n) / np.log(STEP) + 1e-9)


def _prefix_pairs(docs: DataFrame, pool: DataFrame, shingle: int) -> DataFrame:
    """Pairs (a, b) of the stored `pool` (rep, n, root, out) that may be similar: in different components, at least one of them
    out of its bucket's. Each has a row per shingle of its prefix and size class (asked: per class that it may be similar to).

    Shingles are ordered by how often their hash slot occurs in the pool, then by hash: SLOTS counts are all that is broadcast."""
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long").alias("id"), utf8().alias("text"))
    text = text.join(small_side(pool.withColumnRenamed("rep", "id"), pool.count()), "id")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in lean(batches):
            for raw in batch.column(0):
                np.add.at(total, _slot(shingle_set(raw.as_py(), shingle)), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["slot", "n"])

    counted = text.select("text").mapInArrow(slots, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    often = np.zeros(SLOTS, np.int64)
    for slot, n in counted:
        often[slot] = n
    often = spark.sparkContext.broadcast(often)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            cols: list[list[np.ndarray]] = [[] for _ in range(7)]
            for rep, raw, root, out in zip(*batch.columns):
                rep, root, out = rep.as_py(), root.as_py(), out.as_py()
                s = shingle_set(raw.as_py(), shingle)
                s = s[np.lexsort((s, often.value[_slot(s)]))].view(np.int64)
                n = len(s)
                low, high = -(-SIMILAR * n // 100), 100 * n // SIMILAR
                lots = [(False, _size_class(n), n - _overlap(n, low) + 1)]
                if out:
                    for c in range(_size_class(low), _size_class(high) + 1):
                        least = max(low, int(np.ceil(STEP**c * (1 - 1e-9) - 1e-6)))
                        lots.append((True, c, n - _overlap(n, least) + 1))
                for asks, c, k in lots:
                    for col, value in zip(cols, (rep, root, n, asks, c, s[: max(0, k)], np.arange(max(0, k)))):
                        col.append(np.broadcast_to(value, max(0, k)))
            flat = [np.concatenate(c) if c else np.zeros(0) for c in cols]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(f.astype(k.to_pandas_dtype()), k) for f, k in zip(flat, kinds)], names=["rep", "root", "n", "asks", "class", "g", "at"])

    rows = text.select("id", "text", "root", "out").mapInArrow(prefixes, "rep long, root long, n int, asks boolean, class int, g long, at int")
    rows = settle(rows, "prefixes")
    x = rows.where("not asks").drop("asks")
    y = rows.where("asks").select("class", "g", *(F.col(c).alias(f"y_{c}") for c in ("rep", "root", "n", "at")))
    need = SIMILAR * (F.col("n") + F.col("y_n"))
    room = F.least(F.col("n") - F.col("at"), F.col("y_n") - F.col("y_at"))
    fits = (F.col("root") != F.col("y_root")) & ((100 + SIMILAR) * room >= need) & (100 * F.least("n", "y_n") >= SIMILAR * F.greatest("n", "y_n"))
    return x.join(y, ["class", "g"]).where(fits).select(F.greatest("rep", "y_rep").alias("a"), F.least("rep", "y_rep").alias("b")).distinct()


def _linked(verified: DataFrame) -> DataFrame:
    return verified.where(100 * F.col("shared") >= SIMILAR * F.col("together")).select("a", "b")


def duplicate_classes(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of `docs`.

    A text without words, null or empty, has no shingles and is linked with nothing; nor is a row without id (component null,
    kept). Rows with equal ids belong to one component. Fewer words than a shingle are one shingle. Other columns are ignored;
    an empty table gives no rows.
    """
    signed = sign_documents(docs, shingle)
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = settle(
        usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes"
    )
    banded = classes.select("rep", "n", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("p"), F.max("rep").alias("most")).where("p.rep < most")
    buckets = buckets.select("band", F.col("p.rep").alias("pivot"), F.col("p.n").alias("pivot_n"))
    members = settle(banded.join(buckets, "band"), "members")
    fits = 100 * F.least("n", "pivot_n") >= SIMILAR * F.greatest("n", "pivot_n")
    pairs = settle(members.where((F.col("rep") != F.col("pivot")) & fits).select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct(), "pairs")
    first = verify(docs, pairs, shingle)
    links = _linked(first)
    known = settle(components(links), "components")

    root = known.select(F.col("node").alias("rep"), "root")
    pivot_root = known.select(F.col("node").alias("pivot"), F.col("root").alias("pivot_root"))
    placed = members.join(root, "rep", "left").join(pivot_root, "pivot", "left")
    placed = placed.select("band", "rep", "n", F.coalesce("root", "rep").alias("root"), (F.coalesce("root", "rep") != F.coalesce("pivot_root", "pivot")).alias("out"))
    placed = settle(placed, "placed")
    # a bucket whose members all share the pivot's component has nothing left to test
    open_ = placed.where("out").select("band").distinct()
    pool = placed.join(open_, "band", "left_semi").groupBy("rep").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.max("out").alias("out"))
    more = settle(_prefix_pairs(docs, settle(pool, "pool"), shingle).join(pairs, ["a", "b"], "left_anti"), "pairs")
    joined = known.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_linked(verify(docs, more, shingle)))
    known = settle(components(joined), "components")
    discard(members, pairs, first, placed, more)

    of_class = classes.join(known.select(F.col("node").alias("rep"), "root"), "rep", "left")
    of_class = of_class.select("d1", "d2", F.coalesce("root", "rep").alias("component"))
    out = signed.join(of_class, ["d1", "d2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_duplicates(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One document of each component stays, the one with the smallest id; all columns stay as they are."""
    key = fresh("gone", docs)
    gone = settle(duplicate_classes(docs, shingle).where("not kept").select(F.col("doc_id").alias(key)).distinct(), "gone")
    return docs.join(small_side(gone, gone.count()), docs["doc_id"].cast("long") == gone[key], "left_anti")
