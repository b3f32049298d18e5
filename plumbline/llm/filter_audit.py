"""How filters of a corpus interact, from sorted posting lists.

Every document gets a number that no other has and a bit for each filter that it fails. Documents are dealt by ranges of
(part, id); a range is worked off in blocks of at most BLOCK documents of one part. A block holds, for each filter, the
ascending list of the numbers that fail it, one list of the good and one of the toxic documents. Unions of the lists of every
set of filters are found by k-way merges that gallop over runs, and met with the good and toxic lists in the same way. Only
the sizes leave a block. What a filter removes after others is the difference of two union sizes, so that all orders of the
filters follow from one sum for each part and set of filters.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import lean, modest, utf8, width
from plumbline.session import discard, settle

FILTERS = "ABCDE"
#: Documents of one part whose lists are held at a time.
BLOCK = 65_536
_UPPER, _FOLLOWING = bytes(range(65, 91)), bytes(range(128, 192))
_MARKS = re.compile(rb"[#$%&*|]")


def gallop(values: Sequence[int], bound: int, at: int) -> int:
    """The first place from `at` on that holds `bound` or more, found in steps that double."""
    step, end = 1, len(values)
    low = at
    while at < end and values[at] < bound:
        low, at, step = at + 1, at + step, step * 2
    return bisect_left(values, bound, low, min(at, end))


def union(lists: list[Sequence[int]]) -> list[int]:
    """All numbers of ascending lists, ascending and each once: the list with the least head gives its run up to the next head."""
    out: list[int] = []
    open_lists = [(x, 0) for x in lists if len(x)]
    while len(open_lists) > 1:
        open_lists.sort(key=lambda c: c[0][c[1]])
        (first, at), bound = open_lists[0], open_lists[1][0][open_lists[1][1]]
        end = gallop(first, bound, at)
        out += first[at:end]
        if end < len(first) and first[end] == bound:  # the next list gives it
            end += 1
        open_lists[0] = (first, end)
        if end == len(first):
            del open_lists[0]
    for x, at in open_lists:
        out += x[at:]
    return out


def common(a: Sequence[int], b: Sequence[int]) -> int:
    """How many numbers two ascending lists share, galloping in turn."""
    n, i, j = 0, 0, 0
    while i < len(a) and j < len(b):
        i = gallop(a, b[j], i)
        if i == len(a):
            break
        j = gallop(b, a[i], j)
        if j < len(b) and a[i] == b[j]:
            n, i, j = n + 1, i + 1, j + 1
    return n


def set_sizes(failing: list[Sequence[int]], marked: list[Sequence[int]]) -> list[tuple[int, ...]]:
    """For every set of lists (a bit each): how many numbers the union holds, and how many of each marked list are in it."""
    sizes = []
    for chosen in range(1 << len(failing)):
        merged = union([x for k, x in enumerate(failing) if chosen >> k & 1])
        sizes.append((len(merged), *(common(m, merged) for m in marked)))
    return sizes


def marks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A stored row for each document: part, doc_id, row (a number of its own), fails (a bit a filter), good, toxic.

    Filter E needs the smallest id of each text, which comes from digests of 256 bits, counted before they are joined.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for b in lean(batches):
            fails, digests = [], []
            for raw in b.column(2):
                t = raw.as_py()
                words = t.split()
                n = len(words)
                fails.append(
                    (n < 200)
                    | (100 * len(set(words)) < 50 * n) << 1
                    | (100 * (len(t) - len(t.translate(None, _UPPER))) > 2 * len(t.translate(None, _FOLLOWING))) << 2
                    | bool(_MARKS.search(t)) << 3
                )
                digests.append(hashlib.sha256(t).digest())
            rows = pa.array(np.arange(row, row + len(b)))
            row += len(b)
            cols = [b.column(0), b.column(1), rows, pa.array(fails, pa.int32()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "doc_id", "row", "fails", "digest"])

    read = modest(docs).select(F.coalesce("source", F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("raw"))
    seen = settle(read.mapInArrow(run, "part string, doc_id long, row long, fails int, digest binary"), "marked")
    firsts = seen.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    copied = settle(firsts.where("copies > 1").drop("copies"), "copied")
    known = labels.where("quality = 1 or toxic = 1").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    known = settle(known, "labelled")
    no = F.lit(False)
    found = seen.join(copied, "digest", "left").select("part", "doc_id", "row", (F.col("fails") + F.when(F.col("first_id") < F.col("doc_id"), 1 << 4).otherwise(0)).alias("fails"))
    found = settle(found.join(known, "doc_id", "left").select("part", "doc_id", "row", "fails", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")), "fails")
    discard(seen, copied, known)
    return found


def audit(found: DataFrame) -> DataFrame:
    """Rows (part, chosen, failing, good, toxic) from `marks`: sizes of the union of every set `chosen` of filters.

    `chosen` 0 counts all documents of the part instead.
    """
    spark, names = found.sparkSession, ["part", "chosen", "failing", "good", "toxic"]

    def sizes(part: str, docs: int, good: np.ndarray, toxic: np.ndarray, fails: np.ndarray) -> pa.RecordBatch:
        lists = [np.flatnonzero(fails >> k & 1).tolist() for k in range(len(FILTERS))]
        got = set_sizes(lists, [np.flatnonzero(good).tolist(), np.flatnonzero(toxic).tolist()])
        got[0] = (docs, int(good.sum()), int(toxic.sum()))
        cols = [[part] * len(got), range(len(got)), *zip(*got)]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def closed() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            of = lambda c: t.column(c).to_numpy()
            return sizes(held[0].column(0)[0].as_py(), len(t), of("good"), of("toxic"), of("fails"))

        for b in batches:
            part = b.column(0).dictionary_encode().indices.to_numpy()
            for at, end in _spans(part, BLOCK):
                piece = b.slice(at, end - at)
                if held and (held[0].column(0)[0] != piece.column(0)[0] or sum(map(len, held)) + len(piece) > BLOCK):
                    yield closed()
                    held = []
                held.append(piece)
        if held:
            yield closed()

    ranged = found.repartitionByRange(width(spark), "part", "doc_id", "row").sortWithinPartitions("part", "doc_id", "row")
    parts = ranged.mapInArrow(run, "part string, chosen int, failing long, good long, toxic long")
    return parts.groupBy("part", "chosen").agg(*(F.sum(c).alias(c) for c in names[2:]))


def _spans(codes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of equal neighbours, none longer than `most`."""
    cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)] if len(codes) else []
    return [(a, min(a + most, e)) for s, e in zip(cuts, cuts[1:]) for a in range(s, e, most)]


def orders() -> list[dict]:
    """Every order of the filters, a step each: bits of the filters applied before and of its own."""
    out = []
    for p in permutations(FILTERS):
        before = 0
        for step, f in enumerate(p, 1):
            out.append({"filter_order": "".join(p), "step": step, "before": before, "own": 1 << FILTERS.index(f)})
            before |= out[-1]["own"]
    return out


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Effects of five filters by part, order and step: rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    A null source is part "", a null text is empty (it fails A alone of A to D). A document without id neither fails E nor makes
    others fail it. Rows with equal ids are separate documents; E compares with smaller ids, so they do not fail it by each other.
    A document is good or toxic if any label row of its id says so; labels without id count for none. Very long texts are
    read whole. An empty table gives no rows. Other columns are ignored.
    """
    found = marks(docs, labels)
    totals = settle(audit(found), "filter_sizes")
    discard(found)
    every = (1 << len(FILTERS)) - 1
    steps = F.from_json(F.lit(json.dumps(orders())), "array<struct<filter_order string, step int, before int, own int>>")  # 600 rows a part
    size = totals.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("chosen", F.struct("failing", "good", "toxic")))).alias("of"))  # 32 entries
    x = size.select("part", "of", F.explode(steps).alias("x")).select("part", "of", "x.*")

    def gone(chosen, what: str):
        return F.when(chosen == 0, 0).otherwise(F.col("of")[chosen][what])

    after = F.col("before").bitwiseOR(F.col("own"))
    removed = gone(after, "failing") - gone(F.col("before"), "failing")
    rows = x.select(
        "part",
        "filter_order",
        "step",
        "own",
        (F.col("of")[F.lit(0)]["failing"] - gone(after, "failing")).alias("kept"),
        removed.alias("removed"),
        (gone(F.col("own"), "failing") - removed).alias("redundant"),
        (gone(F.lit(every), "failing") - gone(F.lit(every) - F.col("own"), "failing")).alias("unique_fails"),
        (gone(after, "good") - gone(F.col("before"), "good")).alias("good_lost"),
        (gone(after, "toxic") - gone(F.col("before"), "toxic")).alias("toxic_lost"),
    )
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")  # 120 rows a window
