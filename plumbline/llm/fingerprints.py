"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, for two bases modulo 2^31 - 1, the sum of (code point + 1) * base^position up to each
position. The difference of two entries, brought to a common power, is the hash of any span: equal spans compare in constant
time, and the longest common extension of two places is found by binary search. The hashes of all spans of SPAN code points
are dealt to 64 bins; the least of each bin, mixed to 16 bits, makes the fingerprint, so likeness survives insertions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import modest, width
from plumbline.session import settle

PRIME = (1 << 31) - 1
BASES = (911_382_323, 1_972_663_319 % PRIME)
SPAN, BINS, EMPTY = 16, 64, 0xFFFF
_P, _31 = np.uint64(PRIME), np.uint64(31)


def _reduce(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1 for x below 2^62, as 0 to 2^31 - 2."""
    x = (x & _P) + (x >> _31)
    x = (x & _P) + (x >> _31)
    return np.where(x >= _P, x - _P, x)


class Powers:
    """base^0, base^1, ... grown by doubling as longer texts come."""

    def __init__(self, base: int):
        self.base, self.values = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.values) < n:
            step = np.uint64(pow(self.base, len(self.values), PRIME))
            self.values = np.concatenate([self.values, _reduce(self.values * step)])
        return self.values[:n]


_POWERS = [(Powers(b), Powers(pow(b, -1, PRIME))) for b in BASES]


class PrefixHashes:
    """Prefix arrays of one text."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        self.prefix = []
        for up, _ in _POWERS:
            # fewer than 2^33 terms below 2^31: the running sum fits 64 bits
            sums = np.cumsum(_reduce(codes * up.upto(self.n)), dtype=np.uint64)
            self.prefix.append(np.concatenate([np.zeros(1, np.uint64), sums % _P]))

    def spans(self, length: int) -> np.ndarray:
        """The 62-bit hash of each span of `length`."""
        out = np.zeros(max(0, self.n - length + 1), np.uint64)
        for p, (_, down) in zip(self.prefix, _POWERS):
            h = _reduce(_reduce(p[length:] + _P - p[: self.n - length + 1]) * down.upto(len(out))) if len(out) else out
            out = (out << _31) | h
        return out

    def span(self, at: int, length: int) -> tuple[int, ...]:
        if at < 0 or length < 0 or at + length > self.n:
            raise IndexError((at, length))
        return tuple(
            (int(p[at + length]) - int(p[at])) % PRIME * pow(up.base, -at, PRIME) % PRIME for p, (up, _) in zip(self.prefix, _POWERS)
        )

    def extension(self, other: PrefixHashes, at: int = 0, there: int = 0) -> int:
        """How many code points from `at` here equal those from `there` in the other text."""
        low, high = 0, min(self.n - at, other.n - there)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(at, mid) == other.span(there, mid):
                low = mid
            else:
                high = mid - 1
        return low


def sketch(prefix: PrefixHashes) -> np.ndarray:
    """64 values of 16 bits; EMPTY where no span fell into the bin. A text shorter than SPAN is one span; an empty one has none."""
    out = np.full(BINS, EMPTY, np.uint16)
    if not prefix.n:
        return out
    h = prefix.spans(min(SPAN, prefix.n))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    h = np.sort(h ^ (h >> np.uint64(32)))
    first = np.searchsorted(h, np.arange(BINS, dtype=np.uint64) << np.uint64(58))
    here = (first < len(h)) & (h[np.minimum(first, len(h) - 1)] >> np.uint64(58) == np.arange(BINS))
    least = h[first[here]] * np.uint64(0xD6E8FEB86659FD93)
    out[here] = np.minimum(least >> np.uint64(48), np.uint64(EMPTY - 1)).astype(np.uint16)
    return out


def hexed(s: np.ndarray) -> str:
    return s.astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Equal bins among those that hold a span in either fingerprint; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s), ">u2") for s in (a, b))
    used = (x != EMPTY) | (y != EMPTY)
    return float(((x == y) & used).sum() / used.sum())


def edited(text: str, following: str) -> str:
    """The last quarter (rounded down) replaced by as many code points, or all, from the start of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k] if k else text


ROWS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long"
_NAMES = [c.split()[0] for c in ROWS.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]


class _Seen:
    """A text with what was already worked out for it."""

    def __init__(self, doc, text: str):
        self.doc, self.text, self.prefix = doc, text, PrefixHashes(text)
        self.print = hexed(sketch(self.prefix))

    def row(self, following: _Seen) -> tuple:
        change = edited(self.text, following.text)
        p = PrefixHashes(change)
        f = hexed(sketch(p))
        sha = hashlib.sha256(change.encode("utf-8", "surrogatepass")).hexdigest()
        near = likeness(self.print, f), likeness(self.print, following.print)
        return (self.doc, self.prefix.n, sha, self.print, f, *near, self.prefix.extension(p), self.prefix.extension(following.prefix))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS)], names=_NAMES)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each text, its edited form, and compare it with both and with the next document.

    Next is by ascending id (null ids first, equal ids by text), after the last the first; alone, a document follows itself.
    A null text is empty; an empty text has the fingerprint without spans, like only to another such. Also returned: the code
    points that each text shares from its start with the edited text and with the next. An empty table gives no rows.

    Texts are shuffled once, by ranges of the id. A partition's last document waits for the first of the next partition: two
    rows a partition carry their text to a second step.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, first = TaskContext.get().partitionId(), None, None

        def edge(kind: int, s: _Seen) -> pa.RecordBatch:
            row = [pa.array([v], k) for v, k in zip((s.doc, *[None] * 8), _KINDS)]
            more = [pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([s.text], pa.string())]
            return pa.RecordBatch.from_arrays(row + more, names=[*_NAMES, "part", "kind", "text"])

        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                s = _Seen(doc, text.as_py() or "")
                if last is not None:
                    rows.append(last.row(s))
                first, last = first or s, s
            out = _batch(rows)
            more = [pa.array([part] * len(rows), pa.int32()), pa.array([0] * len(rows), pa.int32()), pa.nulls(len(rows), pa.string())]
            yield pa.RecordBatch.from_arrays(out.columns + more, names=[*_NAMES, "part", "kind", "text"])
        if last is not None:
            yield edge(1, last)
            yield edge(2, first)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text, following in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                yield _batch([_Seen(doc, text.as_py()).row(_Seen(None, following.as_py()))])

    ordered = modest(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(width(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    step = settle(ordered.mapInArrow(run, f"{ROWS}, part int, kind int, text string"), "fingerprints")
    # a row per partition from here on; which one follows is settled over their numbers alone, before texts meet
    parts, order = step.where("kind = 2").select("part"), Window.orderBy("part")
    first = F.first("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    parts = parts.select("part", F.coalesce(F.lead("part").over(order), first).alias("next"))
    heads = step.where("kind = 2").select(F.col("part").alias("next"), F.col("text").alias("following"))
    tails = step.where("kind = 1").select("doc_id", "text", "part").join(parts, "part").join(heads, "next").select("doc_id", "text", "following")
    return step.where("kind = 0").select(*_NAMES).unionByName(tails.mapInArrow(close, ROWS))
