"""Pack documents into windows of fixed length by best-fit decreasing.

Documents are encoded and get an end id; overlong ones are first cut into full windows. Pieces are dealt to groups by a
hash of themselves and of their place in the table, sorted longest first and put each into the tightest open window, found by a segment tree over the
remaining capacities 0 to the window length. A group is a few thousand pieces, so a task holds one group's open windows
only, however many documents there are; all groups pack alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import lean, modest, width
from plumbline.llm.tokens import encoder
from plumbline.session import settle

#: Pieces in a group, on average: enough for best fit to leave little room over.
GROUP_PIECES = 8192
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class CapacityTree:
    """Open windows by remaining capacity. A node tells whether any leaf below it holds a window."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.windows: list[list] = [[] for _ in range(self.leaves)]

    def put(self, room: int, window) -> None:
        self.windows[room].append(window)
        at = room + self.leaves
        while at and not self.any[at]:
            self.any[at] = 1
            at >>= 1

    def take(self, need: int):
        """Remove and return (room, window) with the least room of at least `need`; None if there is none."""
        at = need + self.leaves
        if not self.any[at]:
            while at & 1 or not self.any[at + 1]:  # climb until a subtree to the right holds a window
                at >>= 1
                if at <= 1:
                    return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        room = at - self.leaves
        window = self.windows[room].pop()
        if not self.windows[room]:
            self.any[at] = 0
            at >>= 1
            while at and not (self.any[2 * at] or self.any[2 * at + 1]):
                self.any[at] = 0
                at >>= 1
        return room, window


def pieces(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens): each document's ids and `end_id`, cut every `window` ids.

    A null or empty text is its end id alone. Rows with equal or null ids are separate documents. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, "dropped")
        for b in lean(batches):
            out = []
            for doc, ids in zip(b.column(0).to_pylist(), enc.each(b.column(1))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                out += [(doc, k, min(window, len(ids) - k), zlib.crc32(ids[k : k + window]), len(ids)) for k in range(0, len(ids), window)]
            cols = list(zip(*out)) or [[]] * 5
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return modest(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def _fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Best fit of lengths that come longest first: each one's window and its offset there."""
    tree, opened, where, offsets = CapacityTree(window), 0, [], []
    for n in lengths:
        found = tree.take(n) if n < window else None
        if found is None:
            found, opened = (window, opened), opened + 1
        room, w = found
        where.append(w)
        offsets.append(window - room)
        if room > n:
            tree.put(room - n, w)
    return where, offsets


def pack(cut: DataFrame, window: int = 2048, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add (sequence_id, offset) to stored `pieces`; windows hold no gaps before their last id. An empty table gives no rows."""
    spark = cut.sparkSession
    groups = max(1, -(-cut.count() // group_pieces))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(t: pa.Table):
            where, offsets = _fit(t.column("length").to_pylist(), window)
            base = t.column("pack_group")[0].as_py() << 32
            t = t.select(names[:5]).append_column(names[5], pa.array([base + w for w in where], pa.int64()))
            return t.append_column(names[6], pa.array(offsets, pa.int64())).to_batches()

        held: list[pa.RecordBatch] = []
        for b in batches:
            g = b.column(b.schema.get_field_index("pack_group")).to_numpy()
            ends = [*np.flatnonzero(np.diff(g)) + 1, len(g)] if len(g) else []
            at = 0
            for e in ends:
                if held and held[-1].column("pack_group")[0].as_py() != g[at]:
                    yield from packed(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(at, e - at))
                at = e
        if held:
            yield from packed(pa.Table.from_batches(held))

    # equal rows differ by their place in the stored table, so that any number of them spreads over all groups
    place = F.monotonically_increasing_id()
    dealt = cut.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", place), F.lit(groups)))
    order = ["pack_group", F.desc("length"), "doc_id", "start", "ids_crc32"]
    return (
        dealt.repartition(min(groups, max(width(spark), groups // 64)), "pack_group")
        .sortWithinPartitions(*order)
        .mapInArrow(run, f"{PIECES}, sequence_id long, offset long")
    )


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Cut and pack in one go; the pieces (five numbers each) are stored once, so that texts are encoded once."""
    return pack(settle(pieces(docs, tokenizer, window, end_id), "pieces"), window, group_pieces)
