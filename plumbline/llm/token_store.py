"""Token ids on disk: blocks of one concatenated id array with Elias-Fano coded document boundaries.

A block is a byte string, kept as a binary column of Parquet so that any store Spark can write will do:

    magic "PLTB2\\n" | little-endian uint32: documents, documents without id, bytes per token id | int64 first document id
    | Elias-Fano of document ids less the first | Elias-Fano of documents + 1 boundaries | ids

An Elias-Fano section is uint32 count, uint32 low bits, uint64 bytes of the lower part, uint64 bytes of the upper part, the
parts, and the samples: a uint32 for every 64th number, the place of its bit in the upper part. Numbers are written in ascending order: low
bits packed, high bits in unary. `select` starts at the sample before a number and reads the few bytes up to it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import lean, modest, width
from plumbline.llm.tokens import encoder
from plumbline.session import settle

MAGIC, HEAD, SECTION = b"PLTB2\n", "<IIIq", "<IIQQ"
#: Ids after which a block is closed; a document is never split.
BLOCK_IDS = 1_000_000
BLOCKS = "part int, block int, start_in_part long, n_docs long, n_ids long, payload binary"
_STEP = 64


class EliasFano:
    """A non-decreasing sequence of non-negative integers in about 2 + log2(universe / count) bits each."""

    def __init__(self, count: int, low_bits: int, lower: np.ndarray, upper: np.ndarray, sample: np.ndarray):
        self.count, self.low_bits, self.lower, self.upper, self.sample = count, low_bits, lower, upper, sample

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        if not len(v):
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, "<u4"))
        low_bits = max(0, (int(v[-1]) // len(v)).bit_length() - 1)
        low = ((v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(len(v))
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        return cls(len(v), low_bits, np.packbits(low.ravel(), bitorder="little"), np.packbits(bits, bitorder="little"), ones[::_STEP].astype("<u4"))

    def tobytes(self) -> bytes:
        return struct.pack(SECTION, self.count, self.low_bits, len(self.lower), len(self.upper)) + self.lower.tobytes() + self.upper.tobytes() + self.sample.tobytes()

    @classmethod
    def read(cls, buf: memoryview, at: int) -> tuple[EliasFano, int]:
        count, low_bits, a, b = struct.unpack_from(SECTION, buf, at)
        at += struct.calcsize(SECTION)
        lower = np.frombuffer(buf, np.uint8, a, at)
        sample = np.frombuffer(buf, "<u4", -(-count // _STEP), at + a + b)
        return cls(count, low_bits, lower, np.frombuffer(buf, np.uint8, b, at + a), sample), at + a + b + sample.nbytes

    def _low(self, i: int) -> int:
        bit = i * self.low_bits
        first, last = bit >> 3, bit + self.low_bits + 7 >> 3
        return int.from_bytes(self.lower[first:last].tobytes(), "little") >> (bit & 7) & (1 << self.low_bits) - 1

    def select(self, i: int) -> int:
        """The i-th number, reading only a few bytes after the nearest sample."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        at, left = int(self.sample[i // _STEP]), i % _STEP
        byte, bits = at >> 3, int(self.upper[at >> 3]) >> (at & 7)
        at, left = at & 7, left + 1
        while (n := bits.bit_count()) < left:  # whole bytes before the one that holds the bit
            left -= n
            byte, at, bits = byte + 1, 0, int(self.upper[byte + 1])
        for _ in range(left - 1):
            bits &= bits - 1
        place = 8 * byte + at + (bits & -bits).bit_length() - 1
        return ((place - i) << self.low_bits) | self._low(i)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[: self.count]
        high = (ones - np.arange(len(ones))).astype(np.int64) << self.low_bits
        if not self.low_bits:
            return high
        low = np.unpackbits(self.lower, count=self.count * self.low_bits, bitorder="little").reshape(self.count, self.low_bits)
        return high | (low.astype(np.int64) << np.arange(self.low_bits)).sum(1)


def write_block(docs: list[int | None], ids: list[np.ndarray], bytes_per_id: int = 4) -> bytes:
    """One block; documents come in ascending order, those without id first."""
    known = np.array([d for d in docs if d is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    head = struct.pack(HEAD, len(docs), len(docs) - len(known), bytes_per_id, first)
    body = np.concatenate(ids).astype(f"<u{bytes_per_id}").tobytes() if ids else b""
    return MAGIC + head + EliasFano.of(known - first).tobytes() + EliasFano.of(bounds).tobytes() + body


class Block:
    """Random access to one block's documents."""

    def __init__(self, payload: bytes):
        if payload[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token block")
        buf = memoryview(payload)
        self.n_docs, self.n_null, self.bytes_per_id, self.first = struct.unpack_from(HEAD, buf, len(MAGIC))
        at = len(MAGIC) + struct.calcsize(HEAD)
        self._ids, at = EliasFano.read(buf, at)
        self.bounds, at = EliasFano.read(buf, at)
        self.tokens = np.frombuffer(buf, f"<u{self.bytes_per_id}", -1, at)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.n_null + [self.first + int(x) for x in self._ids.all()]

    def tokens_of(self, i: int) -> np.ndarray:
        return self.tokens[self.bounds.select(i) : self.bounds.select(i + 1)]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode every text, append `end_id`, and write blocks in ascending id order to the shared folder; returns the stored blocks.

    A null or empty text is its end id alone; null ids come first; rows with equal ids are separate documents, ordered by text;
    an empty table gives no blocks. Texts are shuffled once, by ranges of the id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer, "kept"), TaskContext.get().partitionId()
        wide = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        ids, held, size, start, block = [], [], 0, 0, 0

        def closed() -> pa.RecordBatch:
            row = [[part], [block], [start], [len(ids)], [size], [write_block(ids, held, wide)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=["part", "block", "start_in_part", "n_docs", "n_ids", "payload"])

        for b in lean(batches):
            for doc, x in zip(b.column(0).to_pylist(), enc.each(b.column(1))):
                ids.append(doc)
                held.append(np.append(x, np.uint32(end_id)).astype(f"<u{wide}"))
                size += len(held[-1])
                if size >= block_ids:
                    yield closed()
                    ids, held, size, start, block = [], [], 0, start + size, block + 1
        if ids:
            yield closed()

    ordered = modest(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = ordered.repartitionByRange(width(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return settle(ordered.mapInArrow(run, BLOCKS), "token_blocks")


def read_tokens(blocks: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) decoded from stored blocks; start counts all ids before the document."""
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row per range partition: bounded by their number
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = blocks.join(F.broadcast(totals), "part").select((F.col("base") + F.col("start_in_part")).alias("start"), "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, payload in zip(b.column(0).to_pylist(), b.column(1)):
                block = Block(payload.as_py())
                bounds = np.array([block.bounds.select(i) for i in range(block.n_docs + 1)], np.int64)
                whole = block.tokens.astype("<u4")
                crc = [zlib.crc32(whole[a:e]) for a, e in zip(bounds[:-1], bounds[1:])]
                cols = [block.doc_ids(), bounds[:-1] + start, np.diff(bounds), crc]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
