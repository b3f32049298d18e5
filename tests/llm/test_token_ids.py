"""Token ids, packing and token blocks: exact against the library, and whole."""

from __future__ import annotations

import zlib
from collections import defaultdict

import edges
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import packing, token_store
from plumbline.llm.tokens import Encoder

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ENCODERS = {"dropped": Encoder(WORD, "dropped"), "kept": Encoder(BYTE, "kept")}
ODD = st.text(alphabet=list("abXYéÉßİıΣς  \n\t\r\x0b\x1c 　.,''!?#12½́ﬀ\0<|>ÿ☃漢"), max_size=40)


def library(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, max_size=5), st.sampled_from(["dropped", "kept"]))
def test_ids_are_those_of_the_uncut_text(texts, spaces):
    e = ENCODERS[spaces]
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in e.each(pa.array(texts, pa.string()))] == want


def test_words_are_forgotten_in_time(monkeypatch):
    monkeypatch.setattr("plumbline.llm.tokens.REMEMBERED", 3)
    e = Encoder(WORD, "dropped")
    for text in ("a b c d", "e f g h", "a b c d"):
        assert next(iter(e.each(pa.array([text])))).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(e.place) <= 8


def expected_ids(df, path: str, end: int) -> list[tuple]:
    t = library(path)
    return [(r.doc_id, [*t.encode(r.text or "", add_special_tokens=False).ids, end]) for r in df.select("doc_id", "text").collect()]


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_packing(spark, docs, window: int, group: int) -> list:
    got = packing.pack_documents(docs, WORD, window=window, group_pieces=group).collect()
    want = defaultdict(int)
    for doc, ids in expected_ids(docs, WORD, 1):
        for k in range(0, len(ids), window):
            want[doc, k, min(window, len(ids) - k), crc(ids[k : k + window]), len(ids)] += 1
    have = defaultdict(int)
    sequences = defaultdict(list)
    for r in got:
        have[tuple(r)[:5]] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return [sum(n for _, n in parts) for parts in sequences.values()]


@pytest.mark.parametrize("group", [4, 8192])
def test_packing_edges(spark, group):
    check_packing(spark, edges.documents(spark), 256, group)


def test_packing_leaves_little_room(spark, small):
    used = check_packing(spark, spark.read.parquet(f"{small}/documents.parquet"), 2048, 8192)
    assert sum(used) / (2048 * len(used)) > 0.97


def test_equal_rows_spread_over_groups(spark):
    """A hundred thousand equal rows and as many without id or text: no group holds more than a little over its share."""
    same = spark.range(200_000).selectExpr("if(id % 2 = 0, 7L, null) as doc_id", "if(id % 2 = 0, 'the same few words', null) as text")
    got = packing.pack_documents(same, WORD, 256, group_pieces=8192)
    groups = [r["count"] for r in got.groupBy(F.shiftright("sequence_id", 32)).count().collect()]
    assert len(groups) == 25 and max(groups) < 1.2 * 8192 and sum(groups) == 200_000


def test_packing_nothing(spark):
    assert packing.pack_documents(edges.no_documents(spark), WORD).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_is_the_tightest(lengths):
    lengths = sorted(lengths, reverse=True)
    where, offsets = packing._fit(lengths, 64)
    room: dict[int, int] = {}
    for n, w, at in zip(lengths, where, offsets):
        fits = [r for r in room.values() if r >= n]
        if fits:
            assert room[w] == min(fits)
        else:
            assert w not in room
        assert at == 64 - room.get(w, 64)
        room[w] = room.get(w, 64) - n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=200))
def test_elias_fano(values):
    values = sorted(values)
    ef, _ = token_store.EliasFano.read(memoryview(token_store.EliasFano.of(np.array(values, np.int64)).tobytes()), 0)
    assert ef.all().tolist() == values
    assert [ef.select(i) for i in range(len(values))] == values
    read, end = token_store.EliasFano.read(memoryview(b"xy" + ef.tobytes() + b"z"), 2)
    assert end == len(ef.tobytes()) + 2 and read.sample.tolist() == ef.sample.tolist()
    with pytest.raises(IndexError):
        ef.select(len(values))


def test_elias_fano_is_small():
    bounds = np.cumsum(np.random.default_rng(1).integers(1, 2000, 10_000))
    assert len(token_store.EliasFano.of(bounds).tobytes()) < 10_000 * 13 / 8 + 100


def test_block_gives_any_document():
    ids = [np.array(x, np.uint32) for x in ([1, 2], [3], [4, 5, 50256])]
    b = token_store.Block(token_store.write_block([None, -4, 9], ids, 2))
    assert b.doc_ids() == [None, -4, 9]
    assert [b.tokens_of(i).tolist() for i in range(3)] == [x.tolist() for x in ids]
    with pytest.raises(ValueError):
        token_store.Block(b"other")


@pytest.mark.parametrize("block", [50, 1_000_000])
def test_token_store_round_trip(spark, block):
    docs = edges.documents(spark)
    got = token_store.read_tokens(token_store.write_tokens(docs, BYTE, block_ids=block)).collect()
    want, start = [], 0
    order = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    t = library(BYTE)
    for r in order:
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_token_store_nothing(spark):
    assert token_store.read_tokens(token_store.write_tokens(edges.no_documents(spark), BYTE)).collect() == []
