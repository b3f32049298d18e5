"""Bin completion: against the optimum on small lots, the ids against the tokenizers library, whole packings for gaps."""

from __future__ import annotations

import random
import zlib
from functools import lru_cache
from itertools import combinations

import edges
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import bin_completion as bc

PATH = public_tokenizers.path("byte_bpe_50k.json")


def fewest(lengths, capacity):
    """The optimum by trying every set of pieces beside the largest."""

    @lru_cache(None)
    def go(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        best = len(left)
        for k in range(len(rest) + 1):
            for some in combinations(range(len(rest)), k):
                if first + sum(rest[i] for i in some) <= capacity:
                    best = min(best, 1 + go(tuple(x for i, x in enumerate(rest) if i not in some)))
        return best

    return go(tuple(sorted(lengths, reverse=True)))


@pytest.mark.parametrize("capacity,low,high", [(20, 1, 20), (50, 10, 30), (100, 20, 60), (12, 1, 6)])
def test_few_pieces_are_packed_best(capacity, low, high):
    r = random.Random(capacity)
    for _ in range(40):
        lengths = [r.randint(low, high) for _ in range(r.randint(1, 9))]
        bins = bc.pack_lengths(lengths, capacity)
        assert sorted(x for b in bins for x in b) == sorted(lengths)
        assert all(sum(b) <= capacity for b in bins)
        assert bc.least_bins(lengths, capacity) <= len(bins) == fewest(lengths, capacity)


def test_completion_beats_best_fit():
    found = 0
    r = random.Random(3)
    for _ in range(60):
        lengths = [r.randint(20, 70) for _ in range(40)]
        best, mine = len(bc.best_fit(sorted(lengths, reverse=True), 100)), len(bc.pack_lengths(lengths, 100))
        assert mine <= best
        found += mine < best
    assert found


def test_tiny_and_equal_lengths():
    assert len(bc.pack_lengths([1] * 5000, 2048)) == 3
    assert len(bc.pack_lengths([2047] * 30 + [1] * 30, 2048)) == 30
    assert len(bc.pack_lengths([1100] * 50 + [600] * 70, 2048)) == 57
    assert bc.pack_lengths([], 2048) == []


def test_fillings_are_undominated():
    r = random.Random(5)
    for _ in range(60):
        lengths = [r.randint(2, 40) for _ in range(8)]
        stock, room = bc.Stock(lengths, 60), r.randint(20, 59)
        before = list(stock.count)
        found = list(bc.fillings(stock, room, room, [10**6]))
        assert stock.count == before
        for f in found:
            assert sum(f) <= room and all(f.count(x) <= lengths.count(x) for x in f)
        tightest = max((sum(c) for k in range(6) for c in combinations(lengths, k) if sum(c) <= room), default=0)
        assert max(map(sum, found), default=0) == tightest


def expected(rows, window):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    out = []
    for doc, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % window or window, len(ids) + 1, window)]
        for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
            out.append((doc, k, s, e - s, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[s:e]))))
    return out


@pytest.mark.parametrize("window,group", [(64, 50), (2048, 8192)])
def test_pieces_lie_without_gaps(spark, window, group):
    got = [tuple(r) for r in bc.pack_documents(edges.documents(spark), PATH, window=window, group_pieces=group).collect()]
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted((r[:5] for r in got), key=order) == sorted(expected(edges.rows(), window), key=order)
    lots = {}
    for r in got:
        lots.setdefault(r[5], []).append((r[6], r[3]))
    for lot in lots.values():
        at = 0
        for offset, n in sorted(lot):
            assert offset == at
            at += n
        assert at <= window
    assert len(lots) <= -(-sum(r[3] for r in got) // window) + 2


def test_many_equal_rows_spread_over_groups(spark):
    same = spark.range(20_000).selectExpr("cast(null as long) as doc_id", "if(id % 2 = 0, null, 'a few words here') as text")
    got = bc.pack_documents(same, PATH, window=64, group_pieces=1000)
    n, total = got.count(), got.agg({"length": "sum"}).first()[0]
    assert n == 20_000
    assert got.select("sequence_id").distinct().count() <= -(-total // 64) + 1


def test_no_documents(spark):
    assert bc.pack_documents(edges.no_documents(spark), PATH).count() == 0
