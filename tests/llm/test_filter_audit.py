"""Filter audit: galloping against sets, and the whole report against a plain count over documents."""

from __future__ import annotations

import random
from collections import Counter
from itertools import permutations

import edges
import pytest

from plumbline.llm import filter_audit as fa


def test_gallop_finds_the_first_place():
    r = random.Random(1)
    for _ in range(300):
        x = sorted(r.sample(range(200), r.randrange(1, 60)))
        at, bound = r.randrange(len(x) + 1), r.randrange(-5, 205)
        want = next((i for i in range(at, len(x)) if x[i] >= bound), len(x))
        assert fa.gallop(x, bound, at) == max(want, at)


def test_merges_agree_with_sets():
    r = random.Random(2)
    for n in (0, 1, 5, 80):
        for _ in range(60):
            lists = [sorted(r.sample(range(100), r.randrange(n + 1))) for _ in range(5)]
            marked = [sorted(r.sample(range(100), 30)), []]
            sizes = fa.set_sizes(lists, marked)
            for chosen in range(32):
                want = set().union(*(x for k, x in enumerate(lists) if chosen >> k & 1))
                assert fa.union([x for k, x in enumerate(lists) if chosen >> k & 1]) == sorted(want)
                assert sizes[chosen] == (len(want), *(len(want & set(m)) for m in marked))


def brute(docs, labels):
    first, part_of = {}, []
    for d, t, _, s, *_ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    for d, t, _, s, *_ in docs:
        t = t or ""
        w = t.encode().split()
        fails = set()
        fails |= {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t) else set()
        fails |= {"D"} if set(t) & set("#$%&*|") else set()
        fails |= {"E"} if d is not None and first[t] < d else set()
        of = [x for x in labels if d is not None and x[0] == d]
        part_of.append((s or "", fails, any(x[1] == 1 for x in of), any(x[2] == 1 for x in of)))
    out = []
    for part in {p for p, *_ in part_of}:
        own = [x[1:] for x in part_of if x[0] == part]
        rows, shapley = [], Counter()
        for p in permutations("ABCDE"):
            there = own
            for step, f in enumerate(p, 1):
                gone = [x for x in there if f in x[0]]
                there = [x for x in there if f not in x[0]]
                shapley[f] += len(gone)
                redundant = sum(f in x[0] for x in own) - len(gone)
                rows.append((part, "".join(p), step, len(there), len(gone), redundant, sum(x[0] == {f} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
LABELS = ((1, 1, 0), (2, 1, 0), (3, 0, 1), (5, 0, 0), (5, 1, 1), (7, None, None), (None, 1, 1), (8, 1, 0), (9, 0, 1))


@pytest.mark.parametrize("block", [3, 65_536])
def test_report_against_counts(spark, monkeypatch, block):
    monkeypatch.setattr(fa, "BLOCK", block)
    extra = [
        (20, "HUGE Shout " * 150, "en", "a", 0, *edges._FILL),
        (21, "cost 5% & more " + edges.prose(9, 250), "en", "a", 0, *edges._FILL),
        (22, edges.prose(2, 300), "en", "b", 0, *edges._FILL),
        (19, edges.prose(2, 300), "en", "b", 0, *edges._FILL),
    ]
    rows = edges.rows() + extra
    got = fa.filter_audit(spark.createDataFrame(rows, edges.SCHEMA), edges.labels(spark, LABELS))
    assert got.columns[0] == "part" and set(got.columns) == set(COLUMNS)
    assert sorted(tuple(r) for r in got.select(COLUMNS).collect()) == brute(rows, LABELS)


def test_many_equal_rows_and_empty_tables(spark):
    same = spark.range(20_000).selectExpr("5L as doc_id", "'just one text' as text", "'hot' as source")
    got = fa.filter_audit(same, edges.labels(spark, ())).where("filter_order = 'ABCDE' and step = 1").collect()
    assert [(r["part"], r["kept"], r["removed"], r["unique_fails"]) for r in got] == [("hot", 0, 20_000, 20_000)]
    assert fa.filter_audit(edges.no_documents(spark), edges.labels(spark)).count() == 0
