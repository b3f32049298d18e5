"""MinHash classes, repeated passages and vector components against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import edges
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from plumbline.llm import minhash, substrings, vectors
from plumbline.llm.hnsw import Graph
from plumbline.llm.words import Words

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def joined(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t\x0b\x1c é", max_size=40), st.integers(1, 4))
def test_words_and_grams(text, k):
    want = [w.encode() for w in split(text)]
    w = Words(text.encode())
    assert w.n == len(want)
    assert w.line == b" ".join(want)
    grams = [tuple(want[i : i + k]) for i in range(len(want) - k + 1)]
    assert len(set(w.grams(k).tolist())) == len(set(grams))
    assert len(w.shingles(k)) == (len(set(grams)) if len(want) >= k else min(1, len(want)))


def shingles(text, k):
    w = split((text or "").translate(UPPER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute_classes(rows, k):
    known = [(d, shingles(t, k)) for d, t in rows if d is not None]
    links = [(a, b) for i, (a, x) in enumerate(known) for b, y in known[:i] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    component = joined({d for d, _ in known}, links)
    return sorted(((d, len(shingles(t, k)), component.get(d), d is None or component[d] == d) for d, t in rows), key=str)


def check_classes(df, k):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in minhash.duplicate_classes(df, k).collect()), key=str) == brute_classes(rows, k)


def drifting(n=160, words=80, seed=3):
    """Copies that drift from one another: many similarities just above and just below the bound, chains included."""
    r = random.Random(seed)
    base = edges.prose(40, words).split()
    out, now = [], base
    for d in range(n):
        start = list(now if d % 3 else base)
        for _ in range(r.choice([1, 2, 4, 6, 9])):
            start[r.randrange(words)] = f"w{r.randrange(10_000)}"
        now = start
        out.append((d, " ".join(start)))
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_classes_of_drifting_copies(spark, k):
    check_classes(spark.createDataFrame(drifting(), "doc_id long, text string"), k)


def test_classes_of_sub_and_supersets(spark):
    words = edges.prose(41, 120).split()
    rows = [(d, " ".join(words[: 120 - 3 * d])) for d in range(30)] + [(100 + d, " ".join(words)) for d in range(20)]
    check_classes(spark.createDataFrame(rows, "doc_id long, text string"), 2)


@pytest.mark.parametrize("k", [2, 5])
def test_class_edges(spark, k):
    check_classes(edges.documents(spark), k)
    assert minhash.duplicate_classes(edges.no_documents(spark), k).collect() == []


def test_one_of_each_class_stays(spark):
    df = edges.documents(spark)
    got = minhash.drop_duplicates(df)
    assert got.schema == df.schema
    gone = {d for d, *_, kept in brute_classes([(r.doc_id, r.text) for r in df.collect()], 5) if not kept}
    assert edges.sorted_rows(got) == edges.sorted_rows(df.where(~df.doc_id.isin(list(gone)) | df.doc_id.isNull()))
    assert {2, 3} <= gone


def brute_removed(rows, window):
    first: dict[tuple, int] = {}
    for d, t in rows:
        w = split(t)
        for i in range(len(w) - window + 1):
            if d is not None:
                key = tuple(w[i : i + window])
                first[key] = min(d, first.get(key, d))
    out = []
    for d, t in rows:
        w = split(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def passages(seed=8, n=40):
    """Documents that share passages of lengths around the window, in other surroundings, twice in one document, and nested."""
    r = random.Random(seed)
    parts = [edges.prose(60 + k, k) for k in (5, 9, 10, 11, 19, 20, 21, 40)] + ["same same same same same same same same same same same same"]
    out = []
    for d in range(n):
        text = [edges.prose(1000 + 10 * d + k, r.randrange(0, 30)) for k in range(3)]
        for _ in range(r.randrange(0, 4)):
            text.insert(r.randrange(len(text) + 1), r.choice(parts))
        out.append((d * 3, " ".join(text)))
    out += [(200 + d, out[5][1]) for d in range(5)] + [(1, out[7][1] + " x")]
    return out


def check_removed(df, window):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = sorted((r[:4] for r in brute_removed(rows, window)), key=str)
    assert sorted((tuple(r) for r in substrings.substring_report(df, window).collect()), key=str) == want


@pytest.mark.parametrize("window", [2, 10, 11])
def test_passages(spark, window):
    check_removed(spark.createDataFrame(passages(), "doc_id long, text string"), window)


def test_text_that_repeats_itself(spark):
    """Its spans are stated once, however often it selects them, and every place of them is judged."""
    line, other = edges.prose(90, 7), edges.prose(91, 12)
    rows = [(1, f"{edges.prose(92, 60)} {f'{line} ' * 300}"), (2, f"{line} " * 400 + edges.prose(93, 30)), (3, f"x {f'{other} {line} {line} ' * 80}")]
    rows += [(4, f"{line} " * 50 + "cut " + f"{line} " * 50), (5, f"{other} {line} {line} " * 9), (6, "one " * 3000), (7, "two " + "one " * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_removed(df, 50)
    places = substrings.scan_documents(df, 50).select("doc_id", F.inline(F.arrays_zip("c1", "c2", "a", "more")))
    assert places.groupBy("doc_id", "c1", "c2").count().where("count > 1").count() == 0
    assert places.count() < 200 < places.select(F.explode("more")).count()


def test_passage_edges(spark):
    check_removed(edges.documents(spark), 50)
    assert substrings.substring_report(edges.no_documents(spark)).collect() == []


def test_repeats_are_cut(spark):
    df = edges.documents(spark)
    got = substrings.remove_repeats(df)
    assert got.columns == df.columns
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = [(d, t if not n else kept) for (d, t), (_, _, n, _, kept) in zip(rows, brute_removed(rows, 50))]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert all(r.n_chars is None or r.n_chars == len(r.text) for r in got.collect())
    assert substrings.remove_repeats(edges.no_documents(spark)).collect() == []


def cloud(seed=1, n=700, dim=16):
    """Random directions, tight clusters of many sizes, chains along an arc, copies."""
    g = np.random.default_rng(seed)
    rows = [g.normal(size=dim) for _ in range(n)]
    for size in (2, 3, 30, 150):
        c = g.normal(size=dim)
        rows += [c + g.normal(size=dim) * 0.1 for _ in range(size)]
    a, b = np.eye(dim)[:2]
    rows += [np.cos(t) * a + np.sin(t) * b for t in np.arange(0, 1.5, 0.3)]
    rows += [rows[k] * 2.5 for k in range(5)] + [rows[k] for k in range(5)]
    return rows


def brute_vectors(rows, least):
    fine = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    unit = {i: v / np.linalg.norm(v / np.abs(v).max()) / np.abs(v).max() for i, v in fine.items()}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least]
    n = {i: 0 for i, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    c = joined({i for i, _ in rows if i is not None}, links)
    return sorted(((i, n[i], c.get(i), i is None or c[i] == i) for i, _ in rows), key=str)


def check_vectors(spark, rows, recall=1.0):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as label", "2 as key", "3 as cls", "4 as id", "5 as v")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got, want = sorted((tuple(r) for r in vectors.vector_components(df).collect()), key=str), brute_vectors(rows, 0.9)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert all(a[1] <= b[1] for a, b in zip(got, want))
    assert sum(a[1] for a in got) >= recall * sum(b[1] for b in want)
    if recall == 1:
        assert got == want


def test_vectors(spark):
    check_vectors(spark, [(1000 - i, [float(x) for x in v]) for i, v in enumerate(cloud())], recall=0.99)


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0])]
    rows += [(None, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [-1.0, -0.0]), (12, [1e-30, 0.0]), (13, [1e30, 1e30]), (14, [0.9, 0.43588989435])]
    check_vectors(spark, rows)
    check_vectors(spark, [])


def test_graph_reaches_all_and_widens():
    g = np.random.default_rng(4)
    v = np.vstack([g.normal(size=(300, 16)), g.normal(size=16) + 0.02 * g.normal(size=(500, 16))])
    v /= np.linalg.norm(v, axis=1)[:, None]
    graph = Graph.build(v, 1 - g.random(len(v)))
    assert graph._reached().all()
    beam = graph.audited_beam(0.9, 4, 0.99, 200)
    found = sum(len(a) for a, _ in graph.within(v, 0.9, beam))
    assert found >= 0.99 * (v @ v.T >= 0.9).sum()
    again, ids = Graph.frombytes(graph.tobytes(np.arange(3)))
    assert ids.tolist() == [0, 1, 2]
    assert (again.search(v[:5], 8)[0] == graph.search(v[:5], 8)[0]).all()


def groups(n_pairs=300, n_cluster=400, dim=32, seed=9):
    """One cluster of a third of the vectors, pairs, and as many loners."""
    g = np.random.default_rng(seed)
    near = lambda c: c + 0.03 * g.normal(size=dim)
    c, heads = g.normal(size=dim), g.normal(size=(n_pairs, dim))
    v = np.vstack([[near(c) for _ in range(n_cluster)], heads, [near(h) for h in heads], g.normal(size=(n_pairs, dim))])
    v = v[g.permutation(len(v))]
    return v / np.linalg.norm(v, axis=1)[:, None]


@pytest.mark.parametrize("lost", ["own pairs", "guests"])
def test_the_audit_sees_small_groups_and_guests(lost):
    v = groups()
    guests, v = v[::4], np.delete(v, np.s_[::4], 0)
    degree = (v @ v.T >= 0.9).sum(1) - 1

    class Forgetful(Graph):
        def within(self, q, least, beam):
            at = np.argmax(q @ v.T, 1)
            own = (q == v[at]).all(1)
            for a, b in super().within(q, least, beam):
                gone = own[a] & (degree[at[a]] < 4) & (b != at[a]) if lost == "own pairs" else ~own[a]
                yield a[~gone | (beam >= 64)], b[~gone | (beam >= 64)]

    graph = Forgetful.build(v, np.random.default_rng(1).random(len(v)) + 1e-9)
    assert graph.audited_beam(0.9, 16, 0.99, 512, guests) == 64
    if lost == "own pairs":
        assert graph.audited_beam(0.9, 16, 0.99, 512) == 64


def test_small_groups_keep_their_links(spark):
    v = groups(600, 900)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = np.array([r.n_links for r in vectors.vector_components(df).orderBy("vec_id").collect()])
    want = (v @ v.T >= 0.9).sum(1) - 1
    assert (got <= want).all() and (got[want == 0] == 0).all()
    for some in ((want > 0) & (want < 4), want >= 4):
        assert (got[some] / want[some]).mean() >= 0.99
