from __future__ import annotations

import hashlib

import edges
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import fingerprints as fp

TEXT = st.text(alphabet="abcé漢 ", max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT, TEXT, st.data())
def test_spans_and_extensions(a, b, data):
    x, y = fp.PrefixHashes(a), fp.PrefixHashes(b)
    i = data.draw(st.integers(0, len(a)))
    j = data.draw(st.integers(0, len(b)))
    n = data.draw(st.integers(0, min(len(a) - i, len(b) - j)))
    assert (x.span(i, n) == y.span(j, n)) == (a[i : i + n] == b[j : j + n])
    k = 0
    while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
        k += 1
    assert x.extension(y, i, j) == k
    spans = x.spans(3).tolist()
    assert len(spans) == max(0, len(a) - 2)
    texts = [a[p : p + 3] for p in range(len(a) - 2)]
    assert len(set(spans)) == len(set(texts))


def test_likeness_follows_shared_text():
    a = edges.prose(5, 2000)
    words = a.split()
    half = " ".join(words[:1000]) + " " + edges.prose(6, 1000)
    moved = "inserted in front " + a
    f = [fp.hexed(fp.sketch(fp.PrefixHashes(t))) for t in (a, half, moved, edges.prose(7, 2000), "")]
    assert fp.likeness(f[0], f[0]) == 1
    assert fp.likeness(f[0], f[2]) > 0.9
    assert 0.15 < fp.likeness(f[0], f[1]) < 0.55
    assert fp.likeness(f[0], f[3]) < 0.2
    assert fp.likeness(f[0], f[4]) == 0
    assert fp.likeness(f[4], f[4]) == 1


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for k, (doc, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        change = text[: len(text) - cut] + after[:cut]
        yield doc, len(text), hashlib.sha256(change.encode()).hexdigest(), *(fp.hexed(fp.sketch(fp.PrefixHashes(t))) for t in (text, change, after))


def check(df):
    want = sorted((d, n, s, a, b, fp.likeness(a, b), fp.likeness(a, c)) for d, n, s, a, b, c in brute([(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]) if d is not None)
    got = fp.fingerprint_documents(df).collect()
    assert len(got) == df.count()
    assert sorted(tuple(r)[:7] for r in got if r.doc_id is not None) == want


def test_documents_against_brute_force(spark, small):
    check(spark.read.parquet(f"{small}/documents.parquet"))


def test_edges(spark):
    check(edges.documents(spark))
    check(edges.documents(spark, 1))
    assert fp.fingerprint_documents(edges.no_documents(spark)).collect() == []


def test_null_ids_come_first(spark):
    rows = fp.fingerprint_documents(edges.documents(spark)).where("doc_id is null").collect()
    assert sorted(r.n_chars for r in rows) == [0, len(edges.prose(2, 300))]
