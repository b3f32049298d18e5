"""Resampling: CRCs of runs against zlib, the whole report against a plain version over strings."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import edges
import numpy as np
import pytest

from plumbline.llm import resampling as rs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def features(text):
    w = WORD.findall((text or "").translate(UPPER))
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(f):
    return zlib.crc32(f.encode()) % 10_000


def brute(docs, target):
    s, t = Counter(), Counter()
    for x in docs:
        s.update(map(bucket, features(x[1])[1]))
    for x in target:
        t.update(map(bucket, features(x)[1]))
    n, m = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n + 10_000) / ((s[b] + 1) * (m + 10_000)))) for b in range(10_000)]
    out, fit = [], []
    for k, x in enumerate(docs):
        w, f = features(x[1])
        h = int(hashlib.sha256(f"42:{'' if x[0] is None else x[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(y)] for y in f)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([x[0], len(f), weight, score, None])
        if len(w) >= 20:
            fit.append(k)
    fit.sort(key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0))
    for place, k in enumerate(fit[: 5 * len(fit) // 100], 1):
        out[k][4] = place
    return out


def order(r):
    return tuple((x is None, x or 0) for x in r)


def test_crc_of_runs_from_two_prefixes():
    texts = ["One two, THREE four", "", "x" * 700 + " b", "été 漢字 ☃ naïve_words a-b-c 12", "y" * 70_000 + " " + "z" * 300 + " w", "..."]
    runs = rs.Runs()
    for t in texts:
        runs.add(t.encode())
    runs.close()
    for n in (1, 2, 3):
        of, found = runs.buckets(n, 1 << 31)
        want = []
        for k, t in enumerate(texts):
            w = features(t)[0]
            want += [(k, zlib.crc32(" ".join(w[i : i + n]).encode()) % (1 << 31)) for i in range(len(w) - n + 1)]
        assert list(zip(of.tolist(), found.tolist())) == want


def test_shift_is_what_appending_does():
    rng, shift = np.random.default_rng(1), rs.Shift()
    data = rng.integers(0, 256, 3000).astype(np.uint8).tobytes()
    for a, n in ((5, 0), (7, 1), (9, 255), (11, 256), (13, 1000), (17, 2900)):
        whole, tail = zlib.crc32(data[: a + n]), zlib.crc32(data[a : a + n])
        assert int(shift(np.array([zlib.crc32(data[:a])], np.uint32), np.array([n]))[0]) ^ tail == whole


@pytest.mark.parametrize("piece", [40, 1 << 20])
def test_report_against_strings(spark, monkeypatch, piece):
    monkeypatch.setattr(rs, "_SLICE", piece)
    rows = edges.rows() + [(100 + k, edges.prose(50 + k, 15 + k), "en", "a", 0, *edges._FILL) for k in range(60)]
    target = [edges.prose(70, 40), None, "", edges.prose(2, 100)]
    got = rs.resample(spark.createDataFrame(rows, edges.SCHEMA), spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in got.dtypes} == {"bigint"}
    found, want = sorted((tuple(r) for r in got.collect()), key=order), sorted(map(tuple, brute(rows, target)), key=order)
    assert found == want
    assert sum(r[4] is not None for r in found) == 3


def test_equal_rows_tie_and_empty_tables(spark):
    text = edges.prose(4, 30)
    same = spark.range(4000).selectExpr("7L as doc_id", f"'{text}' as text")
    none = spark.createDataFrame([], "item_id long, text string")
    got = rs.resample(same, none)
    ranks = sorted(r["rank"] for r in got.where("rank is not null").collect())
    assert got.count() == 4000 and ranks == list(range(1, 201))
    assert rs.resample(edges.no_documents(spark), none).count() == 0
