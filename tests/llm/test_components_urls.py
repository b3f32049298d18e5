from __future__ import annotations

import random

import pytest

from plumbline.llm.components import components
from plumbline.llm.url_rules import judge_urls, page_edges


def brute(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
def test_components(spark, kind):
    r = random.Random(kind)
    pairs = {
        "random": [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(None, 1), (2, None), (5, 5), (7, 8), (7, 8), (8, 7)],
        "path": [(k, k + 1) for k in range(1000, 1100)],
        "star": [(9, k) for k in range(50, 90)],
        "none": [],
    }[kind]
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert dict(map(tuple, got)) == brute(pairs)
    assert len(got) == len({r.node for r in got})


PAGES = [
    (1, "http://a.net/x", '<link rel="canonical" href="http://q.io/y">'),
    (2, "HTTPS://Q.io/y#top", '<META http-equiv=refresh content="0;url=/w?a=1&amp;b">'),
    (3, "http://q.io/w?a=1&b", ""),
    (3, "http://q.io/w?a=1&b", ""),
    (4, "http://EXAMPLE.net/en/1", "<link href='//r.io/1' rel=canonical>"),
    (5, "http://r.io/1", '<p><link data-x rel="canonical" href="http://b.net/zz"></p>'),
    (6, "http://b.net/zz", None),
    (7, None, None),
    (8, "no scheme", "<link rel=canonical href=http://b.net/zz>"),
    (9, "http://org/fr/?x", None),
    (10, "http://x.net?foo", None),
    (11, "http://example.com/de/p", '<link rel="stylesheet" href="http://s.io/c">'),
    (12, "http://s.io/c", None),
    (13, "http://t.io/folder/page", '<link rel="canonical" href="other">'),
    (14, "http://t.io/folder/other", '<link rel="canonical" href="http://example.com/de/p">'),
    (None, "http://notnet/a", ""),
]


def test_verdicts(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as path", "3 as key", "4 as node")
    got = sorted(((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in judge_urls(df).collect()), key=str)
    want = [
        (1, "a.net", "/x", "net/", "block"),
        (2, "q.io", "/y", None, "block"),  # alias of a blocked page
        (3, "q.io", "/w", None, "block"),  # two hops away
        (3, "q.io", "/w", None, "block"),
        (4, "example.net", "/en/1", "example.net/en/", "allow"),
        (5, "r.io", "/1", None, "allow"),  # an alias is blocked, but another is allowed
        (6, "b.net", "/zz", "net/", "block"),
        (7, "", "", None, "allow"),
        (8, "", "", None, "allow"),
        (9, "org", "/fr/", "org/fr/", "allow"),
        (10, "x.net", "", None, "allow"),  # an empty path does not start with /
        (11, "example.com", "/de/p", "example.com/de/", "block"),
        (12, "s.io", "/c", None, "allow"),  # a stylesheet is no alias
        (13, "t.io", "/folder/page", None, "block"),
        (14, "t.io", "/folder/other", None, "block"),
        (0, "notnet", "/a", None, "allow"),
    ]
    assert got == sorted(want, key=str)
    assert judge_urls(df.limit(0)).collect() == []


LINKS = [
    ("http://e.io/a/b", "./y", "e.io/a/y"),
    ("http://e.io/a/b", "../z", "e.io/z"),
    ("http://e.io/a/b/c", "../../../z/./w/", "e.io/z/w/"),
    ("http://e.io/a/b/c", "..", "e.io/a/"),
    ("http://e.io/a/b/", ".", "e.io/a/b/"),
    ("http://e.io/p?a=1", "?b=2", "e.io/p?b=2"),
    ("http://e.io/p/", "http://e.io", "e.io/"),
    ("http://e.io?q", "/", "e.io/"),
    ("http://e.io/p", "/x&#63;a=1&#x26;b=&#50;&amp;c", "e.io/x?a=1&b=2&c"),
    ("http://e.io/p", "/&#228;&#x4E2D;", "e.io/ä中"),
    ("http://e.io/p", "/&#0;&#9999999;", "e.io/&"),
    ("http://e.io/.hidden/..x", "/.well-known/...", "e.io/.well-known/..."),
    ("http://e.io/p", "//F.io/../../q", "f.io/q"),
    ("http://e.io/p" + "/long" * 2000, "../" * 2000 + "k", "e.io/k"),
]


@pytest.mark.parametrize("kind", ["canonical", "refresh"])
def test_links_are_resolved(spark, kind):
    tag = '<link rel="canonical" href="{}">' if kind == "canonical" else '<meta http-equiv="refresh" content="3; url={}">'
    df = spark.createDataFrame([(i, u, "<p>" * 30_000 + tag.format(k)) for i, (u, k, _) in enumerate(LINKS)], "page_id long, url string, html string")
    assert {r.v for r in page_edges(df).collect()} == {k for _, _, k in LINKS}


def test_blocks_travel_over_relative_links(spark):
    rows = [("http://e.io/a/b", "../z"), ("http://e.io/z", "?b=2"), ("http://e.io/z?b=2", "http://e.io"), ("http://e.io/", "http://x.net/1"), ("http://other.io/", "./")]
    df = spark.createDataFrame([(i, u, f'<link rel=canonical href="{k}">') for i, (u, k) in enumerate(rows)], "page_id long, url string, html string")
    assert [r.verdict for r in judge_urls(df).orderBy("page_id").collect()] == ["block"] * 4 + ["allow"]


def test_given_redirects(spark):
    df = spark.createDataFrame(PAGES[2:3], "page_id long, url string, html string")
    hops = spark.createDataFrame([("http://q.io/w?a=1&b", "http://m.io/"), ("http://m.io/", "http://z.net/"), (None, "http://z.net/")], "f string, t string")
    assert [r.verdict for r in judge_urls(df, redirects=hops).collect()] == ["block"]
    assert [r.verdict for r in judge_urls(df, rules=[], redirects=hops, html_col=None).collect()] == ["allow"]


def test_edges_of_pages(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert ("t.io/folder/page", "t.io/folder/other") in {tuple(r) for r in page_edges(df).collect()}
