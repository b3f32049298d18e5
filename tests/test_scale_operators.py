"""Operators written for skew and depth: against brute force, with what they promise about rounds, pairs and tasks."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter
from statistics import median

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import topk
from plumbline.functions.text import rank_documents, rank_in_groups
from plumbline.operators import consumers, demand, retrieval, verdict
from plumbline.operators import graph
from plumbline.operators.graph import reachable
from plumbline.operators.joins import split_join
from plumbline.operators.sweep import next_point

EDGE = "src string, dst string"


def closure(edges, seeds):
    found, todo = set(seeds), list(seeds)
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in found:
                found.add(b)
                todo.append(b)
    return found


def nodes(df):
    rows = [r["node"] for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("ring", [False, True])
def test_a_chain_of_a_thousand_takes_few_rounds(spark, ring):
    e = [(str(i), str(i + 1)) for i in range(999)] + ([("999", "0")] if ring else [])
    found, rounds = reachable(spark.createDataFrame(e, EDGE), spark.createDataFrame([("0",)], "node string"))
    assert nodes(found) == {str(i) for i in range(1, 1000)}
    assert rounds <= 12


@pytest.mark.parametrize("seed", range(3))
def test_reachable_in_random_graphs(spark, seed):
    r = random.Random(seed)
    e = [(str(r.randrange(40)), str(r.randrange(40))) for _ in range(45)] + [("7", "7"), ("1", "hub"), *(("hub", f"h{i}") for i in range(9))]
    e += [("h3", "deep0"), *((f"deep{i}", f"deep{i + 1}") for i in range(20)), ("x", None), (None, "y")]
    df, seeds = spark.createDataFrame(e + e[:5], EDGE), spark.createDataFrame([("1",), ("7",), ("nowhere",)], "node string")
    for back in (False, True):
        way = [(b, a) for a, b in e] if back else e
        want = closure([x for x in way if None not in x], {"1", "7", "nowhere"})
        assert nodes(reachable(df, seeds, inclusive=True, reverse=back)[0]) == want
        assert nodes(reachable(df, seeds, reverse=back)[0]) == want - {"1", "7", "nowhere"}


@pytest.mark.parametrize("back", [False, True])
def test_walks_by_kind_reach_the_same(spark, back):
    r = random.Random(4)
    kinds = {str(i): f"k{i % 5}" for i in range(40)} | {f"deep{i}": "deep" for i in range(8)}
    e = [(str(r.randrange(40)), str(r.randrange(40))) for _ in range(50)] + [("1", "deep0"), *((f"deep{i}", f"deep{i + 1}") for i in range(7)), ("deep7", "3")]
    df = spark.createDataFrame([(a, b, kinds[a], kinds[b]) for a, b in e + e[:4]], f"{EDGE}, x string, y string")
    starts = [("1", kinds["1"]), ("7", kinds["7"]), ("nowhere", "k0")]
    seeds = spark.createDataFrame(starts, "node string, kind string")
    want = closure([(b, a) for a, b in e] if back else e, {"1", "7", "nowhere"})
    assert nodes(reachable(df, seeds, inclusive=True, reverse=back, patience=2, kinds=("x", "y"))[0]) == want
    assert nodes(reachable(df, seeds.select("node"), inclusive=True, reverse=back, patience=8, kinds=("x", "y"))[0]) == want


def test_a_shallow_walk_stores_no_edges(spark, monkeypatch):
    labels, stored = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df, label="step": (labels.append(label), stored(df, label))[1])
    e = [("r:1", "c:1", "r", "c"), ("r:1", "c:2", "r", "c"), ("c:1", "o:1", "c", "o"), ("c:2", "o:2", "c", "o"), ("o:1", "p:1", "o", "p"), ("o:9", "p:9", "o", "p")]
    df = spark.createDataFrame(e, f"{EDGE}, x string, y string")
    found, rounds = reachable(df, spark.createDataFrame([("r:1", "r")], "node string, kind string"), patience=8, kinds=("x", "y"))
    assert nodes(found) == {"c:1", "c:2", "o:1", "o:2", "p:1"} and rounds == 4
    assert set(labels) == {"seeds", "reach"}  # neither edges nor jumps


def test_no_edges_and_no_seeds(spark):
    none, seed = spark.createDataFrame([], EDGE), spark.createDataFrame([("a",)], "node string")
    assert nodes(reachable(none, seed, inclusive=True)[0]) == {"a"}
    assert reachable(spark.createDataFrame([("a", "b")], EDGE), seed.where("false"))[0].count() == 0


def corpus(r, n, common):
    rare = [f"w{i}" for i in range(60)]
    return [" ".join([*r.sample(common, 2), *r.choices(rare, k=r.randint(1, 5))]) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_best_documents_are_those_of_all_pairs(spark, seed):
    r = random.Random(seed)
    common = ["number", "of", "kind", "part"]
    docs = spark.createDataFrame([(f"e{i:03}", t) for i, t in enumerate(corpus(r, 150, common) + ["", "of of of", "number"])], "e string, text string")
    texts = corpus(r, 30, common) + ["of", "", "unknown words", "number of kind part", "w1 w2 w3"]
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:5])], "q int, text string")
    need = spark.createDataFrame([(0, 9), (33, 40), (35, 2)], "q int, k int")
    also = spark.createDataFrame([(1, "e001"), (2, "e150"), (34, "e152"), (34, "e151")], "q int, e string")
    got = {(x.q, x.e): x.similarity for x in topk.best_documents(asked, docs, "q", "e", need, 5, also).collect()}
    every = rank_documents(asked, docs, "q", "e")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.round("similarity", 12).desc(), "e"))
    placed = every.withColumn("place", place).join(need, "q", "left")
    # equal texts are scored once, for the most that any of them needs
    wanted = {(x.q, x.e): x.similarity for x in placed.where("place <= greatest(5, coalesce(k, 5))").collect()}
    assert wanted.keys() <= got.keys() and (34, "e152") in got
    all_pairs = {(x.q, x.e): x.similarity for x in every.collect()}
    assert all(abs(s - all_pairs.get(p, 0.0)) < 1e-9 for p, s in got.items())
    extra = got.keys() - wanted.keys() - {(x.q, x.e) for x in also.collect()}
    assert {q for q, _ in extra} <= {0, 35, 36, 37}  # 35 is the text of 0, and so on
    assert max(Counter(q for q, _ in got).values()) <= 41


def test_common_terms_alone_bring_no_candidates(spark, monkeypatch):
    r, seen = random.Random(3), {}

    def keep(df, label="step"):
        out = settle(df, label)
        seen[label] = out
        return out

    settle = topk.settle
    monkeypatch.setattr(topk, "settle", keep)
    docs = spark.createDataFrame([(f"e{i}", f"common words everywhere w{i % 200} v{i % 190} u{i % 180}") for i in range(2000)], "e string, text string")
    asked = spark.createDataFrame([(i, f"common words w{r.randrange(200)} v{r.randrange(190)}") for i in range(50)], "q int, text string")
    assert topk.best_documents(asked, docs, "q", "e", k=5).count() >= 250
    assert seen["candidates"].count() < 50 * 2000 / 20  # all 2,000 documents share a term with every question


def test_groups_are_ranked_by_their_own_weights(spark):
    r = random.Random(9)
    docs = [(g, f"{g}{i}", t) for g in ("a", "b") for i, t in enumerate(corpus(r, 12, ["of", "the", "on"]))] + [("c", "c0", "")]
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(corpus(r, 20, ["of", "the", "on"]) + ["nothing known here"])], "q int, text string")
    df = spark.createDataFrame(docs, "g string, d string, text string")
    got = {(x.q, x.d): x.similarity for x in rank_in_groups(asked, df, "q", "g", "d").collect()}
    want = {(x.q, x.d): x.similarity for g in "abc" for x in rank_documents(asked, df.where(F.col("g") == g), "q", "d").collect()}
    assert got.keys() == want.keys() and all(abs(v - want[k]) < 1e-9 for k, v in got.items())


def test_split_join_spreads_a_heavy_key(spark):
    left = [(0 if i % 3 == 0 else i, i) for i in range(900)]
    right = [(0 if j % 3 == 0 else j, j * 10) for j in range(600)] + [(None, 1)]
    a, b = spark.createDataFrame(left, "k int, a int"), spark.createDataFrame(right, "k int, b int")
    got = split_join(a, b, ["k"], ["a"]).select("k", "a", "b", F.spark_partition_id().alias("p"))
    rows = got.collect()
    want = Counter((k, x, y) for k, x in left for m, y in right if m == k)
    assert Counter((r["k"], r["a"], r["b"]) for r in rows) == want


def test_tasks_of_a_split_join_are_even(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).cast("int").alias("k"), F.col("id").alias("a"))
        b = spark.range(600).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).cast("int").alias("k"), F.col("id").alias("b"))
        sizes = [r["count"] for r in split_join(a, b, ["k"], ["a"]).groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) <= 3 * median(sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("parts", ["3", "40"])
def test_next_point_against_every_pair(spark, parts):
    r = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    when = lambda: None if r.random() < 0.05 else t0 + dt.timedelta(minutes=r.randrange(3000))
    key = lambda: r.choice([1, 1, 1, 1, 2, 3, None])
    starts, points = [(i, key(), when()) for i in range(400)], [(key(), when()) for _ in range(60)]
    points += points[:10]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        s, p = spark.createDataFrame(starts, "id int, k int, s timestamp"), spark.createDataFrame(points, "k int, t timestamp")
        got = {x.id: x.n for x in next_point(s, p, ["k"], "s", "t", "n").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = {i: min((t for m, t in points if m == k and k is not None and t is not None and s is not None and t >= s), default=None) for i, k, s in starts}
    assert got == want


def brute_divergence(a, b):
    """Both sorted by the text of their columns, then compared cell by cell."""
    if len(a) != len(b):
        return 1.0
    text = lambda r: [("None" if x is None else str(x)).encode() for x in r]
    worst = 0.0
    for x, y in zip(sorted(a, key=text), sorted(b, key=text)):
        for u, v in zip(x, y):
            if isinstance(u, str) or isinstance(v, str) or u is None or v is None:
                worst = max(worst, float(u != v))
            elif abs(u - v) > 1e-9:
                worst = max(worst, abs(u - v) / max(abs(u), 1e-9))
    return worst


@pytest.mark.parametrize("seed", range(6))
def test_divergence_of_differing_ranges(spark, monkeypatch, seed):
    monkeypatch.setattr(consumers, "FEW", 0)
    r = random.Random(seed)
    a = [(f"{r.choice('abé漢')}{r.randrange(60)}", r.randrange(1, 50)) for _ in range(300)] + [(None, 3), ("", 4), ("a", 5)]
    b = list(a)
    for _ in range((0, 1, 3, 20, 300, 5)[seed]):
        i = r.randrange(len(b))
        b[i] = (b[i][0], b[i][1] * 2) if seed < 5 else (f"{r.choice('abz')}{r.randrange(60)}", b[i][1])
    r.shuffle(b)
    old, new = spark.createDataFrame(a, "k string, v int"), spark.createDataFrame(b, "key string, w int")
    assert consumers.value_divergence(old, new) == pytest.approx(brute_divergence(a, b))
    kept = consumers.differing_ranges(old, new)
    rows = sum((k or "None")[:n] in some for n, some in kept for k, _ in a)
    assert (rows == 0) == (seed == 0) and (seed != 1 or rows < 30)


def test_equal_results_are_not_put_in_order(spark, monkeypatch):
    monkeypatch.setattr(consumers, "_runs", None)
    df = spark.range(1000).selectExpr("id % 37 as k", "id * 0.5 as v")
    assert consumers.value_divergence(df, df.orderBy(F.desc("v")).toDF("x", "y")) == 0.0


def test_equal_questions_are_looked_up_once(spark, monkeypatch):
    stored, sizes, ranked = retrieval.settle, [], []

    def noted(df, label="step"):
        back = stored(df, label)
        sizes.append(back.count())
        return back

    monkeypatch.setattr(retrieval, "settle", noted)
    rank = demand.rank_documents
    monkeypatch.setattr(demand, "rank_documents", lambda q, *more: (ranked.append(q.count()), rank(q, *more))[1])
    asked = spark.createDataFrame([(i, ("Red ring", "hot bolt")[i % 2]) for i in range(200)], "question_id long, text string")
    elements = [("m:ring", "metric", "ring", ["ring"], "number of ring parts"), ("d:ring", "dimension", "ring", ["red"], "kind of part"), ("m:bolt", "metric", "bolt", ["bolt"], "number of bolt parts")]
    registry = spark.createDataFrame(elements, "element_id string, kind string, product string, phrases array<string>, description string")
    rows = Counter((r.question_id % 2, r.element_id, r.reason) for r in retrieval.retrieve(asked, registry).collect())
    assert rows == {(0, "m:ring", "phrase"): 100, (0, "d:ring", "phrase"): 100, (1, "m:bolt", "phrase"): 100}
    assert max(sizes) <= 6
    catalog = spark.createDataFrame([("ring", "red ring", None, True), ("bolt", "a bolt", None, True)], "column string, text string, classification string, searchable boolean")
    found = demand.sources(asked.selectExpr("question_id as concept", "lower(text) as text"), catalog).collect()
    assert Counter((r.concept % 2, r.column) for r in found) == {(0, "ring"): 100, (1, "bolt"): 100} and ranked == [2]


def test_certificates_meet_their_products_once(spark, small):
    from plumbline.queries import all_queries

    plan = all_queries()["cert_rules"].run(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 2 and plan.count("Join LeftSemi") == 0  # products with sales, certificates with products


def test_verdicts_against_the_rules(spark):
    r = random.Random(7)
    some = lambda *x: r.choice(x)
    metrics = {(c, f"m{r.randrange(3)}"): some(True, False, None) for c in range(0, 40, 3)} | {(99, "m0"): False}
    pairs = {(r.randrange(40), r.randrange(14)) for _ in range(120)}
    status = [(p, float(p), some(True, False, None), some(0.5, 0.7, 0.8, 0.9, 1.0, None), some(1, 4, 5, None)) for p in range(12)]
    made = [(p, 100 + p, "builder", some(None, "auto-gate", "reviewer"), some(True, True, False, None)) for p in range(3, 14)]
    rules = {c: [1 for (k, _), ok in metrics.items() if k == c and ok is False] for c in range(45)}
    for c, got in rules.items():
        seen = [s for s in status if (c, s[0]) in pairs]
        got += [1 for s in seen if s[2] is False] + [2 if s[3] < 0.7 else 1 for s in seen if s[3] is not None and s[3] < 0.9]
        if any(s[4] is not None and s[4] >= 4 for s in seen):
            got += [2 for a in made if (c, a[0]) in pairs and a[4] and a[3] in (None, "auto-gate")]
    frames = [
        spark.createDataFrame([(*k, v) for k, v in metrics.items()], "cert_id int, name string, certified boolean"),
        spark.createDataFrame(sorted(pairs), "cert_id int, product int"),
        spark.createDataFrame(status, "product int, age_hours double, fresh boolean, quality_score double, criticality int"),
        spark.createDataFrame(made, "product int, artifact_id int, agent string, approved_by string, is_agent boolean"),
    ]
    certs = spark.createDataFrame([(c,) for c in rules], "cert_id int")
    got = {x.cert_id: (x.verdict, x.rules_fired) for x in verdict.verdicts(certs, *frames).collect()}
    assert got == {c: (verdict.OUTCOMES[max(x, default=0)], len(x)) for c, x in rules.items()}
    traced = Counter((x.cert_id, x.severity) for x in verdict.rule_trace(*frames).collect() if x.cert_id in rules)
    assert traced == Counter((c, s) for c, x in rules.items() for s in x)
    assert {v for v, _ in got.values()} == set(verdict.OUTCOMES)
