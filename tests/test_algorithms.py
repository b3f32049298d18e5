"""Iterative and approximate-looking algorithms against direct computations."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta
from itertools import combinations
from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.positions import with_position
from plumbline.functions.quantiles import exact_quantiles, order_statistics
from plumbline.functions.text import find_concepts
from plumbline.operators import consumers as K
from plumbline.operators import decision as N
from plumbline.operators import demand as D
from plumbline.operators import drift as X
from plumbline.operators import evaluation as E
from plumbline.operators import recall as R
from plumbline.operators.graph import reach
from plumbline.plans import products as P
from plumbline.queries import market


@pytest.mark.parametrize("limit", [5, 40, 100_000])
def test_order_statistics_with_heavy_runs(spark, limit):
    r = Random(3)
    values = [0.0] * 700 + [7.5] * 300 + [r.gauss(0, 100) for _ in range(997)] + [None] * 10
    r.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    kept = sorted(v for v in values if v is not None)
    ks = [0, 1, 350, 499, 800, 1100, 1500, 1995, 1996]
    assert order_statistics(df, [("v", k) for k in ks], limit) == [kept[k] for k in ks]
    got = exact_quantiles(df, ["v"], [0.5, 0.95], limit)
    assert np.allclose([got["v", 0.5], got["v", 0.95]], np.quantile(kept, [0.5, 0.95]))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert exact_quantiles(df, ["v"], [0.5]) == {("v", 0.5): None}


def test_positions(spark):
    r = Random(1)
    values = [(r.randrange(10**6), i) for i in range(5000)]
    df = with_position(spark.createDataFrame(values, "a int, b int").repartition(7), ["a", "b"])
    assert [(x.a, x.b) for x in df.orderBy("position").collect()] == sorted(values)
    assert [x.position for x in df.select("position").orderBy("position").collect()] == list(range(5000))


def average_linkage(vectors, distance):
    clusters = [[i] for i in range(len(vectors))]
    dist = 1 - vectors @ vectors.T
    while len(clusters) > 1:
        d, a, b = min((dist[np.ix_(x, y)].mean().round(12), x[0], y[0]) for x, y in combinations(clusters, 2))
        if d >= distance - 1e-12:
            break
        x, y = (next(c for c in clusters if c[0] == k) for k in (a, b))
        clusters.remove(x)
        clusters.remove(y)
        clusters = sorted([*clusters, sorted(x + y)])
    return sorted(clusters)


def tfidf(docs):
    terms = sorted({t for d in docs for t in d})
    df = {t: sum(t in d for d in docs) for t in terms}
    m = np.array([[(t in d) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t in terms] for d in docs])
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clusters_equal_average_linkage(spark, seed):
    r = Random(seed)
    words = [f"w{i}" for i in range(14)]
    docs = [sorted(r.sample(words[(i % 3) * 4 : (i % 3) * 4 + 6], r.randint(1, 4))) for i in range(24)]
    docs += [docs[0]] * 8  # a group of copies holding much of the rows
    df = spark.createDataFrame(list(enumerate(docs)), "question_id bigint, terms array<string>")
    got = {}
    for x in D.cluster(df).collect():
        got.setdefault(x.cluster, []).append(x.question_id)
    assert sorted(sorted(v) for v in got.values()) == average_linkage(tfidf(docs), 0.45)


def test_clustering_broadcasts_nothing(spark, monkeypatch):
    docs = [["a", "b", f"c{i % 5}", f"d{i}"] for i in range(30)] + [["a", "b", "c"]] * 4
    plans, stored = [], D.settle

    def noted(df, label="step"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, label)

    monkeypatch.setattr(D, "settle", noted)
    done = D.cluster(noted(spark.createDataFrame(list(enumerate(docs)), "question_id bigint, terms array<string>")))
    plans.append(done._jdf.queryExecution().executedPlan().toString())
    assert done.count() == 34 and len(plans) > 4
    assert not [x for x in plans if "Broadcast" in x]  # all sides grow with the questions


def test_similar_pairs_are_complete(spark):
    r = Random(5)
    words = [f"w{i}" for i in range(12)]
    docs = list({tuple(sorted(r.sample(words, r.randint(1, 5)))) for _ in range(40)})
    v = tfidf(docs)
    terms = sorted({t for d in docs for t in d})
    rows = [(i, t, float(v[i][j])) for i in range(len(docs)) for j, t in enumerate(terms) if v[i][j] > 0]
    got = {(x.a, x.b) for x in D.similar_pairs(spark.createDataFrame(rows, "c int, term string, w double"), "c", 0.55).collect()}
    assert got == {(a, b) for a, b in combinations(range(len(docs)), 2) if v[a] @ v[b] >= 0.55}


def test_concepts_longest_first_without_overlap(spark):
    glossary = [("zero usage", "zero"), ("usage", "use"), ("outage", "out"), ("outage window", "win")]
    df = spark.createDataFrame([("Zero usage, during the outage window!",), ("outages of usage",), ("usage zero usage",)], "t string")
    got = [x.c for x in df.select(find_concepts(F.col("t"), glossary).alias("c")).collect()]
    assert got == [["win", "zero"], ["use"], ["use", "zero"]]


def test_reach_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.depth for r in reach(e, seeds).collect()} == {"b": 1, "c": 2, "d": 3}
    assert {r.node for r in reach(e, seeds, reverse=True).collect()} == {"b", "c", "x"}


def test_demand_score_formula(spark):
    q = spark.createDataFrame([(1, "alice"), (1, "raj"), (1, "priya")], "intent_id int, asked_by string")
    u = spark.createDataFrame([("alice", "ops_manager"), ("raj", "analyst"), ("priya", "ops_director")], "user_id string, role string")
    assert D.score(q, u).first().demand_score == 3 * 2 + 3 + (3 + 1 + 3)


def test_sensitivity_is_the_smallest_flip(spark):
    rows = [("s", 1000.0, 40, 300, 25.0, 3, True), ("t", 0.0, 0, 10, 5.0, 1, False), ("u", 9e9, 10**7, 1, 1.0, 1, True)]
    totals = spark.createDataFrame(rows, "scope_value string, minutes double, interruptions bigint, served bigint, avg_served double, periods bigint, has_first boolean")
    t = N.Threshold("saidi", ">", 120.0, "outage_count_over_4h")
    got = {r.scope_value: r.flip_delta for r in N.sensitivity(totals, t).collect()}

    def metric(row, k):
        _, m, _, served, avg, periods, first = row
        return (m + avg * 241 * k) / (served / (periods + (0 if first else 1)))

    for row in rows:
        assert got[row[0]] == next(k for k in range(10**6) if metric(row, k) > 120.0)
    out = N.Threshold("customers_interrupted", ">=", 5e6, "customers_affected")
    assert {r.scope_value: r.flip_delta for r in N.sensitivity(totals, out).collect()} == {"s": 4_999_960, "t": 5_000_000, "u": 0}


def test_recall_is_strict_about_materiality(spark):
    at = "2024-01-05 10:00:00"
    answers = spark.createDataFrame([(1, "ann", at, "s", "ALL"), (2, "bob", at, "s", "ALL")], "cert_id int, consumer string, served_at string, shape string, scope string")
    answers = answers.withColumn("served_at", F.to_timestamp("served_at"))
    cell = "shape string, scope string, as_of date, key string, metric string, value double"
    import datetime as dt

    day = dt.date(2024, 1, 5)
    old = spark.createDataFrame([("s", "ALL", day, "k", "m", 100.0)], cell)
    settings = spark.createDataFrame([("bob", 0.5)], "consumer string, materiality_pct double")
    for new_value, due in ((101.0, {2}), (101.1, {1, 2}), (100.5, set()), (100.0, set())):
        new = spark.createDataFrame([("s", "ALL", day, "k", "m", new_value)], cell)
        assert {r.cert_id for r in R.notices(answers, old, new, settings).collect()} == due
        past = R.notices(answers, old, new, settings).select("cert_id", "new_hash")
        assert R.notices(answers, old, new, settings, past).count() == 0


def test_diff_counts_one_sided_keys_once(spark):
    cell = "id int, key string, metric string, value double"
    old = spark.createDataFrame([(1, "a", "m", 1.0), (1, "a", "n", 1.0), (1, "b", "m", None), (1, "c", "m", 2.0)], cell)
    new = spark.createDataFrame([(1, "b", "m", 3.0), (1, "c", "m", 2.0 + 1e-10), (1, "d", "m", 1.0)], cell)
    got = sorted((r.key, r.change, r.pct) for r in R.diff(old, new, ["id"]).collect())
    assert got == [("a", "removed", 100.0), ("b", "changed", 100.0), ("d", "added", 100.0)]


def test_value_divergence(spark):
    a = spark.createDataFrame([("x", 10.0), ("y", 20.0)] + [("z", 5.0)] * 40, "k string, v double")
    assert K.value_divergence(a, a.toDF("key", "value")) == 0.0
    b = a.withColumn("v", F.when(F.col("k") == "y", 21.0).otherwise(F.col("v")))
    assert K.value_divergence(a, b) == pytest.approx(0.05)
    assert K.value_divergence(a, a.where("k <> 'x'")) == 1.0
    assert K.value_divergence(a, a.replace("x", "q", "k")) == 1.0
    assert K.value_divergence(a, a.select("k")) == 1.0


def test_name_similarity_prefers_shared_starts():
    assert X.name_similarity("kwh_delivered", "energy_kwh_del") >= X.RENAME_NAME
    assert X.name_similarity("read_ts", "quality_flag") < X.RENAME_NAME
    assert X.name_similarity("a_b", "a_b") == 1.0


def test_drop_and_add_are_told_from_rename(spark):
    old = spark.createDataFrame([(i, f"s{i}", float(i)) for i in range(200)], "id int, label string, kwh_in double")
    new = spark.createDataFrame([(i, float(i), float(-i)) for i in range(200)], "id int, kwh_input double, weather double")
    changes = {(c.kind, c.column) for c in X.check(new, X.as_profiles(X.profile(old)))}
    assert changes == {("drop", "label"), ("rename", "kwh_input"), ("add", "weather")}
    assert X.check(old, X.as_profiles(X.profile(old))) == []


def test_answers_and_truth_are_of_one_replay(spark, small, monkeypatch):
    """Sums that come out otherwise when taken again must not part an agent's answers from the truth made of them."""
    real = market.replay
    drawn = F.udf(lambda: random.random(), "double").asNondeterministic()

    def replay(spark, d):
        rows, outcomes = real(spark, d)
        return rows.withColumn("inc", drawn()), outcomes

    monkeypatch.setattr(market, "replay", replay)
    answers, truth = market._answers(spark, small)
    got = {r.agent: (r.n, r.correct) for r in E.accuracy(answers, truth).collect()}
    assert got["v1"][0] == got["v1"][1] > 0


def test_statistics_by_sets_are_those_of_all_rows(spark):
    """A product of sets of outages alike has the statistics, and the divergence, of the product of all pairs."""
    r, t0 = Random(11), datetime(2024, 1, 1)
    at = lambda h: t0 + timedelta(hours=h)
    meters = [(f"m{i}", f"f{i % 2}") for i in range(9)]
    reads = [(m, at(h), r.choice([0.0, r.random(), float(h % 5)]), 0.0) for m, _ in meters for h in r.sample(range(60), 25)]
    outages = [(f"o{i:03d}", f"f{i % 2}", at(r.choice([7, h])), at(h + r.choice([0, 6, 6])), "WEATHER", 1) for i, h in enumerate(r.random() * 60 for _ in range(400))]
    outages.append(("open", "f0", at(3), None, "WEATHER", 1))
    src = {
        "feeders": spark.createDataFrame([("f0", "s", "r"), ("f1", "s", "r")], "feeder_id string, substation_id string, region string"),
        "meters": spark.createDataFrame(meters, "meter_id string, feeder_id string"),
        "outages": spark.createDataFrame(outages, "outage_id string, feeder_id string, start_ts timestamp, end_ts timestamp, cause_code string, customers_affected int"),
        "reads": spark.createDataFrame(reads, "meter_id string, read_ts timestamp, kwh_delivered double, kwh_received double"),
    }
    like, members = P.alike_outages(src, F.col("outage_id") == "o007")
    kept = {x.outage_id for x in like.collect()}
    assert len(kept) < 400 and "o007" in kept and members.count() == 401
    sets = X.Sets("outage_id", members.withColumnsRenamed({"start_ts": "outage_start_ts", "end_ts": "outage_end_ts"}))
    off = src["reads"].withColumn("kwh_delivered", F.round("kwh_delivered"))
    whole = [P.exposure({**src, "reads": x}).cache() for x in (src["reads"], off)]
    told = [sets.weigh(P.exposure({**src, "reads": x, "outages": like})).cache() for x in (src["reads"], off)]
    for a, b in zip(whole, told):
        a, b = X.statistics(a), X.statistics(b, sets)
        assert a["n"] == 9 * 200 + 5 and a.pop("distinct") == b.pop("distinct")
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    a, b = X.divergence(*whole, ["meter_id", "outage_id"]), X.divergence(*told, ["meter_id", "outage_id"], sets=sets)
    assert a.metrics == pytest.approx(b.metrics) and a.worst == b.worst and a.score > 0
