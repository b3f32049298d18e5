"""Quality, toxicity and mixing."""

from __future__ import annotations

import math
import re
import zlib

import duckdb
import edges
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.llm import mixing, quality, toxicity

TENTH = "/root/testdata/sf0.1"


def accuracy(spark, report, target):
    docs, labels = (spark.read.parquet(f"{TENTH}/{t}.parquet") for t in ("documents", "labels"))
    rows = report(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", target).collect()
    y, s = np.array([r[2] for r in rows]), np.array([r[0] for r in rows])
    assert ((s >= 0) & (s <= 1)).all()
    order = np.argsort(np.argsort(s, kind="stable"))
    auc = (order[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))
    return auc, np.mean([r[1] == r[2] for r in rows])


def test_quality_on_held_out_documents(spark):
    auc, right = accuracy(spark, quality.quality_report, "quality")
    assert auc > 0.98 and right > 0.97


def test_toxicity_on_held_out_documents(spark):
    auc, right = accuracy(spark, toxicity.toxicity_report, "toxic")
    assert auc > 0.95 and right > 0.97


@pytest.mark.parametrize("report", [quality.quality_report, toxicity.toxicity_report])
def test_report_edges(spark, report):
    docs, labels = edges.documents(spark), edges.labels(spark)
    for d in (labels, labels.limit(0), edges.labels(spark, [(1, 1, 1), (2, 1, 1)])):
        got = report(docs, d).collect()
        assert len(got) == docs.count()
        for r in got:
            assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
            assert 0 <= r.score <= 1 and r.predicted in (0, 1)
    assert {r.score for r in report(docs, labels.limit(0)).collect()} == {0.5}
    assert report(edges.no_documents(spark), labels).collect() == []


def test_held_out_labels_change_nothing(spark):
    docs = edges.documents(spark)
    ids = [d for d in range(-5, 40) if zlib.crc32(str(d).encode()) % 5 == 0]
    more = edges.labels(spark).unionByName(edges.labels(spark, [(d, 0, 1) for d in ids]))
    for report in (quality.quality_report, toxicity.toxicity_report):
        assert edges.sorted_rows(report(docs, more)) == edges.sorted_rows(report(docs, edges.labels(spark)))


def test_quality_keeps_columns(spark):
    docs = edges.documents(spark)
    assert quality.keep_quality(docs, edges.labels(spark), 0.0).schema.names == docs.schema.names
    assert quality.keep_quality(docs, edges.labels(spark), 0.0).count() == docs.count()


def distance_one(a: str, b: str) -> bool:
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def test_automaton_against_all_edits():
    entries = [("abcde", False), ("abc", False), ("bcdab", True), ("dcba", True), ("aaaaa", False)]
    lex = toxicity.Lexicon(entries)
    rng = np.random.default_rng(2)
    for _ in range(20_000):
        word = "".join(rng.choice(list("abcdex"), rng.integers(1, 9)))
        want = []
        for k, (text, stem) in enumerate(entries):
            heads = [word[:n] for n in range(len(word) + 1)] if stem else [word]
            if text in heads:
                want.append((0, k))
            elif len(text) >= toxicity.MISSPELT and any(distance_one(text, h) for h in heads):
                want.append((1, k))
        got = lex.match(word)
        assert (got is None) == (not want), word
        if want:
            assert got[0] == min(want)[0], word


def test_quotations_are_pairs():
    def inside(text):
        return [text[a + 1 : b] for a, b in zip(*toxicity.quotations(text))]

    assert inside('he "one two" and "three", then') == ["one two", "three"]
    assert inside('a 5" pipe and a 7" one, he "said so" twice') == ["said so"]
    assert inside('lost " mark, then "real one" and more') == ["real one"]
    assert inside('lost "mark\nnext "line" end') == ["line"]
    assert inside("il dit «mot» et „Wort“ und “so”") == ["mot", "Wort", "so"]
    assert inside('("all")') == ["all"] and inside('"') == [] and inside("") == [] and inside('""') == []
    assert inside('"far' + " x" * 400 + '" off "near"')[-1] == "near"
    assert inside('say "' + "x " * 200 + 'y"') == ["x " * 200 + "y"]


def test_misspelt_and_quoted_terms():
    insult, calm = "worthless", edges.WORDS
    rng = np.random.default_rng(3)
    text = lambda extra: " ".join(w for k in range(60) for w in ([rng.choice(calm)] + ([extra] if extra and k % 15 == 7 else [])))
    abuse = [text(insult) for _ in range(60)]
    quoting = [text(None) + f' they wrote "{insult}" here' for _ in range(30)]
    plain = [text(None) for _ in range(200)]
    m = toxicity.train(abuse + quoting + plain, [1] * 60 + [0] * 230)
    assert (insult, False) in m.entries
    assert m.score(text(insult).encode()) > 0.5
    assert m.score(text("worthles").encode()) > 0.5
    assert m.score(text("w0rthless").encode()) > 0.5
    assert m.score((text(None) + f' he said "{insult}" again').encode()) < 0.5
    assert m.score(b"") < 0.5


def brute_fit(cells, temperature, sweeps):
    total = sum(cells.values())
    f = {k: v / total for k, v in cells.items()}
    goals = []
    for m in range(3):
        own: dict = {}
        for k, v in f.items():
            own[k[m]] = own.get(k[m], 0) + v
        raised = {k: v**temperature for k, v in own.items()}
        goals.append({k: v / sum(raised.values()) for k, v in raised.items()})
    for _ in range(sweeps):
        for m in range(3):
            own = {}
            for k, v in f.items():
                own[k[m]] = own.get(k[m], 0) + v
            f = {k: v * goals[m][k[m]] / own[k[m]] for k, v in f.items()}
    return f, goals


def test_raking_against_brute_force(spark):
    rng = np.random.default_rng(1)
    cells = {(s, la, t): int(rng.integers(1, 1000)) for s in ("a", "b", None) for la in ("en", None) for t in ("prose", "table") if rng.random() < 0.9}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, tokens long")
    got = mixing.fit_cells(df, temperature=0.5, sweeps=20).collect()
    want, goals = brute_fit(cells, 0.5, 20)
    for r in got:
        assert math.isclose(r.fitted, want[r.source, r.lang, r.topic], rel_tol=1e-9)
    for m, name in enumerate(mixing.MARGINALS):
        for value, goal in goals[m].items():
            assert math.isclose(sum(r.fitted for r in got if r[name] == value), goal, rel_tol=1e-3)


def test_given_targets(spark):
    df = spark.createDataFrame([("a", "en", "prose", 100), ("b", "en", "prose", 300), ("c", "en", "prose", 600)], "source string, lang string, topic string, tokens long")
    got = {r.source: r.fitted for r in mixing.fit_cells(df, {"source": {"a": 0.5, "b": 0.3, "z": 0.2}}).collect()}
    assert got == pytest.approx({"a": 0.625, "b": 0.375, "c": 0.0})


@pytest.mark.parametrize("budget", [0.1, 0.5, 0.9, 1.0])
def test_probabilities_meet_the_budget(spark, budget):
    rows = [("a", "en", "prose", 100, 0.5), ("b", "en", "prose", 300, 0.3), ("c", "en", "prose", 600, 0.2)]
    df = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, fitted double")
    got = mixing.calibrate(df, budget).collect()
    assert sum(r.tokens * r.probability for r in got) == pytest.approx(1000 * budget)
    free = [r for r in got if r.probability < 1]
    assert len({round(r.probability * r.tokens / r.fitted, 6) for r in free}) <= 1
    assert all(r.probability <= 1 for r in got)


def test_mixing_edges(spark):
    docs = edges.documents(spark)
    got = mixing.mixing_report(docs).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.probability <= 1 and r.tokens >= 1 and r.topic for r in got)
    kept = mixing.sample_mix(docs)
    assert kept.schema == docs.schema
    ids = sorted((r.doc_id is not None, r.doc_id) for r in got if r.sampled)
    assert sorted((r.doc_id is not None, r.doc_id) for r in kept.collect()) == ids
    assert mixing.mixing_report(edges.no_documents(spark)).collect() == []
    assert mixing.sample_mix(edges.no_documents(spark)).collect() == []


def test_the_sample_has_the_mix(spark):
    docs = spark.read.parquet(f"{TENTH}/documents.parquet")
    rows = mixing.mixing_report(docs)
    total, taken, expected = rows.agg(F.sum("tokens"), F.sum(F.when(F.col("sampled"), F.col("tokens"))), F.sum(F.col("tokens") * F.col("probability"))).first()
    assert expected == pytest.approx(0.7 * total, rel=1e-6)
    assert taken == pytest.approx(0.7 * total, rel=0.05)


def test_shares_say_what_the_sample_holds(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    said = {(r.marginal, r.value): r for r in mixing.mix_shares(docs).collect()}
    rows = mixing.mixing_report(docs).collect()
    whole = sum(r.tokens * r.probability for r in rows)
    for m in mixing.MARGINALS:
        values = {r[m] for r in rows}
        assert values == {v for k, v in said if k == m}
        assert abs(sum(said[m, v].target for v in values) - 1) < 1e-6
        for v in values:
            own = [r for r in rows if r[m] == v]
            s = said[m, v]
            assert abs(s.expected - sum(r.tokens * r.probability for r in own) / whole) < 1e-6
            assert abs(s.most - sum(r.tokens for r in own) / whole) < 1e-6
            assert s.expected <= s.most + 1e-9 and s.reachable == (s.most >= s.target - 1e-9)
        assert abs(sum(said[m, v].goal for v in values) - 1) < 1e-9
    for s in said.values():
        assert abs(s.expected - s.goal) < 1e-8  # every marginal is met, bounded cells or not
        assert s.goal >= s.target - 1e-9 if s.reachable else abs(s.goal - s.most) < 1e-9
    assert not all(s.reachable for s in said.values())  # small topics here
    assert mixing.mix_shares(edges.no_documents(spark)).count() == 0


@pytest.mark.parametrize("budget", [0.3, 0.8, 1.0])
def test_bounded_raking_is_the_closest_sample(spark, budget):
    """Against a dual solution: kept shares are min(bound, own share x a factor for each value), and make every goal."""
    rng = np.random.default_rng(5)
    cells = [(s, la, t, int(rng.integers(1, 2000))) for s in ("a", "b", "c", None) for la in ("en", "de") for t in ("prose", "table", "contact")]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    rows = mixing.calibrate(mixing._rake(df, None, 0.3, 100, budget), budget).collect()
    total = sum(r.tokens for r in rows)
    taken = {(r.source, r.lang, r.topic): r.tokens * r.probability / (budget * total) for r in rows}
    assert sum(taken.values()) == pytest.approx(1)
    for i, m in enumerate(mixing.MARGINALS):
        for v in {r[m] for r in rows}:
            goal = next(r[f"goal_{m}"] for r in rows if r[m] == v)
            assert sum(x for k, x in taken.items() if k[i] == v) == pytest.approx(goal, abs=1e-7)
    # the factors of cells below their bound are products of one factor for each value
    free = [r for r in rows if r.probability < 1 - 1e-9]
    assert budget < 1 or not free
    if len(free) > 9:
        names = [(m, v) for m in mixing.MARGINALS for v in {r[m] for r in rows}]
        x = np.array([[r[m] == v for m, v in names] for r in free], float)
        y = np.log([r.probability for r in free])
        assert np.abs(x @ np.linalg.lstsq(x, y, rcond=None)[0] - y).max() < 1e-5


def test_goals_that_exclude_each_other_still_meet_the_budget(spark):
    df = spark.createDataFrame([("a", "en", "prose", 100), ("b", "de", "prose", 900)], "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.1, "b": 0.9}, "lang": {"en": 0.2, "de": 0.8}}
    got = mixing.calibrate(mixing.fit_cells(df, targets, sweeps=6, budget=0.5), 0.5).collect()
    assert sum(r.tokens * r.probability for r in got) == pytest.approx(500)


def test_runs_are_of_characters():
    odd = quality.grams("\u6587\u5b57 caf\u00e9 the".encode())
    assert [int(np.count_nonzero(use)) for _, use in odd[2:]] == [2 + 4 + 3, 1 + 3 + 2]  # " wo" to "rd ", in characters
    plain = quality.grams(b"the")
    assert set(plain[2][0][plain[2][1]]) <= set(odd[2][0][odd[2][1]])  # the same runs beside other scripts
    spread = {int(quality.grams(f"\u4e00{chr(0x4E00 + a)}{chr(0x4F00 + b)}".encode())[2][0][1]) for a in range(16) for b in range(16)}
    assert len(spread) > 250
    emoji = quality.grams("\U0001f600\U0001f601\U0001f602".encode())
    assert int(np.count_nonzero(emoji[2][1])) == 3


def test_tokens_are_words_whatever_the_white_space(spark):
    rng = np.random.default_rng(7)
    texts = ["", " ", " " * 1000, "\t\r\n", "a", " a", "a ", "a\tb\tc\r\n" * 200, "def f():\n        return  1\n", "a\x0bb\x0cc\rd", "<>\r\t<>", "\u00a0 \u00e9t\u00e9", "\ud55c\uad6d\uc5b4 \ubb38\uc7a5"]
    texts += ["".join(rng.choice(list("ab\u00e9<> \t\n\r\x0b\x0c"), rng.integers(1, 30))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    got = {r.text: r.n for r in df.select("text", mixing.token_weight(F.col("text")).alias("n")).collect()}
    assert got.pop(None) == 1
    assert got == {t: 1 + len(re.findall("[^\x20\x09-\x0d]+", t)) for t in texts}
    strict = "select text, 1 + len(list_filter(string_split_regex(text, '[ \\x09-\\x0D]+'), lambda x: x <> '')) from t"
    t = pd.DataFrame({"text": texts})  # noqa: F841
    assert got == dict(duckdb.sql(strict).fetchall())


def test_unspaced_scripts_weigh_by_length(spark):
    han, kana, thai, khmer = "\u6587\u5b57", "\u3072\u30ab", "\u0e01\u0e32\u0e23\u0e19", "\u1781\u17d2\u1798\u17c2"
    want = {han: 2, han * 500: 501, kana * 500: 501, thai * 500: 501, khmer * 500: 501, "\U00020000" * 1000: 501, f"ab{han}cd  ef": 5, f"{han}\u3002\n{han}": 4, han[:1]: 2}
    df = spark.createDataFrame([(t,) for t in want], "text string")
    assert {r.text: r.n for r in df.select("text", mixing.token_weight(F.col("text")).alias("n")).collect()} == want
