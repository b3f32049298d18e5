"""Half-open bounds, restoration rule and tracer behaviour on hand-made rows."""

from __future__ import annotations

from collections import Counter
from datetime import datetime, timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

from plumbline.operators.intervals import expand_slots, interval_join
from plumbline.plans import products as P

T0 = datetime(2024, 1, 1)


def hours(n):
    return T0 + timedelta(hours=n)


def sources(spark, reads, outages, meters=(("m1", "f1"), ("m2", "f1"))):
    return {
        "feeders": spark.createDataFrame([("f1", "s1", "r1")], "feeder_id string, substation_id string, region string"),
        "meters": spark.createDataFrame(list(meters), "meter_id string, feeder_id string"),
        "outages": spark.createDataFrame(
            outages, "outage_id string, feeder_id string, start_ts timestamp, end_ts timestamp, cause_code string, customers_affected bigint"
        ),
        "reads": spark.createDataFrame(reads, "meter_id string, read_ts timestamp, kwh_delivered double, kwh_received double"),
    }


def test_interval_join_equals_nested_loops(spark):
    r = Random(7)
    intervals = []
    for i in range(60):
        start = T0 + timedelta(seconds=r.randrange(0, 10**6))
        length = r.choice([0, 1, 59, 3600, 7200, 3 * 3600, 86400, 10**6, 40 * 86400])
        intervals.append((i, r.randrange(3), start, start + timedelta(seconds=length, microseconds=r.choice([0, 1]))))
    points = [(i, r.randrange(3), T0 + timedelta(seconds=r.randrange(-1000, 10**6))) for i in range(300)]
    points += [(1000 + i, k, s) for i, (_, k, s, _) in enumerate(intervals)] + [(2000 + i, k, e) for i, (_, k, _, e) in enumerate(intervals)]
    a = spark.createDataFrame(intervals, "i int, k int, s timestamp, e timestamp")
    b = spark.createDataFrame(points, "p int, k int, at timestamp")
    got = sorted((x.i, x.p) for x in interval_join(a, b, ["k"], "s", "e", "at").collect())
    want = sorted((i, p) for i, k, s, e in intervals for p, kk, at in points if k == kk and s <= at < e)
    assert got == want and len(want) > 500


def test_interval_join_without_intervals(spark):
    a = spark.createDataFrame([], "k int, s timestamp, e timestamp")
    b = spark.createDataFrame([(1, T0)], "k int, at timestamp")
    assert interval_join(a, b, ["k"], "s", "e", "at").count() == 0


def test_exposure_bounds_and_zero_fill(spark):
    reads = [("m1", hours(1), 1.0, 0.0), ("m1", hours(2), 2.0, 0.0), ("m1", hours(3), 99.0, 0.0)]
    outages = [("o1", "f1", hours(1), hours(3), "WEATHER", 2)]
    rows = {r.meter_id: r for r in P.exposure(sources(spark, reads, outages)).collect()}
    assert (rows["m1"].reads_in_window, rows["m1"].kwh_in_window, rows["m1"].zero_usage_flag) == (2, 3.0, False)
    assert (rows["m2"].reads_in_window, rows["m2"].kwh_in_window, rows["m2"].zero_usage_flag) == (0, 0.0, True)


def test_exposure_equals_nested_loops_and_shuffles_no_pairs(spark):
    rng = Random(7)
    reads = [(m, hours(h / 4), rng.choice([None, 0.0, rng.random()]), 0.0) for m in ("m1", "m2") for h in rng.sample(range(200), 40)]
    outages = [(f"o{i}", "f1", hours(h), hours(h + rng.choice([-1, 0, 0.25, 3, 6, 30])), "WEATHER", 2) for i, h in enumerate(range(-3, 50))]
    outages.append(("open", "f1", hours(5), None, "WEATHER", 2))
    src = sources(spark, reads, outages)
    want = {}
    for o, _, start, end, *_ in outages:
        for m in ("m1", "m2"):
            held = [kwh for k, at, kwh, _ in reads if k == m and end is not None and start <= at < end]
            want[m, o] = (len(held), round(sum(x for x in held if x is not None), 9))
    for silent in (True, False):
        df = P.exposure(src, silent)
        got = {(r.meter_id, r.outage_id): (r.reads_in_window, round(r.kwh_in_window, 9)) for r in df.collect()}
        assert got == {k: v for k, v in want.items() if silent or v[0]}
        top = next(line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)
        assert "_part" in top  # the join that makes the pairs is the last


def test_exposure_by_sets_of_outages_equals_that_of_each(spark):
    """Outages alike are met once by a meter and listed last: the same rows, whatever is missing, repeated, off the hour or in many rows."""
    rng = Random(8)
    meters = [(f"m{i}", rng.choice(["f1", "f2", "f3", None])) for i in range(12)] + [("m0", "f2"), ("m1", "f1"), (None, "f1")]
    when = lambda: hours(rng.choice([rng.randrange(30), rng.random() * 30, 7]))
    reads = [(m, at, rng.choice([None, 0.0, 1e-9, 1e12, -1e12, rng.random()]), 0.0) for m in [*dict.fromkeys(m for m, _ in meters), "none"] for at in dict.fromkeys(when() for _ in range(25))]
    reads += [("m2", None, 5.0, 0.0), ("m3", None, None, 0.0)]
    outages = [(f"o{i % 280}", rng.choice(["f1", "f2", "f3", "f9", None]), (s := when()), s + timedelta(hours=rng.choice([-1, 0, 0.1, 6, 6, 6, 40])), "WEATHER", 2) for i in range(300)]
    outages += [("open", "f1", hours(5), None, "WEATHER", 2), ("open", "f1", None, hours(5), "WEATHER", 2), (None, "f2", hours(4), hours(9), "WEATHER", 2)] * 2
    src = sources(spark, reads, outages, meters)
    src["feeders"] = spark.createDataFrame([("f1", "s1", "r1"), ("f2", "s1", None), ("f2", "s2", "r2")], src["feeders"].schema)
    for silent in (True, False):
        want = Counter(tuple(r) for r in P.exposure(src, silent).withColumn("kwh_in_window", F.round("kwh_in_window", 4)).collect())
        for most in (1024, 3):
            sets = P.outage_sets(src, most)
            got = P.exposure(src, silent, sets=sets, places=4)
            assert Counter(tuple(r) for r in got.collect()) == want and got.dtypes == P.exposure(src, silent).dtypes
    assert P.outage_sets(src).count() < 250 and P.outage_sets(src).agg(F.sum(F.size("_ids"))).first()[0] == 306
    assert P.outage_sets(src, 3).agg(F.max(F.size("_ids"))).first()[0] < P.outage_sets(src).agg(F.max(F.size("_ids"))).first()[0]


@pytest.mark.parametrize("name", ["prod_exposure", "dq_boundary_cases"])
def test_pairs_are_only_listed(spark, small, name):
    """Above the step that lists a pair nothing is rounded, compared, counted or summed; what is listed comes out of the last join."""
    from plumbline.queries import all_queries

    plan = all_queries()[name].run(spark, small)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    listed = next(i for i, line in enumerate(plan) if "Generate posexplode" in line)
    assert listed < next(i for i, line in enumerate(plan) if "Join" in line)
    assert not any(x in line for line in plan[:listed] for x in ("round", "aggregate", "coalesce", "=", "Filter"))


def test_edge_spans_are_the_first_pairs_of_all(spark):
    from plumbline.queries.quality import edge_spans

    rng = Random(9)
    meters = [(rng.choice([None, "m1", "m2", f"m{i}"]), rng.choice(["f1", "f2", "f3", None])) for i in range(60)]
    outages = [(f"o{i}", rng.choice(["f2", "f3", "f9", None]), rng.choice([None, hours(1), hours(i)]), rng.choice([None, hours(90), hours(60 + i % 5)]), "WEATHER", 2) for i in range(60)]
    src = sources(spark, [], outages, meters)
    low = lambda x: (x is not None, x)
    for kept in (meters, [m for m in meters if m[0]], [m for m in meters if m[0] and m[1] == "f2"]):
        src["meters"] = spark.createDataFrame(kept, src["meters"].schema)
        pairs = [(m, s, e) for m, f in kept for _, g, s, e, *_ in outages if f is not None and f == g]
        want = sorted(pairs, key=lambda p: (low(p[0]), low(p[2]), low(p[1])))[:3]
        df = edge_spans(src)
        assert [tuple(r) for r in df.collect()] == want
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("row_number") >= 2  # both sides are cut to what may come first before they are joined


def test_restoration_is_first_time_half_the_meters_are_on(spark):
    reads = [("m1", hours(1), 0.0, 0.0), ("m2", hours(1), 0.0, 0.0), ("m1", hours(2), 0.5, 0.0), ("m2", hours(2), 0.0, 0.0)]
    outages = [("o1", "f1", hours(1), hours(6), "WEATHER", 2), ("o2", "f1", hours(3), hours(6), "PLANNED", 2)]
    got = {r.outage_id: r.restored_ts for r in P.verified_restoration(sources(spark, reads, outages)).collect()}
    assert got == {"o1": hours(2), "o2": hours(6)}


def test_reliability_fills_empty_periods_and_leaves_caidi_null(spark):
    outages = [("o1", "f1", hours(1), hours(6), "WEATHER", 2)]
    src = sources(spark, [], outages)
    src["feeders"] = src["feeders"].union(spark.createDataFrame([("f2", "s1", "r1")], src["feeders"].schema))
    src["meters"] = src["meters"].union(spark.createDataFrame([("m3", "f2")], src["meters"].schema))
    rows = {r.feeder_id: r for r in P.reliability(src).collect()}
    assert (rows["f1"].outage_count, rows["f1"].outage_count_over_4h, rows["f1"].saidi, rows["f1"].caidi) == (1, 1, 300.0, 300.0)
    assert (rows["f2"].outage_count, rows["f2"].saidi, rows["f2"].saifi, rows["f2"].caidi) == (0, 0.0, 0.0, None)


def test_dominant_cause_breaks_ties_by_name(spark):
    outages = [("o1", "f1", hours(1), hours(2), "WEATHER", 1), ("o2", "f1", hours(3), hours(4), "EQUIPMENT", 1)]
    row = P.reliability_v2(sources(spark, [], outages)).first()
    assert row.cause_category == "equipment" and "saidi" not in row.asDict() and row.saidi_minutes == 60.0


def test_slots_are_half_open(spark):
    ev = spark.createDataFrame([(hours(1), hours(3)), (hours(1), hours(1))], "s timestamp, e timestamp")
    assert [r.slot for r in expand_slots(ev, "s", "e", "2024-01-01", 3600).orderBy("slot").collect()] == [1, 2]


def test_no_cross_join_or_python_in_reliability(spark, small):
    from plumbline.queries.products import reliability_by_day

    plan = reliability_by_day(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_window_filter_reaches_the_scan(spark, small):
    df = spark.read.parquet(f"{small}/orders.parquet").select("o_orderkey", "o_orderdate")
    from plumbline.sources.tables import clone_window

    plan = clone_window(df, "o_orderdate", hours(0), hours(24))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate)" in plan and "o_totalprice" not in plan
    assert F is not None


def test_products_read_events_once_per_source(spark, small):
    """What derives from events is stored once; the product's own plan reads those steps alone."""
    from plumbline.plans import products as P
    from plumbline.queries.semantic import _parts
    from plumbline.session import settle
    from plumbline.sources.testtables import RESTORE_SHARE, grid

    kept = []
    src = grid(spark, small, keep=lambda df, name: kept.append(name) or settle(df, name))
    assert sorted(kept) == ["meters", "outages", "reads"]
    for df in (P.reliability(src, "day", RESTORE_SHARE), *_parts(spark, small).values()):
        assert "events.parquet" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_release_is_what_was_tested(spark, tmp_path):
    from plumbline.operators import publish
    from plumbline.plans import contracts as C
    from plumbline.sources.tables import VersionedTable

    contract = C.Contract("t", 1, C.columns("k integer", "v double"), ("k",), (C.Expectation("positive", "v > 0"),))
    table = VersionedTable(spark, str(tmp_path / "t"))
    good = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    assert publish.release(table, good.withColumn("v", -F.col("v")), contract, 1) == publish.Release(1, False, "failing tests: expect.positive")
    assert table.current() is None
    assert publish.release(table, good, contract, 1) == publish.Release(1, True, "published")
    twice = publish.release(table, good.union(good), contract, 2)
    assert (twice.published, twice.reason, twice.replaced) == (False, "failing tests: unique.k", 1)
    assert publish.release(table, good, contract, 3, approved=False).reason == "not approved"
    with pytest.raises(publish.VersionTaken):
        publish.release(table, good, contract, 1)
    table.write(good, 9)  # another writer stages, publishes later
    assert publish.release(table, good.where("k = 1"), contract, 4) == publish.Release(4, True, "published", 1)
    assert table.read().count() == 1 and table.read(1).count() == 2
    with pytest.raises(ValueError):
        table.drop(4)
    assert publish.recall(table, publish.Release(5, False, "x", 4), good, [], good, "d", "s") is None


def test_states_of_parts_merge_to_the_whole(spark, tmp_path):
    from plumbline.operators import check_states as CS
    from plumbline.operators.quality import check
    from plumbline.plans import contracts as C

    r = Random(5)
    contract = C.Contract(
        "t", 1, C.columns("a integer", "b varchar?", "p integer", "v double"), ("a", "b"),
        (C.Expectation("positive", "v > 0"), C.Expectation("broken", "nowhere > 1")), (C.ForeignKey("p", "up", "id"), C.ForeignKey("gone", "up", "id")),
    )
    rows = [(r.randrange(9), r.choice(["x", "y", None]), r.choice([None, *range(6)]), r.choice([None, -1.0, 2.0])) for _ in range(120)]
    df = spark.createDataFrame(rows, "a int, b string, p int, v double")
    up = {"up": spark.createDataFrame([(1,), (2,), (3,)], "id int")}
    want = sorted(tuple(x) for x in check(df, contract, up).collect())
    parts = [spark.createDataFrame(rows[i:j], df.schema) for i, j in ((0, 0), (0, 50), (50, 51), (51, 120))]
    states = [CS.state_of(x, contract) for x in parts]
    for order in (states, states[::-1], [CS.merge(states[:2]), CS.merge(states[2:])]):
        assert sorted(tuple(x) for x in CS.results(CS.merge(order), df, contract, up).collect()) == want
    for i, s in enumerate([states[3], *states[1:]]):
        CS.store(s, str(tmp_path / "s"), f"p{i}")
    CS.store(states[0], str(tmp_path / "s"), "p0")  # restated: the part's earlier state goes
    assert sorted(tuple(x) for x in CS.results(CS.load(spark, str(tmp_path / "s"), df, contract), df, contract, up).collect()) == want
