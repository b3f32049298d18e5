"""Policies, contracts, semantic plans, lineage and ledger on small cases."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from plumbline.operators import ledger as L
from plumbline.operators import lineage as G
from plumbline.operators import quality as Q
from plumbline.plans import contracts as C
from plumbline.plans import products as P
from plumbline.plans import semantic as M
from plumbline.plans.policy import KeyIsPersonal, Policy, Principal, apply_policies, decide, drop_personal
from plumbline.functions.times import window_bounds, window_columns
from plumbline.sources.testtables import grid, ledger

REGION = Policy("p1", "t", "row_filter", "region = :user.region", attribute="region")
MASK = Policy("p2", "t", "column_mask", "'***'", column="secret", classification="PII")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([("NORTH", "a", 1), ("SOUTH", "b", 2), ("O'X", "c", 3)], "region string, secret string, n int")


def seen(df, who):
    return sorted((r.region, r.secret) for r in apply_policies(df, "t", [REGION, MASK], who).collect())


def test_row_filter_and_mask(rows):
    assert seen(rows, Principal("a", "analyst", "NORTH")) == [("NORTH", "***")]
    assert seen(rows, Principal("a", "analyst", "O'X")) == [("O'X", "***")]
    assert len(seen(rows, Principal("a", "admin"))) == 3 and ("NORTH", "a") in seen(rows, Principal("a", "admin"))


def test_missing_attribute_sees_no_rows(rows):
    assert seen(rows, Principal("a", "analyst", None)) == []
    assert decide(REGION, Principal("a", "analyst", None)).predicate == "FALSE"


def test_masked_value_cannot_be_filtered_on(rows):
    df = apply_policies(rows, "t", [MASK], Principal("a", "analyst"))
    assert df.where("secret = 'a'").count() == 0


def test_personal_key_is_refused(rows):
    with pytest.raises(KeyIsPersonal):
        drop_personal(rows, {"secret"}, keys=["secret"])
    assert drop_personal(rows, {"secret"}, keys=["n"], masked=["secret"])[0].columns == rows.columns


@pytest.mark.parametrize("window", ["last_month", "month_before_last", "last_3_months", "this_month", "last_week", "last_7_days", "week_before_last", "yesterday", "all"])
def test_window_columns_agree_with_driver_dates(spark, window):
    days = [date(2024, 1, 1), date(2024, 3, 31), date(2024, 12, 15), date(2023, 2, 28)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    lo, hi = window_columns(window, F.col("d"))
    for r in df.select("d", lo.alias("lo"), hi.alias("hi")).collect():
        want = window_bounds(window, r.d) or (None, None)
        assert (r.lo, r.hi) == want


def test_plan_errors(rows):
    reg = M.Registry((M.Element("n", "measure", "t", "sum(n)"), M.Element("region", "dimension", "t", "region")))
    with pytest.raises(M.PlanError):
        M.compile_plan(reg, M.Plan("t", ("nope",)), rows, date(2024, 1, 1))
    with pytest.raises(M.PlanError):
        M.compile_plan(reg, M.Plan("t", ("n",), ("n",)), rows, date(2024, 1, 1))
    with pytest.raises(M.PlanError):
        M.compile_plan(reg, M.Plan("t", ("n",), window="last_week"), rows, date(2024, 1, 1))
    assert M.compile_plan(reg, M.Plan("t", ("n",)), rows, date(2024, 1, 1)).collect()[0].n == 6


def test_contract_shape_is_validated():
    with pytest.raises(C.ContractError):
        C.Contract("p", 1, C.columns("a integer", "a integer"), ("a",))
    with pytest.raises(C.ContractError):
        C.Contract("p", 1, C.columns("a integer"), ("b",))


def test_null_keys_count_and_runtime_errors_fail_one_test(spark):
    df = spark.createDataFrame([(None, "1"), (None, "x"), (1, "3")], "k int, v string")
    c = C.Contract("p", 1, C.columns("k integer?", "v varchar"), ("k",), (C.Expectation("cast", "cast(v as int) > 0"), C.Expectation("fine", "v is not null")))
    got = {r.test: r for r in Q.run_tests(df, c)}
    assert got["unique.k"].violations == 1
    assert not got["expect.cast"].passed and got["expect.cast"].detail.startswith("error")
    assert got["expect.fine"].passed
    assert Q.may_publish(c, list(got.values()), True, None)[0] is False
    good = [Q.Result("t", "schema", True, 0)]
    assert Q.may_publish(c, good, True, None)[0] and not Q.may_publish(c, good, True, 1)[0] and not Q.may_publish(c, good, False, None)[0]
    assert not Q.may_publish(c, [], True, None)[0]


def test_usage_reaches_every_product(spark, small):
    src = grid(spark, small)
    edges = [e for n, m in (("consumption", P.consumption_daily), ("exposure", P.exposure), ("reliability", P.reliability)) for e in G.column_edges(n, m, src)]
    down = {r.node for r in G.downstream_columns(G.edge_frame(spark, edges), "reads", ["kwh_delivered"]).collect()}
    assert {"consumption.kwh_delivered", "exposure.kwh_in_window", "reliability.saidi"} <= down
    assert "reliability.saifi" not in down and "consumption.kwh_received" not in down
    up = {r.node for r in G.upstream_columns(G.edge_frame(spark, edges), "reliability", ["saidi"]).collect()}
    assert {"reliability.saidi", "reads.read_ts", "outages.start_ts", "outages.customers_affected"} <= up
    assert {r.table for r in G.related_tables(G.edge_frame(spark, edges), "reliability").collect()} == {"feeders", "meters", "outages", "reads"}


def test_lineage_through_sql_union_window_and_cte(spark):
    t = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")

    def model(src):
        base = src["t"]
        first = base.selectExpr("a as x", "sum(b) over (partition by a) as y")
        return first.unionByName(base.selectExpr("c as x", "b + 1 as y"))

    edges = G.column_edges("m", model, {"t": t})
    assert set(edges) == {("t", "a", "m", "x"), ("t", "c", "m", "x"), ("t", "b", "m", "y"), ("t", "a", "m", "y"), ("t", "*", "m", "*")}

    def with_cte(src):
        src["t"].createOrReplaceTempView("lineage_t")
        return spark.sql("with s as (select a, b from lineage_t) select l.a as p, r.b as q from s l join s r on l.a = r.a")

    got = set(G.column_edges("m", with_cte, {"t": t}))
    assert {("t", "a", "m", "p"), ("t", "b", "m", "q")} <= got and ("t", "c", "m", "p") not in got


def test_clean_ledger_has_no_problems_and_edits_show(spark, small):
    rows = ledger(spark, small).withColumn("content_sha256", F.sha2("content", 256))
    turn = F.col("artifact_id") % 1000
    rows = rows.withColumn("prev_artifact_id", F.when(turn > 0, F.col("artifact_id") - 1))
    assert L.problems(rows).count() == 0
    sealed = L.seal(rows, b"k")
    assert L.broken_seals(sealed, b"k").count() == 0 and L.broken_seals(sealed, b"other").count() == rows.count()
    for field in ("agent", "approved_by", "content_sha256", "target_fqn"):
        edited = sealed.withColumn(field, F.when(F.col("artifact_id") == 0, "edited").otherwise(F.col(field)))
        assert [r.artifact_id for r in L.broken_seals(edited, b"k").collect()] == [0]
    cut = rows.where("artifact_id <> 1")
    assert {r.artifact_id for r in L.problems(cut).where("problem = 'bad_predecessor'").collect()} == {2}


def test_keyed_digest_is_hmac(spark):
    import hashlib
    import hmac

    from plumbline.functions.hashing import keyed_digest

    for key in (b"short", b"long" * 40):
        got = spark.range(1).select(keyed_digest(F.lit("message é"), key).alias("d")).first().d
        assert got == hmac.new(key, "message é".encode(), hashlib.sha256).hexdigest()


def test_linking_continues_chains(spark, small):
    at = datetime(2025, 1, 1)
    new = spark.createDataFrame(
        [(90001, "product_5", "model_sql", at, "a"), (90002, "product_5", "model_sql", at, "b"), (90003, "unknown", "patch", at, "c")],
        "artifact_id bigint, target_fqn string, artifact_kind string, created_at timestamp, content string",
    )
    old = ledger(spark, small)
    got = {r.artifact_id: r.prev_artifact_id for r in L.link(new, old).collect()}
    head = L.heads(old).where("target_fqn = 'product_5'").first()
    assert got == {90001: head.artifact_id if head else None, 90002: 90001, 90003: None}


def test_window_edges_and_model_problems(spark, small):
    src = grid(spark, small)
    at = datetime(2024, 1, 5)
    spans = spark.createDataFrame([("m", at, datetime(2024, 1, 6))], "meter_id string, start timestamp, end timestamp")
    rows = Q.window_edges(spans, src["reads"], "read_ts", "kwh_delivered")
    assert rows.drop("edge", "tried").dtypes == src["reads"].dtypes and rows.count() == 9
    inside = rows.where(f"read_ts >= '{at}' and read_ts < '2024-01-06'").select("edge").distinct().collect()
    assert sorted(r.edge for r in inside) == ["at start", "before end"]
    assert {r.tried: r.kwh_delivered for r in rows.select("tried", "kwh_delivered").distinct().collect()} == {"zero": 0.0, "missing": None, "tiny": 1e-9}
    missing = Q.model_problems(P.exposure(src), C.CONSUMPTION, {"customer", "events", "nation"})
    assert "reads undeclared region" in missing and "missing column read_date" in missing


def test_model_inputs_of_tables_in_many_files(spark, small, tmp_path):
    for t in ("customer", "events", "nation", "region"):
        spark.read.parquet(f"{small}/{t}.parquet").repartition(5).write.parquet(f"{tmp_path}/{t}.parquet")
    assert Q.model_inputs(P.consumption_daily(grid(spark, str(tmp_path)))) == ["customer", "events", "nation", "region"]


def test_filters_on_several_attributes(spark):
    from plumbline.plans.policy import Policy, Principal, decide, decisions

    policies = [Policy(f"p-{a}", "t", "row_filter", f"{a} = :user.{a}", attribute=a) for a in ("region", "market", "absent")]
    rows = [("u1", "analyst", "ASIA", "o'x\\y"), ("u2", "analyst", None, "m"), ("u3", "admin", "ASIA", None)]
    got = decisions(spark.createDataFrame(rows, "user_id string, role string, region string, market string"), policies).collect()
    assert len(got) == 9
    for u, role, region, market in rows:
        for p in policies:
            d = decide(p, Principal(u, role, region, {"market": market}))
            g = next(r for r in got if r.user_id == u and r.policy_id == p.policy_id)
            assert (g.applied, g.predicate, g.sentence) == (d.applied, d.predicate, d.sentence)
    text = next(r.predicate for r in got if r.user_id == "u1" and r.policy_id == "p-market")
    assert spark.createDataFrame([(rows[0][3],)], "market string").where(text).count() == 1


def test_version_zero_and_one_winner(spark, tmp_path):
    from plumbline.sources.tables import VersionedTable

    t = VersionedTable(spark, str(tmp_path / "t"))
    t.swap_in(spark.range(3), 0)
    t.swap_in(spark.range(5), 1)
    assert (t.read().count(), t.read(0).count(), t.current_version()) == (5, 3, 1)
    t.publish(0)
    assert t.current_version() == 0


def test_flip_is_found_at_any_distance(spark):
    from plumbline.operators import decision as N

    schema = "scope_value string, minutes double, interruptions bigint, served bigint, avg_served double, periods bigint, has_first boolean"
    rows = [("near", 10.0, 5, 100, 10.0, 1, True), ("far", 0.0, 0, 10**9, 0.001, 1, False), ("never", 0.0, 0, 0, 0.0, 1, True), ("done", 1e9, 10**9, 10, 1.0, 2, True)]
    totals = spark.createDataFrame(rows, schema)
    for t in (N.Threshold("saidi", ">", 50.0, "outage_count_over_4h"), N.Threshold("customers_interrupted", ">=", 40.0, "outage_count_over_4h")):
        for r in N.sensitivity(totals, t).collect():
            own = totals.where(f"scope_value = '{r.scope_value}'")
            crossed = lambda n: (v := N.counterfactual(own, t, t.driver, n).first().value) > t.value or (t.comparator == ">=" and v == t.value)  # noqa: B023, E731
            if r.flip_delta is None:
                assert r.scope_value == "never"
            else:
                assert crossed(r.flip_delta) and (not r.flip_delta or not crossed(r.flip_delta - 1))


def test_entry_runs(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.columns == ["feeder_id", "saidi"] and rows.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
