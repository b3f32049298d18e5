"""Evaluation, trials, marketplace evidence and consumer migration."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from plumbline.operators import consumers as K
from plumbline.operators import evaluation as E
from plumbline.operators import verdict as V
from plumbline.plans import products as P
from plumbline.plans import semantic as M
from plumbline.plans.policy import entitlements
from plumbline.queries.base import query
from plumbline.queries.policy import EXEMPT, REGION_FILTER
from plumbline.queries.products import rounded, reliability_by_day
from plumbline.queries.semantic import MODEL, SAIDI
from plumbline.session import settle
from plumbline.queries.verdict import AS_OF, MARKET, NAMES, frames, own_verdicts
from plumbline.sources.testtables import RESTORE_SHARE, grid, table, users

METRICS, DIMS = ["saidi", "saifi", "caidi"], ["substation_id", "feeder_id"]

SCOPES = {
    "who": f"select user_id, case when {EXEMPT} then 'ALL' else coalesce(region, 'NONE') end as scope from users",
    "places": "select region as scope, substation_id, feeder_id from feeders union all select 'ALL', substation_id, feeder_id from feeders",
    "m": "select unnest(['saidi', 'saifi', 'caidi']) as metric",
    "cases": "select user_id, metric, dim as dimension, null as filter, w as time_window from who, m, (select unnest(['substation_id',"
    " 'feeder_id']) as dim), (select unnest(['last_month', 'last_3_months']) as w) union all select user_id, metric, null,"
    " 'substation_id=' || substation_id, 'last_month' from who join places on places.scope = who.scope cross join m union all select"
    " user_id, 'outage_count', unnest(['substation_id', 'feeder_id', 'region']), null, 'last_month' from who union all select"
    " user_id, 'daily_kwh', 'read_date', 'feeder_id=' || feeder_id, 'last_week' from who join places on places.scope = who.scope",
}


@query(
    "ev_benchmark",
    "select user_id, metric, dimension, filter, time_window, metric || coalesce(' by ' || dimension, '') || coalesce(' for ' || filter, '')"
    " || ' ' || replace(time_window, '_', ' ') as text from cases",
    extra=SCOPES,
)
def _(spark, d):
    return E.benchmark(users(spark, d), grid(spark, d)["feeders"], METRICS, DIMS, "daily_kwh")


# Orders as replayed questions: revenue per return flag is the result; the candidate mistakes high-tax lines.
REPLAY = {
    "lines": "select l_orderkey as question_id, l_returnflag as key, sum(l_extendedprice * (1 - l_discount)) as inc,"
    " sum(l_extendedprice * (1 - l_discount) * case when l_tax > 0.07 then 1.1 else 1.0 end) as cand, sum(l_quantity) as qty,"
    " max(l_tax) as tax from lineitem group by 1, 2",
    "per_order": "select question_id, string_agg(key || '=' || round(inc, 2)::decimal(38,2), ',' order by key) as ih, string_agg(key || '='"
    " || round(cand, 2)::decimal(38,2), ',' order by key) as ch, sum(qty) as qty from lines group by 1",
    "outcomes": "select o_orderkey as question_id, case when o_orderstatus = 'P' and o_orderpriority = '1-URGENT' then 'missing_data' else"
    " 'answered' end as inc_outcome, case when o_orderstatus = 'P' and o_orderpriority = '5-LOW' then 'missing_data' else 'answered' end as"
    " cand_outcome, o_orderpriority <> '2-HIGH' as same_shape from orders",
    "div": "select o.question_id, inc_outcome, cand_outcome, same_shape, case when inc_outcome <> 'answered' and cand_outcome <> 'answered'"
    " then 0.0 when inc_outcome <> cand_outcome then 1.0 when pct is null and same_shape then 0.0 when not same_shape then 1.0 else pct / 100"
    " end as divergence from outcomes o left join (select question_id, max(abs(round(cand, 4) - round(inc, 4)) / greatest(abs(round(inc, 4)),"
    " 1e-9) * 100) as pct from lines where abs(round(cand, 4) - round(inc, 4)) >= 1e-9 group by 1) x on x.question_id = o.question_id",
}


def replay(spark, d):
    line = table(spark, d, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = line.groupBy(F.col("l_orderkey").alias("question_id"), F.col("l_returnflag").alias("key")).agg(
        F.sum(net).alias("inc"),
        F.sum(net * F.when(F.col("l_tax") > 0.07, 1.1).otherwise(1.0)).alias("cand"),
        F.sum("l_quantity").alias("qty"),
    )
    o = F.col("o_orderpriority")
    partial = F.col("o_orderstatus") == "P"

    def outcome(bad):
        return F.when(partial & (o == bad), "missing_data").otherwise("answered")

    outcomes = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("question_id"),
        outcome("1-URGENT").alias("inc_outcome"),
        outcome("5-LOW").alias("cand_outcome"),
        (o != "2-HIGH").alias("same_shape"),
    )
    return rows, outcomes


def cells(rows, column):
    return rows.select("question_id", "key", F.lit("revenue").alias("metric"), F.col(column).alias("value"))


def _answers(spark, d):
    """Both agents' answers with a hash over their (at most three) rows.

    Sums are taken once and stored: taken again, their rows may be added in another order, and a sum between two cents rounds the
    other way, so that an answer would miss the truth made of the same rows.
    """
    rows, _ = replay(spark, d)

    def text(c):
        return F.concat_ws("=", "key", F.round(c, 2).cast("decimal(38,2)").cast("string"))

    hashed = rows.groupBy("question_id").agg(
        *[F.concat_ws(",", F.array_sort(F.collect_set(text(c)))).alias(c) for c in ("inc", "cand")], F.sum("qty").alias("qty")
    )
    status = table(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), F.col("o_orderstatus").alias("product"))
    hashed = settle(hashed.join(status, "question_id"), "answers")
    agent = F.inline(
        F.array(
            *[F.struct(F.lit(a).alias("agent"), F.col(c).alias("result_hash"), (F.col("qty") * w).alias("cost")) for a, c, w in (("v1", "inc", 1.0), ("v2", "cand", 0.98))]
        )
    )
    truth = hashed.select("question_id", F.col("inc").alias("ground_truth_hash"))
    return hashed.select("question_id", "product", "qty", agent), truth


@query(
    "ev_accuracy",
    "select agent, count(*) as n, count(*) filter (where h = ih) as correct, round(count(*) filter (where h = ih) / count(*), 6) as accuracy,"
    " round(sum(cost) / count(*), 6) as avg_cost, string_agg(distinct o_orderstatus, ',' order by o_orderstatus) filter (where h = ih) as"
    " touched, (select round(quantile_cont(qty, 0.95), 4) from per_order) as p95_latency from (select 'v1' as agent, question_id, ih, ih as h,"
    " qty as cost from per_order union all select 'v2', question_id, ih, ch, qty * 0.98 from per_order) join orders on o_orderkey ="
    " question_id group by 1",
    extra=REPLAY,
)
def _(spark, d):
    answers, truth = _answers(spark, d)
    p95 = E.p95_latency(answers.where("agent = 'v1'"), "qty")
    return E.accuracy(answers, truth).withColumn("p95_latency", F.lit(p95))


@query(
    "tr_traffic",
    "select asked_by, text, question_id from (select *, row_number() over (partition by asked_by, text order by o, asked_at, question_id) as"
    " rn from (select o_orderkey as question_id, o_custkey as asked_by, o_orderpriority as text, 0 as o, null::timestamp as asked_at from"
    " orders where o_orderstatus = 'F' union all select o_orderkey, o_custkey, o_orderpriority, 1, o_orderdate from orders where"
    " o_orderstatus <> 'F' and not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R'))) where rn = 1",
)
def _(spark, d):
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("question_id"),
        F.col("o_custkey").alias("asked_by"),
        F.col("o_orderpriority").alias("text"),
        F.col("o_orderdate").alias("asked_at"),
        "o_orderstatus",
    )
    exported = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("question_id"))
    return E.traffic(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus <> 'F'"), exported)


def _divergence(spark, d):
    rows, outcomes = replay(spark, d)
    return E.trial_divergence(outcomes, cells(rows, "inc"), cells(rows, "cand"))


@query(
    "tr_divergence",
    "select question_id, inc_outcome, cand_outcome, same_shape, round(divergence, 4)::double as divergence from div",
    extra=REPLAY,
)
def _(spark, d):
    return rounded(_divergence(spark, d))


@query(
    "tr_summary",
    "select count(*) as questions, count(*) filter (where divergence > 0) as divergent, round(count(*) filter (where divergence > 0) * 100.0 /"
    " count(*), 2)::double as divergent_pct, count(*) filter (where divergence > 0 and inc_outcome <> 'answered' and cand_outcome = 'answered') as"
    " new_capability, count(*) filter (where divergence > 0 and inc_outcome = 'answered') as regressions, round(count(*) filter (where"
    " divergence > 0 and inc_outcome = 'answered') / count(*) filter (where inc_outcome = 'answered'), 6) as regression_share,"
    " round(avg(o_totalprice), 6) as incumbent_cost, round(avg(o_totalprice * 0.98), 6) as candidate_cost, -2.0::double as cost_change_pct,"
    " false as passed from div join orders on o_orderkey = question_id",
    extra=REPLAY,
)
def _(spark, d):
    cost = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("question_id"), F.col("o_totalprice").alias("inc_cost"), (F.col("o_totalprice") * 0.98).alias("cand_cost")
    )
    return E.trial_summary(_divergence(spark, d).join(cost, "question_id"))


@query(
    "mk_evidence",
    "select p.product, age_hours, fresh, quality_score, criticality, " + NAMES.format("o.severity") + " as verdict,"
    " (p_size * 10)::double as demand_score, coalesce(c.credits, 0) as sla_credits_30d, coalesce(s.n, 0) as subscribers from products p join"
    " own o on o.product = p.product left join (select l_partkey, sum(l_quantity) as credits from lineitem where l_shipdate >= timestamp"
    " '2001-07-03' group by 1) c on c.l_partkey = p.product left join (select l_partkey, count(*) filter (where l_linestatus = 'O') as n from"
    " lineitem group by 1) s on s.l_partkey = p.product",
    extra=MARKET,
)
def _(spark, d):
    m = frames(spark, d)
    line = table(spark, d, "lineitem")
    ledger = line.select(F.col("l_partkey").alias("product"), F.col("l_quantity").alias("credits"), F.col("l_shipdate").alias("settled_at"))
    subs = line.select(F.col("l_partkey").alias("product"), F.when(F.col("l_linestatus") == "O", "active").otherwise("revoked").alias("status"))
    demand = m["products"].select("product", (F.col("p_size") * 10.0).alias("demand_score"))
    return E.evidence(m["status"], own_verdicts(m), demand, V.credits_since(ledger, AS_OF), subs)


# Suppliers as listings of the parts they deliver, orders as subscriptions to the supplier of their key.
BUNDLES = {
    "required": "select distinct l_suppkey as listing_id, l_partkey as product from lineitem where l_quantity > 45",
    "listing": "select listing_id, count(*) as products, count(*) filter (where p_size > 48) as absent from required join part on p_partkey ="
    " product group by 1",
    "subs": "select o_orderkey as bundle_id, s_suppkey as listing_id, o_custkey as principal, u.role from orders join supplier on s_suppkey ="
    " o_orderkey % (select count(*) from supplier) join users u on u.user_id = o_custkey",
    "bundle": "select s.bundle_id, s.principal, case when l.absent > 0 then 'pending_approval' else 'active' end as status, l.absent as missing,"
    " case when l.absent > 0 then 0 else l.products end as leases, round(coalesce(u.c, 0), 4)::double as credits_used, coalesce(u.n, 0) as runs_used"
    " from subs s join listing l on l.listing_id = s.listing_id left join (select l_orderkey, sum(l_tax) as c, count(*) as n from lineitem"
    " group by 1) u on u.l_orderkey = s.bundle_id",
}


def _bundles(spark, d):
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    suppliers = table(spark, d, "supplier")
    n = suppliers.agg(F.count(F.lit(1))).scalar()
    who = users(spark, d).select(F.col("user_id").alias("principal"), "role")
    subs = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("bundle_id"), (F.col("o_orderkey") % n).alias("listing_id"), F.col("o_custkey").alias("principal")
    )
    subs = subs.join(suppliers.select(F.col("s_suppkey").alias("listing_id")), "listing_id", "left_semi").join(who, "principal")
    required = line.where("l_quantity > 45").select(F.col("l_suppkey").alias("listing_id"), F.col("l_partkey").alias("product"))
    published = part.where("p_size <= 48").select(F.col("p_partkey").alias("product"))
    usage = line.select(F.col("l_orderkey").alias("bundle_id"), F.col("l_tax").alias("credits"))
    return subs, required, E.bundles(subs, required, published, usage)


@query("mk_bundle", "select bundle_id, principal, status, missing, leases, credits_used, runs_used from bundle", extra=BUNDLES)
def _(spark, d):
    return _bundles(spark, d)[2]


@query(
    "mk_leases",
    f"select b.bundle_id, b.principal, r.product, case when {EXEMPT} then null when u.region is null then 'FALSE' else 'region = ''' ||"
    " u.region || '''' end as row_filter, date '2001-10-31' as expires_on from bundle b join subs s on s.bundle_id = b.bundle_id join required r"
    " on r.listing_id = s.listing_id join users u on u.user_id = b.principal where b.status = 'active'".replace("u.role", "role"),
    extra={**BUNDLES, "subs": BUNDLES["subs"].replace(", u.role", "")},
)
def _(spark, d):
    subs, required, bundle = _bundles(spark, d)
    return E.leases(subs, required, entitlements(users(spark, d), [REGION_FILTER]), bundle, datetime(2001, 8, 2))


@query("con_affected", "select o_orderkey as consumer_id, o_custkey as owner from orders where o_orderkey in (select l_orderkey from lineitem where l_partkey = 7)")
def _(spark, d):
    consumers = table(spark, d, "orders").select(F.col("o_orderkey").alias("consumer_id"), F.col("o_custkey").alias("owner"))
    refs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("consumer_id"), F.col("l_partkey").alias("product"))
    return K.affected(consumers, refs, 7)


SAVED = M.Plan("reliability", ("saidi",), ("substation_id",), window="last_7_days")
RENAMES = {"saidi": "saidi_minutes"}


@query(
    "con_rename",
    f"select substation_id, {SAIDI} as saidi from reliability where day >= date '2024-01-24' and day < date '2024-01-31' group by 1",
)
def _(spark, d):
    """A saved question moved to version two: new metric name inside, old output name kept."""
    moved = M.rename_plan(M.Plan("reliability_v2", SAVED.metrics, SAVED.dimensions, window=SAVED.window), RENAMES)
    v2 = P.reliability_v2(grid(spark, d), "day", RESTORE_SHARE)
    out = M.compile_plan(MODEL, moved, v2, date(2024, 1, 31))
    return rounded(K.compatibility_view(out, RENAMES))


@query(
    "con_value_divergence",
    "select 'migrated' as comparison, round(max(abs(v - w) / abs(v)), 6) as divergence, count(*) > 0 as compared from saved join moved"
    " using (substation_id) where v <> 0 union all select 'one percent off', round(max(abs(v - v * 1.01) / abs(v)), 6), count(*) > 0 from"
    " saved where v <> 0 union all select 'other rows', case when count(*) <> (select count(*) from saved) then 1.0::double end,"
    " count(*) > 0 from (select * from saved union all select * from saved)",
    extra={
        n: f"select substation_id, {SAIDI} as {c} from reliability where day >= date '2024-01-24' and day < date '2024-01-31' group by 1"
        for n, c in (("saved", "v"), ("moved", "w"))
    },
)
def _(spark, d):
    """The saved question on both versions, then against results that are off or shorter."""
    old = settle(rounded(M.compile_plan(MODEL, SAVED, reliability_by_day(spark, d), date(2024, 1, 31))), "saved")
    moved = M.rename_plan(M.Plan("reliability_v2", SAVED.metrics, SAVED.dimensions, window=SAVED.window), RENAMES)
    new = rounded(M.compile_plan(MODEL, moved, P.reliability_v2(grid(spark, d), "day", RESTORE_SHARE), date(2024, 1, 31)))
    off = old.withColumn("saidi", F.col("saidi") * 1.01)
    rows = [("migrated", new), ("one percent off", off), ("other rows", old.union(old))]
    out = [(n, round(K.value_divergence(old, x), 6), True) for n, x in rows]
    return spark.createDataFrame(out, "comparison string, divergence double, compared boolean")


@query(
    "con_pin",
    "select o_orderkey as consumer_id, case when o_orderstatus = 'F' then 'held_on_previous' else 'accepted' end as status, case when"
    " o_orderstatus = 'F' then 1 end as pinned_version, case when o_orderstatus = 'F' then o_orderdate::date + 90 end as sunset_on from orders",
)
def _(spark, d):
    return K.decide(
        table(spark, d, "orders").select(
            F.col("o_orderkey").alias("consumer_id"),
            F.lit(1).alias("from_version"),
            F.lit(2).alias("to_version"),
            (F.col("o_orderstatus") != "F").alias("accepted"),
            F.col("o_orderdate").alias("decided_at"),
        )
    )
