"""Row filters, masks, tracer exclusion and entitlements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from plumbline.plans import products as P
from plumbline.plans.policy import Policy, Principal, apply_policies, decisions, drop_personal, entitlements
from plumbline.queries.base import query
from plumbline.queries.products import REGION_FILTER, rounded
from plumbline.sources.testtables import grid, users

ADDRESS_MASK = Policy("pol-address", "meters", "column_mask", "'***'", column="service_address", classification="PII")
POLICIES = [REGION_FILTER, ADDRESS_MASK]
PRINCIPALS = [Principal("ann", "analyst", "ASIA"), Principal("bob", "admin", None), Principal("eve", "ops_manager", None)]


@query(
    "pol_row_filter",
    "select u.user_id, c.feeder_id, round(sum(c.kwh_delivered), 4) as kwh from consumption c join (values ('ann', 'ASIA'),"
    " ('bob', null)) u(user_id, region) on u.user_id = 'bob' or c.region = u.region group by 1, 2",
)
def _(spark, d):
    product = P.consumption_daily(grid(spark, d))
    seen = [
        apply_policies(product, "consumption", POLICIES, who)
        .groupBy(F.lit(who.user_id).alias("user_id"), "feeder_id")
        .agg(F.round(F.sum("kwh_delivered"), 4).alias("kwh"))
        for who in PRINCIPALS
    ]
    return reduce(lambda a, b: a.unionByName(b), seen)


@query(
    "pol_column_mask",
    "select 'ann' as user_id, meter_id, meter_type, '***' as service_address from meters"
    " union all select 'bob', meter_id, meter_type, service_address from meters",
)
def _(spark, d):
    meters = grid(spark, d)["meters"].select("meter_id", "meter_type", "service_address")
    seen = [apply_policies(meters, "meters", POLICIES, w).select(F.lit(w.user_id).alias("user_id"), "*") for w in PRINCIPALS[:2]]
    return seen[0].unionByName(seen[1])


@query(
    "pol_sentinel_exclude",
    "select read_date, meter_id::varchar as meter_id, region, round(kwh_delivered, 4) as kwh_delivered from consumption",
)
def _(spark, d):
    from plumbline.operators.tracers import with_tracers

    product = P.consumption_daily(with_tracers(grid(spark, d, text_keys=True)))
    kept = apply_policies(product, "consumption", [], PRINCIPALS[0], tracer_key="meter_id")
    return rounded(kept.select("read_date", "meter_id", "region", "kwh_delivered"))


EXEMPT = "role in ('admin', 'data_engineer', 'ops_director')"


@query(
    "pol_decisions",
    f"select user_id, 'pol-consumption' as policy_id, 'row_filter' as kind, 'consumption' as target, not ({EXEMPT}) as applied,"
    f" case when {EXEMPT} then null when region is null then 'FALSE' else 'region = ''' || region || '''' end as predicate,"
    f" case when {EXEMPT} then 'No row filter for ' || user_id || ' (role ' || role || ' sees all regions)' when region is null then"
    " 'No rows for ' || user_id || ': no region assigned' else 'Filtered to region ' || region || ' for ' || user_id end as sentence"
    " from users union all select user_id, 'pol-address', 'column_mask', 'meters',"
    f" not ({EXEMPT}), case when {EXEMPT} then null else '''***''' end, case when {EXEMPT} then 'service_address shown unmasked to '"
    " || user_id else 'service_address masked (PII) for ' || user_id end from users",
)
def _(spark, d):
    return decisions(users(spark, d), POLICIES)


@query(
    "pol_entitlement_batch",
    f"select user_id, 'consumption' as product, true as can_read, case when {EXEMPT} then null when region is null then 'FALSE'"
    " else 'region = ''' || region || '''' end as row_filter from users",
)
def _(spark, d):
    return entitlements(users(spark, d), POLICIES)


@query("pol_pii_guard", "select meter_id, feeder_id, meter_type from meters")
def _(spark, d):
    return drop_personal(grid(spark, d)["meters"], {"service_address"}, keys=["meter_id"])[0]
