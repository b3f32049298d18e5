"""Data products over the adapter frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators.intervals import expand_slots
from plumbline.plans import products as P
from plumbline.plans.policy import Policy, Principal, apply_policies
from plumbline.queries.base import CTE, query
from plumbline.session import settle
from plumbline.sources.testtables import RESTORE_SHARE, grid

DAY = "day"


def rounded(df, places=4):
    """Parallel sums differ in the last bits, so fractional outputs are compared at a fixed precision."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def stored_grid(spark, d):
    """The sources with what derives from events written once: reliability reads outages and reads in several places."""
    return grid(spark, d, keep=settle)


def reliability_by_day(spark, d):
    return P.reliability(stored_grid(spark, d), DAY, RESTORE_SHARE)


REL_ROUNDED = (
    "select {p} as {g}, feeder_id, substation_id, region, customers_served, outage_count, outage_count_over_4h,"
    " customer_interruptions, customer_minutes_interrupted, round(saidi, 4) as saidi, round(saifi, 4) as saifi,"
    " round(caidi, 4) as caidi from {t}"
)


@query(
    "prod_consumption_daily",
    "select read_date, meter_id, feeder_id, region, round(kwh_delivered, 4) as kwh_delivered,"
    " round(kwh_received, 4) as kwh_received, read_count from consumption",
)
def _(spark, d):
    return rounded(P.consumption_daily(grid(spark, d)))


@query("rel_customers_served", "select feeder_id, customers_served from served")
def _(spark, d):
    return P.customers_served(grid(spark, d))


@query("rel_month_spine", "select distinct date_trunc('month', start_ts)::date as month from outages")
def _(spark, d):
    return P.period_spine(grid(spark, d), "month")


@query("rel_interval_status", "select outage_id, read_ts, meters_on from interval_status")
def _(spark, d):
    return P.interval_status(grid(spark, d))


@query("rel_verified_restoration", "select outage_id, feeder_id, start_ts, customers_affected, cause_code, restored_ts from verified")
def _(spark, d):
    return P.verified_restoration(grid(spark, d), RESTORE_SHARE)


@query(
    "rel_outage_agg",
    "select feeder_id, day, outage_count, outage_count_over_4h, customer_interruptions, customer_minutes_interrupted from totals",
)
def _(spark, d):
    return P.outage_totals(grid(spark, d), DAY, RESTORE_SHARE)


@query("prod_reliability", REL_ROUNDED.format(p="day", g="day", t="reliability"))
def _(spark, d):
    return rounded(reliability_by_day(spark, d))


MONTHLY = {
    "totals": CTE["totals"].replace("start_ts::date as day", "date_trunc('month', start_ts)::date as day"),
    "days": CTE["days"].replace("start_ts::date as day", "date_trunc('month', start_ts)::date as day"),
}


@query("prod_reliability_month", REL_ROUNDED.format(p="day", g="month", t="reliability"), extra=MONTHLY)
def _(spark, d):
    return rounded(P.reliability(stored_grid(spark, d), "month", RESTORE_SHARE))


CAUSES = {
    "causes": "select feeder_id, day, cause_code as dominant_cause from (select feeder_id, start_ts::date as day, cause_code,"
    " row_number() over (partition by feeder_id, start_ts::date order by count(*) desc, cause_code) as rn"
    " from verified group by 1, 2, 3) where rn = 1"
}


@query(
    "prod_reliability_v2",
    "select r.day, r.feeder_id, r.substation_id, r.region, r.customers_served, r.outage_count, r.outage_count_over_4h,"
    " r.customer_interruptions, r.customer_minutes_interrupted, round(r.saidi, 4) as saidi_minutes, round(r.saifi, 4) as saifi,"
    " round(r.caidi, 4) as caidi, case c.dominant_cause when 'WEATHER' then 'environmental' when 'EQUIPMENT' then 'equipment'"
    " when 'PLANNED' then 'planned' end as cause_category from reliability r left join causes c"
    " on c.feeder_id = r.feeder_id and c.day = r.day",
    extra=CAUSES,
)
def _(spark, d):
    return rounded(P.reliability_v2(stored_grid(spark, d), DAY, RESTORE_SHARE))


@query(
    "prod_exposure",
    "select meter_id, outage_id, feeder_id, region, start_ts as outage_start_ts, end_ts as outage_end_ts, ifnull(n, 0)::int as"
    " reads_in_window, round(ifnull(kwh, 0), 4) as kwh_in_window, ifnull(kwh, 0) = 0 as zero_usage_flag from outages join feeders using"
    " (feeder_id) join meters using (feeder_id) left join (select r.meter_id, x.outage_id, count(*) as n, sum(r.kwh_delivered) as kwh from"
    " reads r join meters using (meter_id) join outages x using (feeder_id) where r.read_ts >= x.start_ts and r.read_ts < x.end_ts group by"
    " all) using (meter_id, outage_id)",
)
def _(spark, d):
    src = stored_grid(spark, d)
    return P.exposure(src, sets=settle(P.outage_sets(src), "outage-sets"), places=4)


@query(
    "prod_dashboard",
    "select region, substation_id, round(sum(customer_minutes_interrupted) / nullif(sum(customers_served), 0), 4) as saidi_mtd,"
    " round(max(saidi), 4) as worst_feeder_saidi, sum(outage_count)::bigint as outages from reliability"
    " where day = date '2024-01-01' group by 1, 2 order by 1, 2",
    extra=MONTHLY,
)
def _(spark, d):
    return rounded(P.dashboard(P.reliability(stored_grid(spark, d), "month", RESTORE_SHARE), "2024-01-01"))


@query(
    "prod_interval_slots",
    "select outage_id, feeder_id, unnest(range(ceil(date_diff('second', timestamp '2024-01-01', start_ts) / 3600.0)::bigint,"
    " ceil(date_diff('second', timestamp '2024-01-01', end_ts) / 3600.0)::bigint)) as slot from outages",
)
def _(spark, d):
    outages = grid(spark, d)["outages"]
    return expand_slots(outages, "start_ts", "end_ts", "2024-01-01", 3600).select("outage_id", "feeder_id", "slot")


REGION_FILTER = Policy("pol-consumption", "consumption", "row_filter", "region = :user.region", attribute="region")


@query(
    "prod_preview",
    "select read_date, meter_id, feeder_id, region, round(kwh_delivered, 4) as kwh_delivered from consumption"
    " where region = 'ASIA' order by read_date, meter_id limit 50",
)
def _(spark, d):
    rows = apply_policies(P.consumption_daily(grid(spark, d)), "consumption", [REGION_FILTER], Principal("u1", "analyst", "ASIA"))
    return rounded(rows.orderBy("read_date", "meter_id").limit(50).drop("kwh_received", "read_count"))
