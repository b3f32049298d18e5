"""Scans, loads, versioned tables and feed mappings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from plumbline.plans import products as P
from plumbline.queries.base import query
from plumbline.queries.products import rounded
from plumbline.session import scratch_path
from plumbline.sources import tables as S
from plumbline.sources.testtables import grid, table

START, END = datetime(2024, 1, 10), datetime(2024, 1, 20)
AS_OF = datetime(2024, 1, 25)

BUSIEST = "(select feeder_id from served order by customers_served desc, feeder_id limit 1)"
HIT = (
    f"r.meter_id in (select meter_id from meters where feeder_id = {BUSIEST})"
    " and r.read_ts >= timestamp '2024-01-10' and r.read_ts < timestamp '2024-01-20'"
)
RESTATED = {
    "restated": f"select r.meter_id, r.read_ts, case when {HIT} then 0.0 else r.kwh_delivered end as kwh_delivered,"
    f" case when {HIT} then 0.0 else r.kwh_received end as kwh_received from reads r",
    "daily_restated": "select r.read_ts::date as read_date, r.meter_id, m.feeder_id, f.region, sum(r.kwh_delivered) as kwh_delivered,"
    " sum(r.kwh_received) as kwh_received, count(*) as read_count from restated r join meters m on r.meter_id = m.meter_id"
    " join feeders f on f.feeder_id = m.feeder_id group by 1, 2, 3, 4",
}
DAILY_SQL = (
    "select read_date, meter_id, feeder_id, region, round(kwh_delivered, 4) as kwh_delivered,"
    " round(kwh_received, 4) as kwh_received, read_count from "
)


def busiest_feeder(src):
    order = F.struct((-F.col("customers_served")).alias("n"), "feeder_id")
    return P.customers_served(src).agg(F.min_by("feeder_id", order)).first()[0]


def restated(src):
    reads = S.restate(src["reads"], src["meters"], busiest_feeder(src), START, END, ["kwh_delivered", "kwh_received"])
    return {**src, "reads": reads}


@query(
    "src_scan",
    "select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders where o_totalprice > 100000 group by 1",
)
def _(spark, d):
    return S.query(
        spark,
        "select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from {orders} where o_totalprice > :floor group by 1",
        {"floor": 100000.0},
        orders=S.scan(spark, f"{d}/orders.parquet", ["o_orderstatus", "o_totalprice"]),
    )


@query("src_load", "select o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1")
def _(spark, d):
    orders, path = table(spark, d, "orders"), scratch_path(spark, "load")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    S.append(orders.where(urgent), path)
    S.append(orders.where(~urgent), path, like=orders.schema)
    back = spark.read.schema(orders.schema).parquet(path)
    return back.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


DESCRIBED = ["orders", "lineitem", "events", "customer", "part"]


@query(
    "src_schema",
    "select c.table_name, (c.ordinal_position - 1)::int as position, c.column_name, case when c.data_type = 'VARCHAR' then 'varchar'"
    " when c.data_type in ('BIGINT', 'INTEGER') then 'integer' when c.data_type = 'DOUBLE' then 'double' else 'timestamp' end"
    " as family, n.n_rows from (select table_name, column_name, data_type, (select count(*) from information_schema.columns b"
    " where b.table_name = a.table_name and b.ordinal_position < a.ordinal_position) + 1 as ordinal_position"
    " from information_schema.columns a) c join ("
    + " union all ".join(f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in DESCRIBED)
    + ") n on n.table_name = c.table_name",
)
def _(spark, d):
    out = None
    for t in DESCRIBED:
        df = table(spark, d, t)
        cols = [(n, i, c, f) for n, i, c, f, _ in S.describe(t, df)]
        items = F.array(
            *[F.struct(F.lit(n).alias("table_name"), F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.lit(f).alias("family"))
              for n, i, c, f in cols]
        )
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.inline(items), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("snk_materialize", DAILY_SQL + "consumption")
def _(spark, d):
    path = scratch_path(spark, "daily")
    P.consumption_daily(grid(spark, d)).write.partitionBy("read_date").parquet(path)
    return rounded(spark.read.parquet(path).withColumn("read_date", F.col("read_date").cast("date")))


def _two_versions(spark, d):
    src, t = grid(spark, d), S.VersionedTable(spark, scratch_path(spark, "published"))
    t.swap_in(P.consumption_daily(src), 1)
    t.swap_in(P.consumption_daily(restated(src)), 2)
    return t


@query("snk_swap", DAILY_SQL + "daily_restated", extra=RESTATED)
def _(spark, d):
    return rounded(_two_versions(spark, d).read())


@query("snk_archive", DAILY_SQL + "consumption")
def _(spark, d):
    return rounded(_two_versions(spark, d).read(version=1))


@query(
    "snk_clone_window",
    "select meter_id, read_ts, round(kwh_delivered, 4) as kwh_delivered, round(kwh_received, 4) as kwh_received from reads"
    " where read_ts >= timestamp '2024-01-10' and read_ts < timestamp '2024-01-20'",
)
def _(spark, d):
    return rounded(S.clone_window(grid(spark, d)["reads"], "read_ts", START, END))


LKG = {"lkg": "select * from reads where read_ts >= timestamp '2024-01-18' and read_ts < timestamp '2024-01-25'"}


@query(
    "snk_lkg",
    "select meter_id, read_ts, round(kwh_delivered, 4) as kwh_delivered, round(kwh_received, 4) as kwh_received,"
    " read_ts::date as snapshot_date from lkg",
    extra=LKG,
)
def _(spark, d):
    kept = S.last_known_good(grid(spark, d)["reads"], "read_ts", AS_OF)
    t = S.VersionedTable(spark, scratch_path(spark, "lkg"))
    t.write(kept, 1, partition_by=["snapshot_date"])
    back = spark.read.parquet(f"{t.path}/v=1").withColumn("snapshot_date", F.col("snapshot_date").cast("date"))
    return rounded(back)


@query(
    "src_rebind",
    "select r.read_ts::date as read_date, r.meter_id, m.feeder_id, f.region, round(sum(r.kwh_delivered), 4) as kwh_delivered,"
    " round(sum(r.kwh_received), 4) as kwh_received, count(*) as read_count from lkg r join meters m on r.meter_id = m.meter_id"
    " join feeders f on f.feeder_id = m.feeder_id group by 1, 2, 3, 4",
    extra=LKG,
)
def _(spark, d):
    src = grid(spark, d)
    kept = S.last_known_good(src["reads"], "read_ts", AS_OF).drop("snapshot_date")
    return rounded(P.consumption_daily({**src, "reads": kept}))


@query(
    "src_mapping",
    "select user_id as meter_id, ts as read_ts, value as kwh_delivered, case when event_type = 'error' then 'EST' else 'ACT' end"
    " as quality_flag from events",
)
def _(spark, d):
    flag = F.when(F.col("event_type") == "error", "EST").otherwise("ACT")
    return S.map_feed(
        table(spark, d, "events"), {"meter_id": "user_id", "read_ts": "ts", "kwh_delivered": "value", "quality_flag": flag}
    )


@query(
    "snk_restate",
    "select meter_id, read_ts, round(kwh_delivered, 4) as kwh_delivered, round(kwh_received, 4) as kwh_received from restated",
    extra=RESTATED,
)
def _(spark, d):
    return rounded(restated(grid(spark, d))["reads"])


@query(
    "snk_rename_retype",
    "select meter_id, count(*) as n, round(sum(energy_kwh_del::double), 4) as energy from"
    " (select meter_id, read_ts, kwh_delivered::varchar as energy_kwh_del from reads) group by 1",
)
def _(spark, d):
    feed = S.rename_retype(grid(spark, d)["reads"], "kwh_delivered", "energy_kwh_del", "string")
    return feed.groupBy("meter_id").agg(
        F.count("energy_kwh_del").alias("n"), F.round(F.sum(F.col("energy_kwh_del").cast("double")), 4).alias("energy")
    )
