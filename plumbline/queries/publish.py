"""A product's life: first release, a refused one, a restatement, and the answers that it recalls."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from plumbline.operators import publish
from plumbline.plans import contracts as C
from plumbline.plans import products as P
from plumbline.queries.base import query
from plumbline.queries.recall import FRAMES, SHAPES, materiality
from plumbline.queries.sources import restated
from plumbline.session import scratch_path
from plumbline.sources.tables import VersionedTable
from plumbline.sources.testtables import grid, served_answers

CONSUMPTION = replace(
    C.CONSUMPTION,
    columns=C.columns("read_date date", "meter_id integer", "feeder_id integer", "region varchar", "kwh_delivered double", "kwh_received double", "read_count integer"),
)
STEPS = {
    "step_first": "select 1 as step, 1 as version, true as published, 'published' as reason, (select count(*) from consumption) as visible_rows,"
    " (select round(sum(kwh_delivered), 2) from consumption) as visible_kwh, 0::bigint as notices",
    "step_refused": "select 2, 2, false, 'failing tests: expect.kwh_non_negative', (select count(*) from consumption),"
    " (select round(sum(kwh_delivered), 2) from consumption), 0::bigint from (select count(*) as n from consumption where kwh_delivered > 0) where n > 0",
    "step_old_number": "select 3, 1, false, 'version taken', (select count(*) from consumption), (select round(sum(kwh_delivered), 2) from consumption), 0::bigint",
    "step_restated": "select 4, 3, true, 'published', (select count(*) from daily_restated), (select round(sum(kwh_delivered), 2) from daily_restated),"
    " (select count(*) from due)",
}


@query(
    "flow_publish_recall",
    "select * from step_first union all select * from step_refused union all select * from step_old_number union all select * from step_restated",
    extra={**FRAMES, **STEPS},
)
def _(spark, d):
    """Release consumption; refuse one with negative energy; refuse a number that is taken; restate, publish and send notices."""
    src = grid(spark, d)
    table = VersionedTable(spark, scratch_path(spark, "released"))
    first, after = P.consumption_daily(src), P.consumption_daily(restated(src))
    wrong = first.withColumn("kwh_delivered", -F.col("kwh_delivered"))
    parents, rows = {"meters": src["meters"]}, []
    for step, (version, df) in enumerate(((1, first), (2, wrong), (1, after), (3, after)), 1):
        try:
            done = publish.release(table, df, CONSUMPTION, version, parents)
        except publish.VersionTaken:
            done = publish.Release(version, False, "version taken")
        sent = publish.recall(table, done, served_answers(spark, d), SHAPES, materiality(spark, d), "read_date", "region")
        seen = table.read().agg(F.count(F.lit(1)), F.round(F.sum("kwh_delivered"), 2)).first()
        rows.append((step, version, done.published, done.reason, seen[0], seen[1], 0 if sent is None else sent.count()))
    return spark.createDataFrame(
        rows, "step int, version int, published boolean, reason string, visible_rows bigint, visible_kwh double, notices bigint"
    )
