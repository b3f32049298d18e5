"""Recall of served answers after reads of the busiest feeder were restated."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import recall as R
from plumbline.plans import products as P
from plumbline.queries.base import query
from plumbline.queries.sources import RESTATED, restated
from plumbline.session import settle
from plumbline.sources.testtables import grid, served_answers, table

READS = ("consumption.kwh_delivered", "reads.kwh_delivered", "reads.read_ts")
KWH, BACK = {"kwh": "sum(kwh_delivered)"}, {"back": "sum(kwh_received)"}
DAILY = {"daily_kwh": "kwh"}
SHAPES = [
    R.Shape("total", DAILY, KWH, "last_7_days", lineage=READS),
    R.Shape("by_day", DAILY, KWH, "last_7_days", ("read_date",), READS),
    R.Shape("by_feeder", DAILY, KWH, "yesterday", ("feeder_id",), (*READS, "meters.feeder_id")),
]
#: Plans with several metrics and dimensions, and one over all time.
WIDE = [
    R.Shape("total", {"daily_kwh": "kwh", "net_share": "(kwh - back) / nullif(kwh, 0)"}, KWH | BACK, "week_before_last", lineage=READS),
    R.Shape("by_day", {"daily_kwh": "kwh", "net_share": "(kwh - back) / nullif(kwh, 0)"}, KWH | BACK, "last_7_days", ("read_date", "feeder_id"), READS),
    R.Shape("by_feeder", {"net_kwh": "kwh - back", "daily_kwh": "kwh"}, KWH | BACK, "all", ("region", "feeder_id"), READS),
]


def _cells_sql(t):
    return (
        f"select r.*, '' as key, sum(s.kwh) as v from requests r left join {t} s on s.scope = r.scope and s.read_date >= r.as_of - 7"
        " and s.read_date < r.as_of where r.shape = 'total' group by all union all"
        f" select r.*, s.read_date::varchar, sum(s.kwh) from requests r join {t} s on s.scope = r.scope and s.read_date >= r.as_of - 7"
        " and s.read_date < r.as_of where r.shape = 'by_day' group by all union all"
        f" select r.*, s.feeder_id::varchar, sum(s.kwh) from requests r join {t} s on s.scope = r.scope and s.read_date = r.as_of - 1"
        " where r.shape = 'by_feeder' group by all"
    )


FRAMES = {
    **RESTATED,
    "answers": "select question_id as cert_id, asked_by as consumer, asked_at as served_at, case when topic % 2 = 0 then 'export' else"
    " 'answer' end as kind, (array['total', 'by_day', 'by_feeder'])[topic % 3 + 1] as shape, case when role in ('admin', 'data_engineer',"
    " 'ops_director') then 'ALL' else coalesce(region, 'NONE') end as scope, topic, asked_at::date as as_of from questions"
    " join users on user_id = asked_by where outcome = 'answered'",
    "requests": "select distinct shape, scope, as_of from answers",
    "day_old": "select read_date, feeder_id, region as scope, kwh_delivered as kwh from consumption union all"
    " select read_date, feeder_id, 'ALL', kwh_delivered from consumption",
    "day_new": "select read_date, feeder_id, region as scope, kwh_delivered as kwh from daily_restated union all"
    " select read_date, feeder_id, 'ALL', kwh_delivered from daily_restated",
    "cells_old": _cells_sql("day_old"),
    "cells_new": _cells_sql("day_new"),
    "changes": "select *, abs(b - a) / greatest(abs(a), 1e-9) * 100 as pct from (select o.shape, o.scope, o.as_of, o.key, round(o.v, 4) as a,"
    " round(n.v, 4) as b from cells_old o join cells_new n on n.shape = o.shape and n.scope = o.scope and n.as_of = o.as_of"
    " and n.key = o.key) where abs(a - b) >= 1e-9",
    "worst": "select shape, scope, as_of, round(max(pct), 4) as max_pct from changes group by 1, 2, 3",
    "settings": "select c_custkey as consumer, case c_mktsegment when 'BUILDING' then 5.0 else 0.0 end as materiality_pct from customer"
    " where c_mktsegment in ('BUILDING', 'MACHINERY')",
    "due": "select a.*, w.max_pct, s.materiality_pct from answers a join worst w on w.shape = a.shape and w.scope = a.scope and"
    " w.as_of = a.as_of left join settings s on s.consumer = a.consumer where w.max_pct > coalesce(s.materiality_pct, 1.0)",
    "sent": "select * from due where topic % 7 <> 0",
}


def _both(asked, src, shapes=SHAPES):
    """Results before and after the restatement. They are read several times, so they are stored."""
    asked = settle(asked, "requests")
    products = [settle(P.consumption_daily(s), "consumption") for s in (src, restated(src))]
    return [settle(R.cells(asked, p, shapes, "read_date", "region"), "cells") for p in products]


def frames(spark, d):
    src = grid(spark, d)
    answers = served_answers(spark, d)
    asked = R.requests(answers)
    old, new = _both(asked, src)
    return answers, old, new, materiality(spark, d)


def materiality(spark, d):
    return (
        table(spark, d, "customer")
        .where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
        .select(F.col("c_custkey").alias("consumer"), F.when(F.col("c_mktsegment") == "BUILDING", 5.0).otherwise(0.0).alias("materiality_pct"))
    )


def sent_notices(answers, old, new, settings):
    """Answers on every seventh topic already have a notice for the new result."""
    past = R.notices(answers.where("topic % 7 = 0"), old, new, settings).select("cert_id", "new_hash")
    return R.notices(answers, old, new, settings, past)


@query("rec_affected", "select cert_id, consumer from answers where shape = 'by_feeder'", extra=FRAMES)
def _(spark, d):
    return R.affected(served_answers(spark, d), SHAPES, "meters").select("cert_id", "consumer")


@query(
    "rec_reexecute",
    "select a.cert_id, c.key, 'daily_kwh' as metric, round(c.v, 4) as value from answers a join cells_new c on c.shape = a.shape and"
    " c.scope = a.scope and c.as_of = a.as_of",
    extra=FRAMES,
)
def _(spark, d):
    answers, _, new, _ = frames(spark, d)
    own = answers.select("cert_id", "shape", "scope", F.to_date("served_at").alias("as_of"))
    return own.join(new, R.REQUEST).select("cert_id", "key", "metric", F.round("value", 4).alias("value"))


@query(
    "rec_diff",
    "select shape, scope, as_of, key, 'daily_kwh' as metric, 'changed' as change, a as old, b as new, round(pct, 4) as pct from changes",
    extra=FRAMES,
)
def _(spark, d):
    _, old, new, _ = frames(spark, d)
    return R.diff(old, new, R.REQUEST).withColumn("pct", F.round("pct", 4))


def _wide_sql(t):
    whole, some = ("left join", "'' as key"), ("join", "s.read_date || '|' || s.feeder_id")
    parts = "sum(s.kwh_delivered) as kwh, sum(s.kwh_received) as back"
    scoped = f"(select *, region as scope from {t} union all select *, 'ALL' from {t}) s on s.scope = r.scope"
    days = "and s.read_date < r.as_of - {} and s.read_date >= r.as_of - {}"
    return (
        "select shape, scope, as_of, key, m.metric, m.value from ("
        f"select r.*, {whole[1]}, {parts} from requests r {whole[0]} {scoped} {days.format(7, 14)} where shape = 'total' group by all union all"
        f" select r.*, {some[1]}, {parts} from requests r {some[0]} {scoped} {days.format(0, 7)} where shape = 'by_day' group by all union all"
        f" select r.*, s.region || '|' || s.feeder_id, {parts} from requests r join {scoped} where shape = 'by_feeder' group by all) c,"
        " lateral (select unnest(case when shape = 'by_feeder' then ['net_kwh', 'daily_kwh'] else ['daily_kwh', 'net_share'] end) as metric,"
        " unnest(case when shape = 'by_feeder' then [kwh - back, kwh] else [kwh, (kwh - back) / nullif(kwh, 0)] end) as value) m"
    )


WIDE_FRAMES = {**FRAMES, "wide_old": _wide_sql("consumption"), "wide_new": _wide_sql("daily_restated")}


def _wide(spark, d):
    src, answers = grid(spark, d), served_answers(spark, d)
    return answers, *_both(R.requests(answers), src, WIDE)


@query(
    "rec_reexecute_wide",
    "select a.cert_id, w.key, w.metric, round(w.value, 4) as value from answers a join wide_new w on w.shape = a.shape and w.scope = a.scope"
    " and w.as_of = a.as_of",
    extra=WIDE_FRAMES,
)
def _(spark, d):
    """Answers to plans of two metrics and up to two dimensions, executed again on the restated reads."""
    answers, _, new = _wide(spark, d)
    own = answers.select("cert_id", "shape", "scope", F.to_date("served_at").alias("as_of"))
    return own.join(new, R.REQUEST).select("cert_id", "key", "metric", F.round("value", 4).alias("value"))


@query(
    "rec_diff_wide",
    "select shape, scope, as_of, key, metric, 'changed' as change, a as old, b as new, round(case when a is null or b is null then 100.0 else"
    " abs(b - a) / greatest(abs(a), 1e-9) * 100 end, 4) as pct from (select o.shape, o.scope, o.as_of, o.key, o.metric, round(o.value, 4) as a,"
    " round(n.value, 4) as b from wide_old o join wide_new n using (shape, scope, as_of, key, metric)) where a is distinct from b and"
    " (a is null or b is null or abs(a - b) >= 1e-9)",
    extra=WIDE_FRAMES,
)
def _(spark, d):
    _, old, new = _wide(spark, d)
    return R.diff(old, new, R.REQUEST).withColumn("pct", F.round("pct", 4))


@query("rec_notices", "select cert_id, consumer, max_pct from sent", extra=FRAMES)
def _(spark, d):
    return sent_notices(*frames(spark, d)).select("cert_id", "consumer", "max_pct")


WITH_TOTALS = {
    "requests": "select distinct shape, scope, as_of from answers union select 'total', scope, as_of from answers where shape = 'by_day'"
}


@query(
    "rec_sentences",
    "select a.cert_id, 1 as sentence_no, w.max_pct from answers a join worst w on w.shape = a.shape and w.scope = a.scope and"
    " w.as_of = a.as_of left join settings s on s.consumer = a.consumer where w.max_pct > coalesce(s.materiality_pct, 1.0) union all"
    " select a.cert_id, 2, 100.0::double from answers a join worst w on w.shape = 'total' and w.scope = a.scope and w.as_of = a.as_of"
    " where a.shape = 'by_day'",
    extra={**FRAMES, **WITH_TOTALS},
)
def _(spark, d):
    """Every answer has a sentence on its own rows; daily answers have a second one on their total."""
    answers, settings, src = served_answers(spark, d), materiality(spark, d), grid(spark, d)
    named = answers.select("cert_id", "consumer", "shape", "scope", F.to_date("served_at").alias("as_of"))
    first = named.withColumns({"sentence_no": F.lit(1), "query_ref": F.lit("main")})
    second = named.where("shape = 'by_day'").withColumns({"shape": F.lit("total"), "sentence_no": F.lit(2), "query_ref": F.lit("total")})
    bindings = first.unionByName(second)
    old, new = _both(bindings.select(*R.REQUEST).distinct(), src)
    return R.restated_sentences(bindings, old, new, settings)


@query(
    "rec_message",
    "select s.cert_id, s.consumer, 'daily kwh' || case when t.key <> '' then ' for ' || t.key else '' end || ' (' || case when s.kind ="
    " 'export' then 'exported' else 'answered' end || ' ' || day(s.served_at) || ' ' || strftime(s.served_at, '%b') || ') changed from ' ||"
    " format('{:,.1f}', t.a) || ' to ' || format('{:,.1f}', t.b) || ' kWh. Reason: reads restated.' as message from sent s join"
    " (select *, row_number() over (partition by shape, scope, as_of order by pct desc, key) as rn from changes) t"
    " on t.shape = s.shape and t.scope = s.scope and t.as_of = s.as_of and t.rn = 1",
    extra=FRAMES,
)
def _(spark, d):
    answers, old, new, settings = frames(spark, d)
    sent = sent_notices(answers, old, new, settings)
    return R.messages(answers, sent, R.diff(old, new, R.REQUEST), "reads restated", " kWh")


@query(
    "rec_inbox",
    "select consumer, count(*) as notices, count(*) filter (where topic % 3 <> 0) as open from sent group by 1",
    extra=FRAMES,
)
def _(spark, d):
    """Notices on every third topic have been acknowledged."""
    answers, old, new, settings = frames(spark, d)
    sent = sent_notices(answers, old, new, settings).join(answers.select("cert_id", "topic", "served_at"), "cert_id")
    return R.inbox(sent.withColumn("acknowledged_at", F.when(F.col("topic") % 3 == 0, F.col("served_at"))))


@query(
    "rec_exports",
    "select a.cert_id, a.consumer, a.served_at, count(s.cert_id) as restated from answers a left join sent s on s.cert_id = a.cert_id"
    " where a.kind = 'export' group by 1, 2, 3",
    extra=FRAMES,
)
def _(spark, d):
    answers, old, new, settings = frames(spark, d)
    return R.exports(answers, sent_notices(answers, old, new, settings))
