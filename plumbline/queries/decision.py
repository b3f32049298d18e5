"""Thresholds on the reliability product."""

from __future__ import annotations

import re
from datetime import date
from functools import reduce

from pyspark.sql import functions as F

from plumbline.operators import decision as N
from plumbline.queries.base import query
from plumbline.queries.products import reliability_by_day
from plumbline.queries.semantic import RETRIEVAL, part_questions
from plumbline.session import settle
from plumbline.sources.testtables import grid, questions, users

AS_OF = date(2024, 1, 31)
SAIDI = N.Threshold("saidi", ">", 30000.0, "outage_count_over_4h")
OUT = N.Threshold("customers_interrupted", ">=", 5000.0, "customers_affected")

TOTALS = {
    "scopes": "select {scope}::varchar as scope_value, sum(customer_minutes_interrupted) as minutes, sum(customer_interruptions)::bigint as"
    " interruptions, sum(customers_served)::bigint as served, avg(customers_served) as avg_served, count(distinct day) as periods,"
    " bool_or(day = date '2024-01-01') as has_first from reliability where day >= date '2024-01-01' and day < date '2024-02-01' group by 1"
}
REGIONS = {"scopes": TOTALS["scopes"].format(scope="region")}
FEEDERS = {"scopes": TOTALS["scopes"].format(scope="feeder_id")}
NOW = "minutes / nullif(served / periods, 0)"
WITH_ROW = "(minutes + avg_served * 241 * {d}) / nullif(served / (periods + case when has_first then 0 else 1 end), 0)"


def totals(spark, d, scope):
    return N.scope_totals(reliability_by_day(spark, d), scope, AS_OF, "day")


CURRENT_SQL = (
    f"select scope_value, 'saidi' as metric, '>' as comparator, 30000.0::double as threshold, round({NOW}, 4) as current,"
    f" round(30000 - {NOW}, 4) as margin, {NOW} > 30000 as breached from scopes union all select scope_value, 'customers_interrupted',"
    " '>=', 5000.0, interruptions, 5000 - interruptions, interruptions >= 5000 from scopes"
)


@query("dec_current", CURRENT_SQL, extra=FEEDERS)
def _(spark, d):
    return N.current(totals(spark, d, "feeder_id"), [SAIDI, OUT])


@query("dec_counterfactual", f"select scope_value, round({WITH_ROW.format(d=3)}, 4) as value from scopes", extra=REGIONS)
def _(spark, d):
    df = N.counterfactual(totals(spark, d, "region"), SAIDI, "outage_count_over_4h", 3)
    return df.withColumn("value", F.round("value", 4))


# solved, not searched: minutes + avg_served * 241 * n > 30000 * served / periods
NEED = "30000 * served / (periods + case when has_first then 0 else 1 end) - minutes"


@query(
    "dec_sensitivity",
    f"select 'saidi' as metric, scope_value, case when served > 0 and {NEED} < 0 then 0 when served > 0 and avg_served > 0"
    f" then floor(({NEED}) / (avg_served * 241))::bigint + 1 end::bigint as flip_delta from scopes union all select"
    " 'customers_interrupted', scope_value, greatest(0, 5000 - interruptions)::bigint from scopes",
    extra=REGIONS,
)
def _(spark, d):
    scopes = settle(totals(spark, d, "region"), "totals")
    rows = [N.sensitivity(scopes, t).withColumn("metric", F.lit(t.metric)) for t in (SAIDI, OUT)]
    return reduce(lambda a, b: a.unionByName(b), rows)


@query(
    "dec_margin_summary",
    "select metric, comparator, threshold, scope_value, round(current, 2) as current, round(margin, 2) as margin, breached from (select *,"
    f" row_number() over (partition by metric order by margin, scope_value) as rn from ({CURRENT_SQL})) where rn = 1",
    extra=FEEDERS,
)
def _(spark, d):
    return N.tightest(N.current(totals(spark, d, "feeder_id"), [SAIDI, OUT]))


@query(
    "dec_scope",
    "select q.question_id, coalesce(case when topic < 10 then 'EUROPE' end, s.region, f.region, u.region) as region from questions q left"
    " join users u on u.user_id = q.asked_by left join feeders s on s.substation_id = case when topic >= 10 and topic < 35 then"
    " 'NATION_' || (topic - 10) end left join feeders f on f.feeder_id = case when topic >= 35 and topic < 60 then topic - 35 end",
)
def _(spark, d):
    t = F.col("topic")
    asked = questions(spark, d).select(
        "question_id",
        F.col("asked_by").alias("user_id"),
        F.when(t < 10, "EUROPE").alias("region_hint"),
        F.when((t >= 10) & (t < 35), F.concat(F.lit("NATION_"), t - 10)).alias("substation_hint"),
        F.when((t >= 35) & (t < 60), t - 35).alias("feeder_hint"),
    )
    who = users(spark, d).select("user_id", F.col("region").alias("user_region"))
    return N.resolve_scope(asked.join(who, "user_id", "left"), grid(spark, d)["feeders"])


# Question examples of two decision packs over the part catalogue.
EXAMPLES = [("restock", "e1", "hot ring economy order"), ("restock", "e2", "old bolt standard"), ("retire", "e3", "cold gear promo")]
CUES = ["hot", "cold", "old"]


def _match_sql():
    out = []
    for pack in ("restock", "retire"):
        docs = [(e, t) for p, e, t in EXAMPLES if p == pack]
        out.append(
            f"select question_id, '{pack}' as decision, round(similarity, 4) as similarity from (select question_id, max(similarity) as"
            f" similarity from cosines_{pack} group by 1) where similarity >= 0.15"
        )
        assert docs
    return " union all ".join(out)


def _match_frames():
    cued = "where " + " or ".join(f"text like '%{c}%'" for c in CUES)
    frames = {"q0": RETRIEVAL["q"], "q": f"select * from q0 {cued}"}
    for pack in ("restock", "retire"):
        docs = ", ".join(f"('{e}', '{t}')" for p, e, t in EXAMPLES if p == pack)
        names = ["texts", "toks", "terms", "dfs", "nd", "dt", "dn", "qt", "qn", "sims", "cosines"]
        base = {**{n: RETRIEVAL[n] for n in names}, "nd": "select count(*)::double as n from el"}
        base["texts"] = "select 'q' as src, text as id, text from (select distinct text from q) union all select 'd', element_id, text from el"
        base["el"] = f"select * from (values {docs}) v(element_id, text)"
        for n, sql in base.items():
            sql = re.sub(r"\b(from|join) (" + "|".join([*names, "el"]) + r")\b", rf"\1 \2_{pack}", sql)
            frames[f"{n}_{pack}"] = re.sub(r"\b(dfs|dn|qn)\.", rf"\1_{pack}.", sql)
    return frames


@query("dec_match", _match_sql(), extra=_match_frames())
def _(spark, d):
    examples = spark.createDataFrame(EXAMPLES, "decision string, example_id string, text string")
    return N.match(part_questions(spark, d), examples, CUES)
