"""Query registry and the DuckDB text of the adapter frames."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}

# The adapter frames of `plumbline.sources.testtables` as DuckDB common table expressions.
CTE = {
    "feeders": "select n_nationkey as feeder_id, n_name as substation_id, r_name as region"
    " from nation join region on n_regionkey = r_regionkey",
    "meters": "select c_custkey as meter_id, c_nationkey as feeder_id, c_mktsegment as meter_type,"
    " c_name as service_address from customer where c_custkey in (select user_id from events)",
    "served": "select feeder_id, count(*) as customers_served from meters group by feeder_id",
    "outages": "select e.event_id as outage_id, m.feeder_id, e.ts as start_ts, e.ts + interval 6 hour as end_ts,"
    " case when e.value < 20 then 'WEATHER' when e.value < 60 then 'EQUIPMENT' else 'PLANNED' end as cause_code,"
    " k.customers_served as customers_affected from events e join meters m on m.meter_id = e.user_id"
    " join served k on k.feeder_id = m.feeder_id where e.event_type = 'error'",
    "reads": "select user_id as meter_id, date_trunc('hour', ts)::timestamp as read_ts,"
    " sum(case when event_type = 'view' then 0.0::double else value end) as kwh_delivered,"
    " sum(case when event_type = 'signup' then value else 0.0::double end) as kwh_received"
    " from events where event_type <> 'error' group by 1, 2",
    "consumption": "select read_ts::date as read_date, meter_id, any_value(feeder_id) as feeder_id, any_value(region) as region,"
    " sum(kwh_delivered) as kwh_delivered, sum(kwh_received) as kwh_received, count(*) as read_count"
    " from reads join meters using (meter_id) join feeders using (feeder_id) group by 1, 2",
    "interval_status": "select o.outage_id, r.read_ts, sum((r.kwh_delivered > 0)::int)::bigint as meters_on from reads r"
    " join meters m using (meter_id) join outages o on o.feeder_id = m.feeder_id where o.start_ts <= r.read_ts and r.read_ts < o.end_ts group by all",
    # brute force: among the outage's own read times, the earliest with enough meters on (least() skips nulls)
    "verified": "select o.outage_id, o.feeder_id, o.start_ts, o.customers_affected, o.cause_code, least(o.end_ts, (select min(s.read_ts)"
    " from interval_status s where s.outage_id = o.outage_id and s.meters_on >= 0.1 * o.customers_affected)) as restored_ts from outages o",
    "totals": "select feeder_id, start_ts::date as day, count(*) as outage_count, sum((mins > 240)::int)::bigint as outage_count_over_4h,"
    " sum(customers_affected)::bigint as customer_interruptions, sum(mins * customers_affected)::bigint as customer_minutes_interrupted"
    " from (select *, date_diff('minute', start_ts, restored_ts) as mins from verified) group by all",
    "days": "select distinct start_ts::date as day from outages",
    "reliability": "select *, customer_minutes_interrupted / customers_served as saidi, customer_interruptions / customers_served as saifi,"
    " case when outage_count > 0 then customer_minutes_interrupted / customer_interruptions end as caidi from (select d.day, f.feeder_id,"
    " f.substation_id, f.region, k.customers_served, ifnull(t.outage_count, 0) as outage_count, ifnull(t.outage_count_over_4h, 0) as"
    " outage_count_over_4h, ifnull(t.customer_interruptions, 0) as customer_interruptions,"
    " ifnull(t.customer_minutes_interrupted, 0)::double as customer_minutes_interrupted from (feeders f join served k using (feeder_id))"
    " cross join days d left join totals t on t.day = d.day and t.feeder_id = f.feeder_id)",
    "users": "select c_custkey as user_id, case c_mktsegment when 'AUTOMOBILE' then 'ops_manager' when 'BUILDING' then 'analyst'"
    " when 'FURNITURE' then 'data_engineer' when 'HOUSEHOLD' then 'ops_director' when 'MACHINERY' then 'admin' end as role,"
    " case when c_acctbal >= 0 then f.region end as region from customer left join feeders f on f.feeder_id = c_nationkey",
    "questions": "select event_id as question_id, user_id as asked_by, ts as asked_at, case event_type when 'view' then 'answered'"
    " when 'purchase' then 'answered' when 'click' then 'missing_data' when 'error' then 'abandoned' else 'low_confidence' end"
    " as outcome, k as topic, case when k % 4 = 0 then k end as intent_id,"
    " case when k % 5 = 0 then 'product_' || k end as resolved_by_product,"
    " case when k % 5 = 0 then ts + to_hours(k) end as resolved_at"
    " from (select *, json_extract_string(props, '$.k')::int as k from events)",
    "spoken": "select conv_id * 1000 + turn as question_id, text from conversations where role = 'user'",
    "ledger": "select artifact_id, artifact_kind, target_fqn, sha256(case when turn = 1 and conv_id % 11 = 0 then text || '!'"
    " else text end) as content_sha256, agent, approved_by, created_at, case when turn = 0 then null"
    " when turn = 2 and conv_id % 13 = 0 then artifact_id + 500 when turn = 2 and conv_id % 17 = 0 then artifact_id - 1001"
    " when turn = 2 and conv_id % 19 = 0 then artifact_id - 2 when turn = 2 and conv_id % 23 = 0 then null"
    " else artifact_id - 1 end as prev_artifact_id, text as content from (select *, conv_id * 1000 + turn as artifact_id,"
    " case when conv_id % 3 = 0 then 'patch' else 'model_sql' end as artifact_kind, 'product_' || conv_id as target_fqn,"
    " case when role = 'assistant' then 'builder' else 'human:' || role end as agent,"
    " case when conv_id % 4 = 0 then null when conv_id % 4 = 1 then 'auto-gate' else 'reviewer' end as approved_by,"
    " timestamp '2024-01-01' + to_minutes(conv_id * 1000 + turn) as created_at from conversations)",
}


def with_frames(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix `body` with the common table expressions it mentions, in dependency order."""
    defs = {**CTE, **(extra or {})}
    need: list[str] = []

    def visit(text: str) -> None:
        for n in defs:
            if n not in need and re.search(rf"\b(from|join|in|exists)\s+\(?\s*{n}\b|,\s*{n}\b(?=\s+\w+\s+where)", text):
                if defs[n] is not text:
                    visit(defs[n])
                if n not in need:
                    need.append(n)

    visit(body)
    if not need:
        return body
    frames = ", ".join(f"{n} as ({defs[n]})" for n in need)
    for head in ("with recursive ", "with "):
        if body.startswith(head):
            return f"{head}{frames}, {body[len(head):]}"
    return f"with {frames} {body}"


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None) -> Callable[[Run], Run]:
    """Register a query; `sql` may use the adapter frames by name, and further ones given in `extra`."""

    def add(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Query(run, with_frames(sql, extra) if sql else None)
        return run

    return add
