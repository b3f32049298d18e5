"""Metric questions over the products."""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce

from pyspark.sql import functions as F

from plumbline.functions.hashing import result_hash, table_digest
from plumbline.functions.times import window_bounds
from plumbline.operators.retrieval import best_similarity, confidence, retrieve
from plumbline.plans import products as P
from plumbline.plans import semantic as M
from plumbline.plans.policy import Policy, Principal, apply_policies
from plumbline.queries.base import query
from plumbline.queries.products import CAUSES, rounded, reliability_by_day, stored_grid
from plumbline.session import settle
from plumbline.sources.testtables import RESTORE_SHARE, grid, table

AS_OF = date(2024, 1, 31)
MODEL = M.Registry(
    (*M.reliability_elements(grain="day"), *M.consumption_elements(), *M.reliability_elements("reliability_v2", "day", "saidi_minutes")),
    (M.Rename("reliability_v2", "saidi", "saidi_minutes", 2),),
)
HOURLY = M.Registry(
    (
        M.Element("kwh", "metric", "reads", "sum(kwh_delivered)", certified=True),
        M.Element("read_ts", "dimension", "reads", "read_ts", grain="timestamp"),
    )
)
RELIABILITY_FILTER = Policy("pol-reliability", "reliability", "row_filter", "region = :user.region", attribute="region")
ANALYST = Principal("ann", "analyst", "ASIA")

SAIDI = "round(sum(customer_minutes_interrupted) / nullif(sum(customers_served) / count(distinct day), 0), 4)"
SAIFI = "round(sum(customer_interruptions) / nullif(sum(customers_served) / count(distinct day), 0), 4)"
CAIDI = "round(sum(customer_minutes_interrupted) / nullif(sum(customer_interruptions), 0), 4)"
LAST7 = "day >= date '2024-01-24' and day < date '2024-01-31'"
BEFORE7 = "day >= date '2024-01-17' and day < date '2024-01-24'"


def run(spark, d, plan, product=None, model=MODEL):
    df = reliability_by_day(spark, d) if product is None else product
    return M.compile_plan(model, plan, df, AS_OF)


@query("sem_compile", f"select feeder_id, {SAIDI} as saidi from reliability where region = 'ASIA' and {LAST7} group by 1 order by 1")
def _(spark, d):
    """SAIDI by feeder of the analyst's region over the last seven days."""
    seen = apply_policies(reliability_by_day(spark, d), "reliability", [RELIABILITY_FILTER], ANALYST)
    return rounded(run(spark, d, M.Plan("reliability", ("saidi",), ("feeder_id",), window="last_7_days"), seen))


@query("sem_compile_total", f"select {SAIDI} as saidi, sum(outage_count)::bigint as outage_count from reliability")
def _(spark, d):
    return rounded(run(spark, d, M.Plan("reliability", ("saidi", "outage_count"), window="all")))


@query(
    "sem_filter",
    "select read_date, region, round(sum(kwh_delivered), 4) as daily_kwh from consumption where region in ('ASIA', 'EUROPE')"
    " and feeder_id = '8' group by 1, 2 order by 1, 2",
)
def _(spark, d):
    filters = (M.Filter("region", ["ASIA", "EUROPE"]), M.Filter("feeder_id", "8"))
    plan = M.Plan("consumption", ("daily_kwh",), ("read_date", "region"), filters)
    return rounded(run(spark, d, plan, P.consumption_daily(grid(spark, d))))


WINDOWS = [
    "last_month", "month_before_last", "last_3_months", "this_month", "last_week", "last_7_days", "week_before_last", "yesterday", "all",
]


def _window_rows():
    for w in WINDOWS:
        b = window_bounds(w, datetime(2024, 1, 31, 9))
        yield (w, "null::date", "null::date") if b is None else (w, f"date '{b[0]}'", f"date '{b[1]}'")


@query(
    "sem_window",
    "select w.name as time_window, round(sum(c.kwh_delivered), 4) as daily_kwh, count(*) as n from consumption c join (values "
    + ", ".join(f"('{n}', {a}, {b})" for n, a, b in _window_rows())
    + ") w(name, lo, hi) on w.lo is null or (c.read_date >= w.lo and c.read_date < w.hi) group by 1",
)
def _(spark, d):
    """Every relative window at once: days are totalled first, then filed under each window holding them."""
    days = P.consumption_daily(grid(spark, d)).groupBy("read_date").agg(F.sum("kwh_delivered").alias("kwh"), F.count(F.lit(1)).alias("rows"))
    spans = []
    for w in WINDOWS:
        b = window_bounds(w, datetime(2024, 1, 31, 9))
        lo, hi = (F.lit(None if b is None else str(x)).cast("date") for x in (b or (None, None)))
        spans.append(F.struct(F.lit(w).alias("time_window"), lo.alias("lo"), hi.alias("hi")))
    inside = F.col("lo").isNull() | ((F.col("read_date") >= F.col("lo")) & (F.col("read_date") < F.col("hi")))
    return (
        days.select("*", F.inline(F.array(*spans)))
        .where(inside)
        .groupBy("time_window")
        .agg(F.round(F.sum("kwh"), 4).alias("daily_kwh"), F.sum("rows").alias("n"))
    )


@query(
    "sem_time_dim",
    "select read_ts, round(sum(kwh_delivered), 4) as kwh from reads where read_ts >= timestamp '2024-01-24'"
    " and read_ts < timestamp '2024-01-31' group by 1 order by 1",
)
def _(spark, d):
    plan = M.Plan("reads", ("kwh",), ("read_ts",), window="last_week")
    return rounded(run(spark, d, plan, grid(spark, d)["reads"], HOURLY))


@query("sem_ratio_metric", f"select region, {SAIDI} as saidi, {SAIFI} as saifi, {CAIDI} as caidi from reliability group by 1 order by 1")
def _(spark, d):
    return rounded(run(spark, d, M.Plan("reliability", ("saidi", "saifi", "caidi"), ("region",))))


@query("sem_alias", f"select substation_id, {SAIDI} as saidi from reliability group by 1 order by 1")
def _(spark, d):
    product = P.reliability_v2(stored_grid(spark, d), "day", RESTORE_SHARE)
    return rounded(run(spark, d, M.Plan("reliability_v2", ("saidi",), ("substation_id",)), product))


def _parts(spark, d):
    plan = M.Plan("reliability", ("saidi",), ("feeder_id",), window="last_week")
    product = settle(reliability_by_day(spark, d), "product")  # three results of one product
    return {ref: run(spark, d, p, product) for ref, p in M.drilldowns(plan).items()}


@query(
    "sem_drilldown",
    f"select 'main' as query_ref, feeder_id, {SAIDI} as saidi from reliability where {LAST7} group by 2"
    f" union all select 'total', null, {SAIDI} from reliability where {LAST7}"
    f" union all select 'previous_period', feeder_id, {SAIDI} from reliability where {BEFORE7} group by 2",
)
def _(spark, d):
    parts = [df.withColumn("query_ref", F.lit(ref)) for ref, df in _parts(spark, d).items()]
    return rounded(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


@query(
    "sem_top_feature",
    f"with main as (select feeder_id, {SAIDI} as v from reliability where {LAST7} group by 1),"
    f" prev as (select feeder_id, {SAIDI} as v from reliability where {BEFORE7} group by 1),"
    " top as (select feeder_id as top_key, v as top_value from main where v is not null order by v desc, feeder_id limit 1)"
    " select top_key, top_value, (select count(*) from main where v is not null) as groups,"
    f" (select {SAIDI} from reliability where {LAST7}) as total_value, prev.v as previous_value,"
    " round(top_value - prev.v, 3) as change from top left join prev on prev.feeder_id = top_key",
)
def _(spark, d):
    df = rounded(M.headline({k: rounded(v) for k, v in _parts(spark, d).items()}, "feeder_id", "saidi"))
    return df.withColumn("change", F.round("change", 3))


@query(
    "sem_registry",
    f"select 'reliability' as product, * from (select 'saidi' as name, 'metric' as kind, true as certified, {SAIDI} as value"
    f" from reliability union all select 'saifi', 'metric', true, {SAIFI} from reliability"
    f" union all select 'caidi', 'metric', true, {CAIDI} from reliability"
    " union all select 'outage_count', 'measure', true, sum(outage_count)::double from reliability"
    " union all select 'customers_interrupted', 'measure', true, sum(customer_interruptions)::double from reliability)",
)
def _(spark, d):
    return rounded(M.metric_values(MODEL, "reliability", reliability_by_day(spark, d)))


@query(
    "sem_result_hash",
    "select region, sha256(count(*)"
    + "".join(f" || '|' || sum(('0x' || substr(h, {1 + 12 * i}, 12))::bigint)::decimal(38,0)::varchar" for i in range(5))
    + ") as result_hash, count(*) as row_count from (select region,"
    " sha256('feeder_id=' || feeder_id || '|saidi=' || coalesce(v::decimal(38,4)::varchar, 'null')) as h from"
    f" (select region, feeder_id, {SAIDI} as v from reliability group by 1, 2)) group by 1",
)
def _(spark, d):
    rows = run(spark, d, M.Plan("reliability", ("saidi",), ("region", "feeder_id")))
    return result_hash(rows, ["region"], ["feeder_id", "saidi"])


@query(
    "sem_result_hash_table",
    "with h as (select sha256('kwh_delivered=' || round(kwh_delivered, 4)::decimal(38,4)::varchar || '|meter_id=' || meter_id"
    " || '|read_date=' || read_date) as h from consumption) select count(*) as row_count, sha256(count(*)"
    + "".join(f" || '|' || sum(('0x' || substr(h, {1 + 12 * i}, 12))::bigint)::decimal(38,0)::varchar" for i in range(5))
    + ") as digest from h",
)
def _(spark, d):
    return table_digest(P.consumption_daily(grid(spark, d)), ["read_date", "meter_id", "kwh_delivered"])


# --- retrieval: parts as questions, kinds of part as the element registry ------------------------------


def part_questions(spark, d):
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("question_id"), F.concat_ws(" ", "p_brand", "p_name", "p_type").alias("text")
    )


def part_elements(spark, d):
    """A registry from the distinct part names and types (their number does not grow with the table)."""
    parts = table(spark, d, "part")
    name, noun = F.col("p_name"), F.substring_index("p_name", " ", -1)
    names = parts.select("p_name").distinct().select(
        F.concat(F.lit("m:"), name).alias("element_id"),
        F.lit("metric").alias("kind"),
        noun.alias("product"),
        F.array(name).alias("phrases"),
        F.concat(F.lit("number of "), noun, F.lit(" parts")).alias("description"),
    )
    kinds = parts.select("p_type", noun.alias("product")).distinct().select(
        F.concat(F.lit("d:"), "product", F.lit(":"), F.lower("p_type")).alias("element_id"),
        F.lit("dimension").alias("kind"),
        "product",
        F.array(F.concat(F.lower("p_type"), F.lit(" "), "product")).alias("phrases"),
        F.lit("kind of part").alias("description"),
    )
    return names.unionByName(kinds)


CONCEPTS = [("round", "ring"), ("round", "gear")]

RETRIEVAL = {
    "q": "select p_partkey as question_id, lower(p_brand || ' ' || p_name || ' ' || p_type) as text from part",
    "el": "select distinct 'm:' || p_name as element_id, 'metric' as kind, split_part(p_name, ' ', 2) as product, p_name as phrase,"
    " 'number of ' || split_part(p_name, ' ', 2) || ' parts' as description from part union all select distinct"
    " 'd:' || split_part(p_name, ' ', 2) || ':' || lower(p_type), 'dimension', split_part(p_name, ' ', 2),"
    " lower(p_type) || ' ' || split_part(p_name, ' ', 2), 'kind of part' from part",
    "hits": "select distinct q.question_id, e.element_id, e.kind, e.product from q, el e where"
    " (' ' || regexp_replace(q.text, '[^a-z0-9]', ' ', 'g') || ' ') like '% ' || e.phrase || ' %' or"
    " (regexp_matches(q.text, '(^|[^a-z0-9])(ring|gear)([^a-z0-9]|$)') and regexp_matches(e.phrase, '(^|[^a-z0-9])(ring|gear)([^a-z0-9]|$)'))",
    "dims": "select distinct h.question_id, e.element_id from hits h join el e on e.product = h.product and e.kind = 'dimension'"
    " where h.kind = 'metric'",
    "texts": "select 'q' as src, text as id, text from (select distinct text from q) union all select 'd', element_id,"
    " lower(phrase || ' ' || description) from el",
    "toks": "select src, id, regexp_extract_all(text, '[\\p{L}\\p{N}_]{2,}') as w from texts",
    "terms": "select src, id, term, count(*)::double as tf from (select src, id, unnest(w) as term from toks union all select src, id,"
    " unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from toks where len(w) > 1) group by 1, 2, 3",
    "dfs": "select term, count(*)::double as df from terms where src = 'd' group by 1",
    "nd": "select count(*)::double as n from el",
    "dt": "select t.id as element_id, t.term, t.tf, ln((n + 2) / (1 + df)) + 1 as w0, ln((n + 2) / (2 + df)) + 1 as w1"
    " from terms t join dfs on dfs.term = t.term cross join nd where t.src = 'd'",
    "dn": "select element_id, sum((tf * w0) ** 2) as d_len from dt group by 1",
    "qt": "select t.id as text, t.term, t.tf, ln((n + 2) / (2 + coalesce(df, 0))) + 1 as w from terms t left join dfs"
    " on dfs.term = t.term cross join nd where t.src = 'q'",
    "qn": "select text, sum((tf * w) ** 2) as q_len from qt group by 1",
    "sims": "select q.text, d.element_id, sum(q.tf * d.tf * d.w1 ** 2) as dot, sum(d.tf ** 2 * (d.w1 ** 2 - d.w0 ** 2)) as fix"
    " from qt q join dt d on d.term = q.term group by 1, 2",
    "cosines": "select q.question_id, s.element_id, dot / sqrt(q_len * (d_len + fix)) as similarity from sims s join dn"
    " on dn.element_id = s.element_id join qn on qn.text = s.text join q on q.text = s.text",
    "marks": "select question_id, element_id, max(hit) as hit, max(dim) as dim, max(similarity) as similarity from (select question_id,"
    " element_id, 1 as hit, 0 as dim, 0.0 as similarity from hits union all select question_id, element_id, 0, 1, 0.0 from dims"
    " union all select question_id, element_id, 0, 0, similarity from cosines) group by 1, 2",
    "ranked": "select *, (hit = 1 or dim = 1) as chosen, sum(hit) over (partition by question_id) as hits,"
    " sum(case when hit = 1 or dim = 1 then 1 else 0 end) over (partition by question_id) as taken,"
    " row_number() over (partition by question_id, (hit = 1 or dim = 1) order by round(similarity, 12) desc, element_id) as rn,"
    " round(max(similarity) over (partition by question_id), 4) as retrieval from marks",
    "chosen_rows": "select question_id, element_id, case when hit = 1 then 'phrase' when dim = 1 then 'dimension' else 'similarity' end"
    " as reason, round(similarity, 4) as similarity, retrieval from ranked where chosen or rn <= greatest(15, hits) - taken",
}


def _asked(spark, d):
    return part_questions(spark, d), part_elements(spark, d), 15, spark.createDataFrame(CONCEPTS, "concept string, phrase string")


@query("sem_retrieve", "select question_id, element_id, reason, similarity, retrieval from chosen_rows", extra=RETRIEVAL)
def _(spark, d):
    return retrieve(*_asked(spark, d))


KNOWN = ["ring", "gear", "bolt", "red", "large", "economy", "standard", "small", "promo"]


@query(
    "sem_confidence",
    "select question_id, value as confidence, case when value < 0.6 then 'low_confidence' else 'answered' end as outcome from"
    " (select question_id, round(known / greatest(asked, 1) * least(1.0, 0.7 + retrieval), 4) as value from (select r.question_id,"
    " r.retrieval, len(w) as asked, len(list_intersect(w, ['"
    + "', '".join(KNOWN)
    + "'])) as known from (select question_id, max(retrieval) as retrieval from chosen_rows group by 1) r join (select p_partkey,"
    " list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) as w from part) p on p.p_partkey = r.question_id))",
    extra=RETRIEVAL,
)
def _(spark, d):
    asked = table(spark, d, "part").select(
        F.col("p_partkey").alias("question_id"),
        F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ").alias("requested_terms"),
        F.array(*[F.lit(w) for w in KNOWN]).alias("matched_terms"),
        F.array(F.substring_index("p_name", " ", -1)).alias("metrics"),
    )
    best = best_similarity(*_asked(spark, d))
    known = asked.withColumn("metrics", F.array_intersect("metrics", "matched_terms"))
    return confidence(known.join(best, "question_id"))
