"""Trust verdicts over parts as products and orders as certificates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from plumbline.operators import verdict as V
from plumbline.queries.base import query
from plumbline.sources.testtables import market, table

AS_OF = datetime(2001, 8, 2)

MARKET = {
    "sold": "select l_partkey, max(l_shipdate) as last_refreshed_at, round(avg(case when l_discount <= 0.08 then 1.0 else 0.0 end), 4)"
    " as quality_score, coalesce(string_agg(distinct l_returnflag, ',' order by l_returnflag) filter (where l_discount > 0.08), '')"
    " as failing_tests from lineitem group by 1",
    "products": "select p_partkey as product, last_refreshed_at, p_size * 96.0 as sla_hours, case when p_brand = 'Brand#3' then 'held'"
    " else 'ok' end as refresh_status, quality_score, failing_tests, p_size % 4 + 1 as criticality, p_size % 3 as credits, p_type, p_size,"
    " round(epoch(timestamp '2001-08-02' - last_refreshed_at) / 3600.0, 2)::double as age_hours,"
    " epoch(timestamp '2001-08-02' - last_refreshed_at) / 3600.0 <= p_size * 96.0 and p_brand <> 'Brand#3' as fresh"
    " from part join sold on l_partkey = p_partkey",
    "artifacts": "select l_partkey as product, a.l_orderkey as artifact_id, case when a.l_linestatus = 'O' then 'builder' else 'human:x' end"
    " as agent, case a.l_returnflag when 'N' then 'auto-gate' when 'R' then 'reviewer' end as approved_by, a.l_linestatus = 'O' as is_agent"
    " from (select l_partkey, max({'l_shipdate': l_shipdate, 'l_orderkey': l_orderkey, 'l_linenumber': l_linenumber, 'l_suppkey':"
    " l_suppkey, 'l_linestatus': l_linestatus, 'l_returnflag': l_returnflag}) as a from lineitem group by 1)",
    "metrics": "select distinct l_orderkey as cert_id, l_partkey as product, l_returnflag || l_linestatus as name,"
    " not (l_returnflag = 'R' and l_linestatus = 'O') as certified from lineitem",
    "cert_products": "select distinct l_orderkey as cert_id, l_partkey as product from lineitem",
    "seen": "select c.cert_id, p.* from cert_products c join products p on p.product = c.product",
    "cert_metrics": "select distinct cert_id, name, certified from metrics",
    "trace": "select cert_id, 1 as rule, 1 as severity, 'metric ' || name || ' is not certified' as reason from cert_metrics"
    " where not certified union all select cert_id, 2, 1, product || ' last loaded ' || age_hours || 'h ago' from seen where not fresh"
    " union all select cert_id, 3, case when quality_score < 0.7 then 2 else 1 end, product || ' quality below ' || case when"
    " quality_score < 0.7 then '0.7' else '0.9' end from seen where quality_score < 0.9 union all select c.cert_id, 4, 2,"
    " 'unapproved artifact ' || a.artifact_id || ' by ' || a.agent from cert_products c join artifacts a on a.product = c.product"
    " where a.is_agent and (a.approved_by is null or a.approved_by = 'auto-gate') and c.cert_id in"
    " (select cert_id from seen where criticality >= 4)",
    "own_trace": "select product, 1 as severity from (select distinct product, name, certified from metrics) where not certified union all"
    " select product, 1 from products where not fresh union all select product, case when quality_score < 0.7 then 2 else 1 end from"
    " products where quality_score < 0.9 union all select a.product, 2 from artifacts a join products p on p.product = a.product where"
    " a.is_agent and (a.approved_by is null or a.approved_by = 'auto-gate') and p.criticality >= 4",
    "own": "select p.product, max(coalesce(t.severity, 0)) as severity, count(t.severity) as rules_fired from products p left join"
    " own_trace t on t.product = p.product group by 1",
}
NAMES = "(array['release', 'release_with_warning', 'block'])[{} + 1]"


def frames(spark, d):
    m = market(spark, d)
    m["status"] = V.freshness(m["products"], AS_OF)
    m["cert_products"] = m["nodes"].distinct()
    m["cert_metrics"] = m["metrics"].select("cert_id", "name", "certified").distinct()
    return m


def own_verdicts(m):
    return V.assess(m["status"], m["metrics"].select("product", "name", "certified").distinct(), m["artifacts"])


@query("cert_freshness", "select product, age_hours, sla_hours::double as sla_hours, fresh from products", extra=MARKET)
def _(spark, d):
    return frames(spark, d)["status"].select("product", "age_hours", "sla_hours", "fresh")


@query(
    "cert_quality",
    "select product, quality_score, failing_tests, case when quality_score < 0.7 then 'block' when quality_score < 0.9 then"
    " 'release_with_warning' else 'release' end as outcome from products",
    extra=MARKET,
)
def _(spark, d):
    q = F.col("quality_score")
    outcome = F.when(q < V.BLOCK_BELOW, V.BLOCK).when(q < V.WARN_BELOW, V.WARN).otherwise(V.RELEASE)
    return frames(spark, d)["status"].select("product", "quality_score", "failing_tests", outcome.alias("outcome"))


@query(
    "cert_unapproved_share",
    "select l.l_orderkey as cert_id, round(avg(case when a.is_agent and a.approved_by is null then 1.0 else 0.0 end), 4)"
    " as agent_share_unapproved from lineitem l left join artifacts a on a.product = l.l_partkey group by 1",
    extra=MARKET,
)
def _(spark, d):
    m = frames(spark, d)
    return V.unapproved_share(m["nodes"], m["artifacts"])


@query(
    "cert_rules",
    "select o.o_orderkey as cert_id, " + NAMES.format("max(coalesce(t.severity, 0))") + " as verdict, count(t.severity) as rules_fired"
    " from orders o left join trace t on t.cert_id = o.o_orderkey group by 1",
    extra=MARKET,
)
def _(spark, d):
    m = frames(spark, d)
    return V.verdicts(m["certs"], m["cert_metrics"], m["cert_products"], m["status"], m["artifacts"])


@query("cert_rule_trace", "select cert_id, rule, severity, reason from trace", extra=MARKET)
def _(spark, d):
    m = frames(spark, d)
    return V.rule_trace(m["cert_metrics"], m["cert_products"], m["status"], m["artifacts"])


@query("cert_assess", "select product, " + NAMES.format("severity") + " as verdict, rules_fired from own", extra=MARKET)
def _(spark, d):
    return own_verdicts(frames(spark, d))


@query(
    "cert_bundle_worst",
    "select b.bundle, " + NAMES.format("max(coalesce(o.severity, 1))") + " as verdict, count(*) filter (where o.severity is null)"
    " as unavailable from (select distinct l_suppkey as bundle, l_partkey as product from lineitem) b left join"
    " (select own.* from own join products p on p.product = own.product where p.p_size <= 45) o on o.product = b.product group by 1",
    extra=MARKET,
)
def _(spark, d):
    """Suppliers as bundles of the parts they deliver; the largest parts are not published."""
    m = frames(spark, d)
    published = own_verdicts(m).join(m["products"].where("p_size <= 45").select("product"), "product", "left_semi")
    bundles = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("bundle"), F.col("l_partkey").alias("product")).distinct()
    return V.bundle_worst(bundles, published)


BREACHES = {
    "bad": "select product, credits, 'freshness' as kind, case when refresh_status = 'held' then 'drift under review' else"
    " strftime(last_refreshed_at, '%Y-%m-%dT%H:%M:%S') end as episode, p_type from products where credits > 0 and not fresh union all"
    " select product, credits, 'quality', failing_tests, p_type from products where credits > 0 and quality_score < 0.9",
    "firsts": "select product, cert_id, consumer from (select l_partkey as product, o_orderkey as cert_id, o_custkey as consumer,"
    " row_number() over (partition by l_partkey order by o_orderdate, o_orderkey) as rn from lineitem join orders on"
    " o_orderkey = l_orderkey) where rn = 1",
}


@query(
    "sla_breach",
    "select b.product || '|' || kind || '|' || episode as dedupe_key, b.product, kind, credits::double as credits, cert_id, consumer"
    " from bad b join firsts f on f.product = b.product where p_type <> 'ECONOMY'",
    extra={**MARKET, **BREACHES},
)
def _(spark, d):
    """Breaches of economy parts are already in the ledger, so they are not charged again."""
    m = frames(spark, d)
    known = V.breaches(m["certs"], m["cert_products"], m["status"].where("p_type = 'ECONOMY'"))
    return V.breaches(m["certs"], m["cert_products"], m["status"], known)


@query(
    "sla_credits_30d",
    "select l_partkey as product, sum(l_quantity) as credits from lineitem where l_shipdate >= timestamp '2001-07-03' group by 1",
)
def _(spark, d):
    ledger = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("product"), F.col("l_quantity").alias("credits"), F.col("l_shipdate").alias("settled_at")
    )
    return V.credits_since(ledger, AS_OF)
