"""Lineage of the products, reachability over the order graph, and the ledger over the conversations."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import functions as F

from plumbline.operators import ledger as L
from plumbline.operators import lineage as G
from plumbline.operators.graph import reachable
from plumbline.plans import products as P
from plumbline.queries.base import query
from plumbline.sources.testtables import grid, ledger, questions, table

CONSUMPTION_EDGES = [
    ("feeders", "region", "region"),
    ("meters", "feeder_id", "feeder_id"),
    ("reads", "kwh_delivered", "kwh_delivered"),
    ("reads", "kwh_received", "kwh_received"),
    ("reads", "meter_id", "meter_id"),
    ("reads", "read_ts", "read_date"),
]


@query(
    "lin_edges",
    "select s as src_table, c as src_column, 'consumption' as dst_table, t as dst_column, (select count(*) from consumption) as n_values"
    " from (values " + ", ".join(f"('{s}', '{c}', '{t}')" for s, c, t in CONSUMPTION_EDGES) + ") e(s, c, t) union all"
    " select s, '*', 'consumption', '*', (select count(*) from consumption) from (values ('feeders'), ('meters'), ('reads')) e(s)",
)
def _(spark, d):
    """Edges of the daily consumption product, with how many values each output column holds."""
    src = grid(spark, d)
    edges = G.edge_frame(spark, G.column_edges("consumption", P.consumption_daily, src))
    df = P.consumption_daily(src)
    counts = df.agg(F.count(F.lit(1)).alias("*"), *[F.count(c).alias(c) for c in df.columns])
    items = [F.struct(F.lit(c).alias("dst_column"), F.col(f"`{c}`").alias("n_values")) for c in counts.columns]
    return edges.join(counts.select(F.inline(F.array(*items))), "dst_column")


def order_graph(spark, d):
    """region -> nation -> customer -> order -> part -> supplier, from the tables' own keys."""
    def e(name, a, ka, b, kb):
        return table(spark, d, name).select(
            F.concat(F.lit(f"{a}:"), F.col(ka)).alias("src"),
            F.concat(F.lit(f"{b}:"), F.col(kb)).alias("dst"),
            F.lit(a).alias("src_kind"),
            F.lit(b).alias("dst_kind"),
        )

    parts = [
        e("nation", "region", "n_regionkey", "nation", "n_nationkey"),
        e("customer", "nation", "c_nationkey", "customer", "c_custkey"),
        e("orders", "customer", "o_custkey", "order", "o_orderkey"),
        e("lineitem", "order", "l_orderkey", "part", "l_partkey"),
        e("lineitem", "part", "l_partkey", "supplier", "l_suppkey"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


#: Rounds after which the walk would jump: the order graph is five levels deep.
SHALLOW = 8

GRAPH = {
    "edges": "select 'region:' || n_regionkey as src, 'nation:' || n_nationkey as dst from nation union all select 'nation:' || c_nationkey,"
    " 'customer:' || c_custkey from customer union all select 'customer:' || o_custkey, 'order:' || o_orderkey from orders union all"
    " select 'order:' || l_orderkey, 'part:' || l_partkey from lineitem union all select 'part:' || l_partkey, 'supplier:' || l_suppkey"
    " from lineitem"
}


@query(
    "lin_downstream",
    "with recursive walk(node) as (select 'region:2' union select e.dst from walk w join edges e on e.src = w.node)"
    " select node from walk where node <> 'region:2'",
    extra=GRAPH,
)
def _(spark, d):
    seeds = spark.createDataFrame([("region:2", "region")], "node string, kind string")
    return reachable(order_graph(spark, d), seeds, patience=SHALLOW, kinds=("src_kind", "dst_kind"))[0]


@query(
    "lin_upstream",
    "with recursive walk(node) as (select 'supplier:' || s_suppkey from supplier where s_acctbal < 0 union select e.src from walk w"
    " join edges e on e.dst = w.node) select node from walk",
    extra=GRAPH,
)
def _(spark, d):
    debtors = table(spark, d, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("node"), F.lit("supplier").alias("kind"))
    return reachable(order_graph(spark, d), debtors, inclusive=True, reverse=True, patience=SHALLOW, kinds=("src_kind", "dst_kind"))[0]


@query(
    "lin_tables",
    "select split_part(src, ':', 1) as src_table, split_part(dst, ':', 1) as dst_table from edges group by 1, 2",
    extra=GRAPH,
)
def _(spark, d):
    def kind(c):
        return F.substring_index(c, ":", 1)

    e = order_graph(spark, d)
    marks = e.select(kind("src").alias("src_table"), F.lit(G.ANY).alias("src_column"), kind("dst").alias("dst_table"), F.lit(G.ANY).alias("dst_column"))
    return G.table_graph(marks)


HEADS = {
    "heads": "select * from (select l.*, row_number() over (partition by target_fqn, artifact_kind order by created_at desc, artifact_id"
    " desc) as rn from ledger l where not exists (select 1 from ledger n where n.prev_artifact_id = l.artifact_id)) where rn = 1",
    "nodes": "select question_id, 'product_' || topic as node_table from questions",
    "status": "select target_fqn, bool_or(agent not like 'human:%' and approved_by is null) as open,"
    " bool_or(agent not like 'human:%') as agent from heads group by 1",
}


def question_nodes(spark, d):
    return questions(spark, d).select("question_id", F.concat(F.lit("product_"), "topic").alias("table"))


@query(
    "lin_node_status",
    "select question_id, node_table as \"table\", case when agent is null then 'source' when open then 'agent_unapproved' when agent then"
    " 'agent_approved' else 'human' end as status from nodes left join status on target_fqn = node_table",
    extra=HEADS,
)
def _(spark, d):
    return G.node_status(question_nodes(spark, d), L.heads(ledger(spark, d)))


@query("prov_head", "select target_fqn, artifact_kind, artifact_id, agent, approved_by from heads", extra=HEADS)
def _(spark, d):
    return L.heads(ledger(spark, d)).select("target_fqn", "artifact_kind", "artifact_id", "agent", "approved_by")


NEW_ROWS = {
    "fresh": "select 10000000 + event_id as artifact_id, 'product_' || k as target_fqn, case when k % 3 = 0 then 'patch' else 'model_sql'"
    " end as artifact_kind, timestamp '2025-01-01' + to_seconds(event_id) as created_at, props as content from"
    " (select *, json_extract_string(props, '$.k')::int as k from events)"
}


@query(
    "prov_append",
    "select f.artifact_id, f.target_fqn, sha256(f.content) as content_sha256, coalesce(lag(f.artifact_id) over (partition by f.target_fqn,"
    " f.artifact_kind order by f.created_at, f.artifact_id), h.artifact_id) as prev_artifact_id from fresh f left join heads h"
    " on h.target_fqn = f.target_fqn and h.artifact_kind = f.artifact_kind",
    extra={**HEADS, **NEW_ROWS},
)
def _(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    fresh = table(spark, d, "events").select(
        (F.lit(10000000) + F.col("event_id")).alias("artifact_id"),
        F.concat(F.lit("product_"), k).alias("target_fqn"),
        F.when(k % 3 == 0, "patch").otherwise("model_sql").alias("artifact_kind"),
        F.timestamp_seconds(F.unix_timestamp(F.lit("2025-01-01").cast("timestamp")) + F.col("event_id")).alias("created_at"),
        F.col("props").alias("content"),
    )
    return L.link(fresh, ledger(spark, d)).select("artifact_id", "target_fqn", "content_sha256", "prev_artifact_id")


@query(
    "prov_verify",
    "select artifact_id, 'content_mismatch' as problem from ledger where sha256(content) <> content_sha256"
    " union all select l.artifact_id, 'bad_predecessor' from ledger l left join ledger p on p.artifact_id = l.prev_artifact_id"
    " where l.prev_artifact_id is not null and (p.artifact_id is null or p.target_fqn <> l.target_fqn or p.artifact_kind <> l.artifact_kind"
    " or p.created_at > l.created_at) union all select artifact_id, 'fork' from (select artifact_id, row_number() over"
    " (partition by prev_artifact_id order by created_at, artifact_id) as rn from ledger where prev_artifact_id is not null) where rn > 1"
    " union all select artifact_id, 'second_root' from (select artifact_id, row_number() over (partition by target_fqn, artifact_kind"
    " order by created_at, artifact_id) as rn from ledger where prev_artifact_id is null) where rn > 1",
)
def _(spark, d):
    return L.problems(ledger(spark, d))


KEY = b"plumbline test key"  # only seals test rows
_PADDED = KEY.ljust(64, b"\0")
IPAD, OPAD = ("".join(f"\\x{b ^ p:02X}" for b in _PADDED) for p in (0x36, 0x5C))
SEALED_SQL = (
    "'artifact_id=' || artifact_id || '|artifact_kind=' || artifact_kind || '|target_fqn=' || target_fqn || '|content_sha256=' ||"
    " content_sha256 || '|agent=' || agent || '|approved_by=' || coalesce(approved_by, 'null') || '|created_at=' ||"
    " strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '|prev_artifact_id=' || coalesce(prev_artifact_id::varchar, 'null')"
)


@query(
    "prov_seal",
    f"select artifact_id, sha256('{OPAD}'::blob || unhex(sha256('{IPAD}'::blob || encode({SEALED_SQL})))) as seal from ledger",
)
def _(spark, d):
    return L.seal(ledger(spark, d), KEY).select("artifact_id", "seal")


@query("prov_seal_check", "select artifact_id from ledger where approved_by = 'auto-gate'")
def _(spark, d):
    """Rows whose approval was edited after sealing are exactly the ones the check finds."""
    sealed = L.seal(ledger(spark, d), KEY)
    edited = sealed.withColumn("approved_by", F.when(F.col("approved_by") == "auto-gate", "reviewer").otherwise(F.col("approved_by")))
    return L.broken_seals(edited, KEY)


@query(
    "prov_chain",
    "with recursive walk(artifact_id, depth) as (select artifact_id, 0 from heads where artifact_kind = 'patch' union"
    " select l.prev_artifact_id, w.depth + 1 from walk w join ledger l on l.artifact_id = w.artifact_id"
    " where l.prev_artifact_id is not null) select artifact_id, min(depth)::int as depth from walk group by 1",
    extra=HEADS,
)
def _(spark, d):
    rows = ledger(spark, d)
    return L.chain_behind(rows, L.heads(rows).where("artifact_kind = 'patch'"))


@query(
    "prov_path",
    "select target_fqn, artifact_kind, artifact_id, agent, approved_by, agent not like 'human:%' as is_agent from heads"
    " where target_fqn in (select node_table from nodes)",
    extra=HEADS,
)
def _(spark, d):
    return L.path_artifacts(question_nodes(spark, d), ledger(spark, d))
