"""Column lineage from the analyzed plans of product functions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.graph import reachable
from plumbline.plans.products import Product, Sources

ANY = "*"  # stands for the whole table in dependency edges
EDGE_SCHEMA = "src_table string, src_column string, dst_table string, dst_column string"
_TAG = "src__"

Edge = tuple[str, str, str, str]


class _Plan:
    """What each attribute of one analyzed plan is computed from."""

    def __init__(self, nodes: list[dict[str, Any]]) -> None:
        # attribute id -> what it is computed from: other ids, or (source table, column) where the reference says so
        self.parents: dict[int, set[Any]] = {}
        # id leaving a source -> its (table, column); sources built from one another may share ids
        self.sources: dict[int, set[tuple[str, str]]] = {}
        self.names: dict[int, str] = {}
        self.tables: set[str] = set()
        self.shared: dict[Any, list[int]] = {}
        self.output = self._visit(iter(nodes))

    def _visit(self, nodes: Iterator[dict[str, Any]]) -> list[int]:
        """Consume one node and its children (pre-order); return the ids of its output columns."""
        node = next(nodes)
        kind = node["class"].rsplit(".", 1)[-1]
        below = [self._visit(nodes) for _ in range(node["num-children"])]
        child = below[0] if below else []
        if kind == "Project":
            return self._define(node["projectList"])
        if kind == "Aggregate":
            return self._define(node["aggregateExpressions"])
        if kind == "Window":
            return child + self._define(node["windowExpressions"])
        if kind == "Generate":
            made = self._define(node["generatorOutput"])
            for m in made:
                self.parents.setdefault(m, set()).update(self._uses(node["generator"]))
            return child + made
        if kind == "Join":
            return child if any(t in str(node["joinType"]) for t in ("Semi", "Anti")) else child + below[1]
        if kind == "Union":
            for other in below[1:]:
                for a, b in zip(child, other):
                    if a != b:
                        self.parents.setdefault(a, set()).add(b)
            return child
        if kind == "SubqueryAlias":
            name = node["identifier"]["name"]
            if name.startswith(_TAG):
                table = name[len(_TAG) :]
                self.tables.add(table)
                for i in child:
                    self.sources.setdefault(i, set()).add((table, self.names[i]))
            return child
        if kind == "CTERelationDef":
            self.shared[node.get("id")] = child
            return child
        if kind == "WithCTE":
            return below[-1] if below else []
        if "output" in node and isinstance(node["output"], list):
            made = self._define(node["output"])
            for a, b in zip(made, self.shared.get(node.get("cteId"), [])):
                self.parents.setdefault(a, set()).add(b)
            return made
        return child

    def _define(self, expressions: list[list[dict[str, Any]]]) -> list[int]:
        ids = []
        for e in expressions:
            head = e[0]
            i = head["exprId"]["id"]
            self.names[i] = head["name"]
            if head["class"].endswith(".Alias"):
                self.parents.setdefault(i, set()).update(self._uses(e[1:]))
            ids.append(i)
        return ids

    @staticmethod
    def _reference(attribute: dict[str, Any]) -> Any:
        q = str(attribute.get("qualifier") or "").strip("[]")
        return (q[len(_TAG) :], attribute["name"]) if q.startswith(_TAG) else attribute["exprId"]["id"]

    def _uses(self, expression: list[dict[str, Any]]) -> set[Any]:
        out: set[Any] = set()
        for n in expression:
            if n["class"].endswith(".AttributeReference"):
                out.add(self._reference(n))
            if isinstance(n.get("plan"), list):
                out.update(self._visit(iter(n["plan"])))
        return out

    def leaves(self, attribute: int) -> set[tuple[str, str]]:
        found, seen, todo = set(), set(), [attribute]
        while todo:
            i = todo.pop()
            if isinstance(i, tuple):
                found.add(i)
            elif i not in seen:
                seen.add(i)
                found |= self.sources.get(i, set())
                todo += () if i in self.sources else self.parents.get(i, ())
        return found

    def top(self, nodes: list[dict[str, Any]]) -> list[Any]:
        """Output of the plan; where it ends in a projection, the references as written."""
        head = nodes[0].get("projectList") or []
        named = {e[0]["exprId"]["id"]: self._reference(e[0]) for e in head if e[0]["class"].endswith(".AttributeReference")}
        return [named.get(i, i) for i in self.output]


def column_edges(dst: str, model: Product, src: Sources) -> list[Edge]:
    """Edges from source columns to the columns of `model`, plus one edge per source table.

    Sources are tagged by alias before the model runs; the analyzed plan then says, column by column, what
    each output is computed from. Conditions of joins and filters do not count, only values do.
    """
    df = model({n: f.alias(f"{_TAG}{n}") for n, f in src.items()})
    nodes = json.loads(df._jdf.queryExecution().analyzed().toJSON())
    plan = _Plan(nodes)
    edges = {(t, c, dst, name) for name, i in zip(df.columns, plan.top(nodes)) for t, c in plan.leaves(i)}
    return sorted(edges) + sorted((t, ANY, dst, ANY) for t in plan.tables)


def edge_frame(spark: SparkSession, edges: list[Edge]) -> DataFrame:
    return spark.createDataFrame(edges, EDGE_SCHEMA)


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.concat_ws(".", "src_table", "src_column").alias("src"), F.concat_ws(".", "dst_table", "dst_column").alias("dst")
    )


def _nodes(spark: SparkSession, nodes: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in nodes], "node string")


def upstream_columns(edges: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """All columns the given ones depend on, themselves included."""
    seeds = _nodes(edges.sparkSession, [f"{table}.{c}" for c in [*columns, ANY]])
    return reachable(_pairs(edges), seeds, inclusive=True, reverse=True)[0].where(~F.col("node").endswith(f".{ANY}"))


def downstream_columns(edges: DataFrame, table: str, columns: list[str]) -> DataFrame:
    seeds = _nodes(edges.sparkSession, [f"{table}.{c}" for c in columns])
    return reachable(_pairs(edges), seeds)[0].where(~F.col("node").endswith(f".{ANY}"))


def table_graph(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src_column") == ANY).select("src_table", "dst_table").distinct()


def related_tables(edges: DataFrame, table: str, upstream: bool = True) -> DataFrame:
    e = table_graph(edges).select(F.col("src_table").alias("src"), F.col("dst_table").alias("dst"))
    return reachable(e, _nodes(edges.sparkSession, [table]), reverse=upstream)[0].select(F.col("node").alias("table"))


def blast_radius(edges: DataFrame, criticality: DataFrame, table: str, columns: list[str], default: int = 2) -> DataFrame:
    """Tables whose columns depend on the changed ones, most critical first."""
    node = F.col("node")
    hit = downstream_columns(edges, table, columns).select(
        F.regexp_extract(node, r"^(.*)\.[^.]*$", 1).alias("table"), F.substring_index(node, ".", -1).alias("column")
    )
    return (
        hit.groupBy("table")
        .agg(F.array_sort(F.collect_set("column")).alias("columns"))
        .join(criticality, "table", "left")
        .select("table", F.coalesce("criticality", F.lit(default)).alias("criticality"), F.concat_ws(",", "columns").alias("columns"))
        .orderBy(F.desc("criticality"), "table")
    )


def node_status(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """source, human, agent_approved or agent_unapproved, from the latest artifacts of each node's table."""
    is_agent = ~F.col("agent").startswith("human:")
    per_table = heads.groupBy(F.col("target_fqn").alias("table")).agg(
        F.bool_or(is_agent & F.col("approved_by").isNull()).alias("open"), F.bool_or(is_agent).alias("agent")
    )
    return nodes.join(per_table, "table", "left").select(
        *nodes.columns,
        F.when(F.col("agent").isNull(), "source")
        .when(F.col("open"), "agent_unapproved")
        .when(F.col("agent"), "agent_approved")
        .otherwise("human")
        .alias("status"),
    )
