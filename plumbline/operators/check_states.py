"""Contract checks as states that add up, so that a table that grows is checked by reading what is new.

The state of some rows is what their tests need and no more: counts of rows, nulls and violations, how often each primary key
occurs, and how often each foreign key is used. States of parts are merged by addition into the state of the whole, whose results
are those of `quality.check` on all rows. States are stored next to each other, a folder a part; replacing a part replaces its folder.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.quality import _lost_rows, _outcomes, _row_tests
from plumbline.plans.contracts import Contract


@dataclass(frozen=True)
class State:
    """totals: one row of counts; keys: (key columns, n); children: by foreign-key column, (_key, n)."""

    totals: DataFrame
    keys: DataFrame | None
    children: dict[str, DataFrame]


def _tested(like: DataFrame, contract: Contract):
    tests = [(f"t{i}", name, c) for i, (name, _, c, _) in enumerate(_row_tests(like, contract)) if c is not None]
    return [t for t in tests if not t[1].startswith("unique.")], next((t[0] for t in tests if t[1].startswith("unique.")), None)


def _n():
    return F.count(F.lit(1)).alias("n")


def state_of(df: DataFrame, contract: Contract) -> State:
    counted, unique = _tested(df, contract)
    used = [k.column for k in contract.foreign_keys if k.column in df.columns]
    return State(
        df.agg(_n(), *[c.alias(t) for t, _, c in counted]),
        df.groupBy(*contract.primary_key).agg(_n()) if unique else None,
        {c: df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_key")).agg(_n()) for c in used},
    )


def _added(frames: list[DataFrame]) -> DataFrame:
    every = reduce(DataFrame.unionByName, frames)
    by = [c for c in every.columns if c != "n"]
    return every.groupBy(*by).agg(F.sum("n").alias("n"))


def merge(states: list[State]) -> State:
    """The state of all rows together; merging is free of order and grouping."""
    totals = reduce(DataFrame.unionByName, [s.totals for s in states])
    keys = [s.keys for s in states if s.keys is not None]
    return State(
        totals.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in totals.columns]),
        _added(keys) if keys else None,
        {c: _added([s.children[c] for s in states]) for c in states[0].children},
    )


def results(state: State, like: DataFrame, contract: Contract, parents: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Rows as of `quality.check`; `like` is any frame with the table's schema, which is not read."""
    row, (_, unique) = state.totals, _tested(like, contract)
    if unique:  # every further row of a key is a duplicate
        twice = state.keys.where("n > 1").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(unique))
        row = row.withColumn(unique, twice.scalar())
    out = _outcomes(row, like, contract)
    for k in contract.foreign_keys if parents is not None else ():
        lost = None
        if k.parent in parents and k.column in state.children and k.parent_column in parents[k.parent].columns:
            parent = parents[k.parent].select(F.col(k.parent_column).alias("_key"))
            lost = state.children[k.column].join(parent, "_key", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
        out = out.unionByName(_lost_rows(like, f"fk.{k.column}", lost))
    return out


def store(state: State, path: str, part: str) -> None:
    """Write one part's state under `path`; storing a part again replaces it."""
    frames = {"totals": state.totals, "keys": state.keys} | {f"fk_{c}": f for c, f in state.children.items()}
    for name, df in frames.items():
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}/part={part}")


def load(spark: SparkSession, path: str, like: DataFrame, contract: Contract) -> State:
    """The merged state of all stored parts."""
    def read(name: str) -> DataFrame:
        return spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}").drop("part")

    used = [k.column for k in contract.foreign_keys if k.column in like.columns]
    _, unique = _tested(like, contract)
    return merge([State(read("totals"), read("keys") if unique else None, {c: read(f"fk_{c}") for c in used})])
