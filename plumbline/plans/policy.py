"""Row filters, column masks and tracer exclusion, applied at the product scan."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRACER_PREFIX = "SNTL-"
# Roles that see every row (fixed values).
UNRESTRICTED = ("admin", "data_engineer", "ops_director")


@dataclass(frozen=True)
class Principal:
    user_id: str
    role: str
    region: str | None = None
    attributes: dict[str, str | None] = field(default_factory=dict)

    def value(self, attribute: str) -> str | None:
        return self.region if attribute == "region" else self.attributes.get(attribute)


@dataclass(frozen=True)
class Policy:
    policy_id: str
    target: str
    kind: str  # row_filter or column_mask
    expression: str  # a predicate with :user.<attribute>, or the mask as SQL text
    attribute: str | None = None
    column: str | None = None
    classification: str | None = None
    exempt_roles: tuple[str, ...] = UNRESTRICTED


@dataclass(frozen=True)
class Decision:
    policy_id: str
    kind: str
    target: str
    applied: bool
    predicate: str | None
    sentence: str


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def decide(policy: Policy, who: Principal) -> Decision:
    exempt = who.role in policy.exempt_roles
    applied, predicate = not exempt, None if exempt else policy.expression
    if policy.kind == "column_mask":
        how = "shown unmasked to" if exempt else f"masked ({policy.classification}) for"
        sentence = f"{policy.column} {how} {who.user_id}"
    elif exempt:
        sentence = f"No row filter for {who.user_id} (role {who.role} sees all {policy.attribute}s)"
    else:
        value = who.value(str(policy.attribute))
        if value is None:
            predicate, sentence = "FALSE", f"No rows for {who.user_id}: no {policy.attribute} assigned"
        else:
            predicate = policy.expression.replace(f":user.{policy.attribute}", quoted(value))
            sentence = f"Filtered to {policy.attribute} {value} for {who.user_id}"
    return Decision(policy.policy_id, policy.kind, policy.target, applied, predicate, sentence)


def without_tracers(df: DataFrame, key: str) -> DataFrame:
    return df.where(~F.col(key).startswith(TRACER_PREFIX))


def apply_policies(
    df: DataFrame, target: str, policies: Iterable[Policy], who: Principal, tracer_key: str | None = None
) -> DataFrame:
    """`df` as `who` may see it. Masks replace the column itself, so nothing above the scan can read it."""
    mine = [(p, decide(p, who)) for p in policies if p.target == target]
    for p, d in mine:
        if p.kind == "row_filter" and d.applied:
            df = df.where(F.expr(str(d.predicate)))
    if tracer_key:
        df = without_tracers(df, tracer_key)
    for p, d in mine:
        if p.kind == "column_mask" and d.applied:
            df = df.withColumn(str(p.column), F.expr(p.expression))
    return df


def _as_struct(p: Policy) -> Column:
    def text(v: Any) -> Column:
        return F.lit(v).cast("string")

    return F.struct(
        text(p.policy_id).alias("policy_id"),
        text(p.kind).alias("kind"),
        text(p.target).alias("target"),
        text(p.expression).alias("expression"),
        text(p.attribute).alias("attribute"),
        text(p.column).alias("column"),
        text(p.classification).alias("classification"),
        F.array(*[F.lit(r) for r in p.exempt_roles]).cast("array<string>").alias("exempt_roles"),
    )


def decisions(users: DataFrame, policies: list[Policy]) -> DataFrame:
    """One row per user and policy. The policy list is configuration, so it travels as a literal array.

    A row filter is filled from the users' column of its own attribute; a column that is missing counts as null."""
    p = F.col("_p")
    row_filter = p["kind"] == "row_filter"
    exempt = F.array_contains(p["exempt_roles"], F.col("role"))
    value, who = F.lit(None).cast("string"), F.col("user_id").cast("string")
    for a in sorted({x.attribute for x in policies if x.attribute in users.columns}):
        value = F.when(p["attribute"] == a, F.col(a).cast("string")).otherwise(value)
    safe = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))  # as `quoted`
    filled = F.replace(p["expression"], F.concat(F.lit(":user."), p["attribute"]), F.concat(F.lit("'"), safe, F.lit("'")))
    predicate = F.when(exempt, None).when(~row_filter, p["expression"]).when(value.isNull(), "FALSE").otherwise(filled)
    sentence = (
        F.when(~row_filter & exempt, F.concat_ws(" ", p["column"], F.lit("shown unmasked to"), who))
        .when(~row_filter, F.concat(p["column"], F.lit(" masked ("), p["classification"], F.lit(") for "), who))
        .when(exempt, F.concat(F.lit("No row filter for "), who, F.lit(" (role "), "role", F.lit(" sees all "), p["attribute"], F.lit("s)")))
        .when(value.isNull(), F.concat(F.lit("No rows for "), who, F.lit(": no "), p["attribute"], F.lit(" assigned")))
        .otherwise(F.concat(F.lit("Filtered to "), p["attribute"], F.lit(" "), value, F.lit(" for "), who))
    )
    return users.withColumn("_p", F.explode(F.array(*[_as_struct(x) for x in policies]))).select(
        "user_id",
        p["policy_id"].alias("policy_id"),
        p["kind"].alias("kind"),
        p["target"].alias("target"),
        (~exempt).alias("applied"),
        predicate.alias("predicate"),
        sentence.alias("sentence"),
    )


def entitlements(users: DataFrame, policies: list[Policy]) -> DataFrame:
    """Read scope per (user, product): the row filter text, or none for exempt roles."""
    filters = [p for p in policies if p.kind == "row_filter"]
    return decisions(users, filters).select(
        "user_id", F.col("target").alias("product"), F.lit(True).alias("can_read"), F.col("predicate").alias("row_filter")
    )


class KeyIsPersonal(ValueError):
    pass


def drop_personal(df: DataFrame, personal: set[str], keys: Iterable[str], masked: Iterable[str] = ()) -> tuple[DataFrame, list[str]]:
    """Drop personal columns no mask covers; a key must not be one of them."""
    drop = [c for c in df.columns if c in personal and c not in set(masked)]
    if set(keys) & set(drop):
        raise KeyIsPersonal(f"personal columns {sorted(set(keys) & set(drop))} cannot be keys")
    return df.drop(*drop), drop
