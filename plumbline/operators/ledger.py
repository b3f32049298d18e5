"""Append-only ledger of artifacts: heads, linking, sealing and verification.

Rows: artifact_id, artifact_kind, target_fqn, content_sha256, agent, approved_by, created_at,
prev_artifact_id, content. Each (target, kind) is a chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.hashing import keyed_digest
from plumbline.functions.positions import with_position
from plumbline.operators.graph import reach

CHAIN = ["target_fqn", "artifact_kind"]
ID = "artifact_id"


def heads(ledger: DataFrame) -> DataFrame:
    """Latest row of each chain that no other row names as its predecessor."""
    named = ledger.select(F.col("prev_artifact_id").alias(ID)).where(F.col(ID).isNotNull())
    tips = ledger.join(named, ID, "left_anti")
    rest = [c for c in ledger.columns if c not in CHAIN]
    latest = F.max_by(F.struct(*rest), F.struct("created_at", ID)).alias("_row")
    return tips.groupBy(*CHAIN).agg(latest).select(*CHAIN, "_row.*").select(*ledger.columns)


def link(new: DataFrame, ledger: DataFrame) -> DataFrame:
    """New rows with content hash and predecessor: the row before in the batch, else the chain's head.

    Neighbours are found by global position, so a long chain is not sorted in one task.
    """
    placed = with_position(new.withColumn("content_sha256", F.sha2("content", 256)), [*CHAIN, "created_at", ID])
    before = placed.select((F.col("position") + 1).alias("position"), *CHAIN, F.col(ID).alias("_before"))
    head = heads(ledger).select(*CHAIN, F.col(ID).alias("_head"))
    return (
        placed.join(before, ["position", *CHAIN], "left")
        .join(head, CHAIN, "left")
        .withColumn("prev_artifact_id", F.coalesce("_before", "_head"))
        .drop("position", "_before", "_head")
    )


def problems(ledger: DataFrame) -> DataFrame:
    """(artifact_id, problem) for altered content, bad predecessors, forks and second roots."""
    altered = ledger.where(F.col("content").isNotNull() & (F.sha2("content", 256) != F.col("content_sha256"))).select(
        ID, F.lit("content_mismatch").alias("problem")
    )
    parent = ledger.select(
        F.col(ID).alias("prev_artifact_id"), *[F.col(c).alias(f"p_{c}") for c in CHAIN], F.col("created_at").alias("p_created_at")
    )
    linked = ledger.where(F.col("prev_artifact_id").isNotNull())
    fine = (
        (F.col("p_target_fqn") == F.col("target_fqn"))
        & (F.col("p_artifact_kind") == F.col("artifact_kind"))
        & (F.col("p_created_at") <= F.col("created_at"))
    )
    broken = linked.join(parent, "prev_artifact_id", "left").where(~F.coalesce(fine, F.lit(False))).select(
        ID, F.lit("bad_predecessor").alias("problem")
    )
    return altered.unionByName(broken).unionByName(_all_but_first(linked, ["prev_artifact_id"], "fork")).unionByName(
        _all_but_first(ledger.where(F.col("prev_artifact_id").isNull()), CHAIN, "second_root")
    )


def _all_but_first(rows: DataFrame, group: list[str], problem: str) -> DataFrame:
    """Every row of a group except its earliest; groups of one vanish in the aggregate."""
    first = rows.groupBy(*group).agg(F.min(F.struct("created_at", ID)).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return rows.join(first, group).where(F.col(ID) != F.col(f"_first.{ID}")).select(ID, F.lit(problem).alias("problem"))


SEALED = [ID, "artifact_kind", "target_fqn", "content_sha256", "agent", "approved_by", "created_at", "prev_artifact_id"]


def sealed_text() -> Column:
    def text(c: str) -> Column:
        v = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if c == "created_at" else F.col(c).cast("string")
        return F.concat(F.lit(f"{c}="), F.coalesce(v, F.lit("null")))

    return F.concat_ws("|", *[text(c) for c in SEALED])


def seal(ledger: DataFrame, key: bytes) -> DataFrame:
    return ledger.withColumn("seal", keyed_digest(sealed_text(), key))


def broken_seals(sealed: DataFrame, key: bytes) -> DataFrame:
    return sealed.where(F.col("seal") != keyed_digest(sealed_text(), key)).select(ID)


def chain_behind(ledger: DataFrame, artifacts: DataFrame) -> DataFrame:
    """All rows reached from the given artifacts by following predecessors, with the shortest distance."""
    edges = ledger.where(F.col("prev_artifact_id").isNotNull()).select(F.col(ID).alias("src"), F.col("prev_artifact_id").alias("dst"))
    seen = reach(edges, artifacts.select(F.col(ID).alias("node")), inclusive=True)
    return seen.select(F.col("node").alias(ID), "depth")


def path_artifacts(nodes: DataFrame, ledger: DataFrame) -> DataFrame:
    """Latest model and patch per table on a lineage path."""
    latest = heads(ledger).where(F.col("artifact_kind").isin("model_sql", "patch"))
    return nodes.select(F.col("table").alias("target_fqn")).distinct().join(latest, "target_fqn").select(
        "target_fqn", "artifact_kind", ID, "agent", "approved_by", (~F.col("agent").startswith("human:")).alias("is_agent")
    )
