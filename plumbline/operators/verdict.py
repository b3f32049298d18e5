"""Trust verdicts of answers and products, and service credits."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Outcomes from best to worst (fixed values).
OUTCOMES = ("release", "release_with_warning", "block")
RELEASE, WARN, BLOCK = OUTCOMES
BLOCK_BELOW, WARN_BELOW = 0.7, 0.9
CRITICAL = 4
DEFAULT_CRITICALITY = 2
NOT_REVIEWED = "auto-gate"
NEVER_HOURS = 1e9


def outcome_name(severity: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in OUTCOMES]), severity.cast("int") + 1)


def freshness(products: DataFrame, as_of: datetime) -> DataFrame:
    """Adds age_hours and fresh; a held product is never fresh, whatever its age."""
    hours = (F.unix_timestamp(F.lit(as_of)) - F.unix_timestamp("last_refreshed_at")) / 3600
    age = F.coalesce(hours, F.lit(NEVER_HOURS))
    return products.withColumns(
        {
            "age_hours": F.round(age, 2),
            "fresh": (age <= F.coalesce("sla_hours", F.lit(24.0))) & (F.col("refresh_status") != "held"),
        }
    )


def _fired(when: Column, rule: int, severity: Column, reason: Column) -> Column:
    return F.when(when, F.struct(F.lit(rule).alias("rule"), severity.alias("severity"), reason.alias("reason")))


def _product_rules(status: DataFrame, artifacts: DataFrame) -> DataFrame:
    """What a product brings to every certificate that saw it: (product, rule, severity, reason); rule 0 marks a critical one."""
    quality = F.when(F.col("quality_score") < BLOCK_BELOW, 2).when(F.col("quality_score") < WARN_BELOW, 1).otherwise(0)
    floor = F.when(F.col("quality_score") < BLOCK_BELOW, str(BLOCK_BELOW)).otherwise(str(WARN_BELOW))
    product = F.col("product").cast("string")
    late = F.concat(product, F.lit(" last loaded "), F.col("age_hours").cast("string"), F.lit("h ago"))
    critical = F.coalesce("criticality", F.lit(DEFAULT_CRITICALITY)) >= CRITICAL
    fired = F.array(
        _fired(~F.col("fresh"), 2, F.lit(1), late),
        _fired(quality > 0, 3, quality, F.concat(product, F.lit(" quality below "), floor)),
        _fired(critical, 0, F.lit(0), F.lit(None).cast("string")),
    )
    open_work = artifacts.where(F.col("is_agent") & (F.col("approved_by").isNull() | (F.col("approved_by") == NOT_REVIEWED)))
    reason = F.concat(F.lit("unapproved artifact "), F.col("artifact_id").cast("string"), F.lit(" by "), "agent")
    return status.select("product", F.inline(F.array_compact(fired))).unionByName(
        open_work.select("product", F.lit(4).alias("rule"), F.lit(2).alias("severity"), reason.alias("reason"))
    )


def rule_trace(metrics: DataFrame, cert_products: DataFrame, status: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Every rule that fires: (cert_id, rule, severity, reason).

    metrics(cert_id, name, certified); cert_products(cert_id, product); status: products with freshness,
    quality_score and criticality; artifacts(product, artifact_id, agent, approved_by, is_agent): the
    latest artifact of each product on the path.
    """
    uncertified = metrics.where(~F.col("certified")).select(
        "cert_id",
        F.lit(1).alias("rule"),
        F.lit(1).alias("severity"),
        F.concat(F.lit("metric "), "name", F.lit(" is not certified")).alias("reason"),
    )
    seen = cert_products.join(_product_rules(status, artifacts), "product").select("cert_id", "rule", "severity", "reason")
    critical = seen.where("rule = 0").select("cert_id").distinct()
    held = seen.where("rule = 4").join(critical, "cert_id", "left_semi")
    return uncertified.unionByName(seen.where("rule in (2, 3)")).unionByName(held)


def verdicts(certs: DataFrame, metrics: DataFrame, cert_products: DataFrame, status: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Worst outcome per certificate, by the rules of `rule_trace`; certificates no rule fired for are released.

    A product's rules are summed up before they meet the certificates, so these are joined once and bring a few numbers each. Few
    certificates repeat within a task of that join, so they are grouped only after the shuffle; the join hashes the products, one
    row each, so that the certificates' side is not sorted.
    """
    rule, none = F.col("rule"), F.lit(0)
    sums = {
        "fired": F.count_if(rule.isin(2, 3)),
        "severity": F.max(F.when(rule != 4, F.col("severity"))),
        "critical": F.max((rule == 0).cast("int")),
        "held": F.count_if(rule == 4),
    }
    per_product = _product_rules(status, artifacts).groupBy("product").agg(*[v.alias(k) for k, v in sums.items()])
    seen = cert_products.join(per_product.hint("shuffle_hash"), "product").select("cert_id", *sums)
    uncertified = metrics.where(~F.col("certified")).select(
        "cert_id", F.lit(1).cast("long").alias("fired"), F.lit(1).alias("severity"), none.alias("critical"), none.cast("long").alias("held")
    )
    worst = seen.unionByName(uncertified).repartition("cert_id").groupBy("cert_id").agg(
        F.sum("fired").alias("fired"), F.max("severity").alias("severity"), (F.max("critical") * F.sum("held")).alias("held")
    )
    severity = F.when(F.col("held") > 0, 2).otherwise(F.coalesce("severity", none))
    return certs.select("cert_id").join(worst, "cert_id", "left").select(
        "cert_id", outcome_name(severity).alias("verdict"), F.coalesce(F.col("fired") + F.col("held"), none).alias("rules_fired")
    )


def unapproved_share(nodes: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Share of a certificate's lineage nodes (cert_id, product) on products with an unapproved agent artifact."""
    open_ = artifacts.where(F.col("is_agent") & F.col("approved_by").isNull()).select("product", F.lit(1.0).alias("open")).distinct()
    per_product = nodes.groupBy("cert_id", "product").agg(F.count(F.lit(1)).alias("n"))
    share = F.sum(F.coalesce("open", F.lit(0.0)) * F.col("n")) / F.sum("n")
    return per_product.join(open_, "product", "left").groupBy("cert_id").agg(F.round(share, 4).alias("agent_share_unapproved"))


def assess(status: DataFrame, metrics: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Verdict of each product on its own, by the same rules."""
    own = status.select(F.col("product").alias("cert_id"), "product")
    metrics = metrics.select(F.col("product").alias("cert_id"), "name", "certified")
    return verdicts(own, metrics, own, status, artifacts).withColumnRenamed("cert_id", "product")


def bundle_worst(bundles: DataFrame, product_verdicts: DataFrame) -> DataFrame:
    """Worst verdict of a bundle(bundle, product); a product without one counts as a warning."""
    severity = F.array_position(F.array(*[F.lit(o) for o in OUTCOMES]), F.col("verdict")) - 1
    known = product_verdicts.select("product", severity.alias("severity"))
    return bundles.join(known, "product", "left").groupBy("bundle").agg(
        outcome_name(F.max(F.coalesce("severity", F.lit(1)))).alias("verdict"), F.count_if(F.col("severity").isNull()).alias("unavailable")
    )


def breaches(certs: DataFrame, cert_products: DataFrame, status: DataFrame, recorded: DataFrame | None = None) -> DataFrame:
    """New service-credit entries: one per (product, kind, episode), charged to the first certificate that met it.

    The episode of a freshness breach is the reason it is held, else its last load; of a quality breach,
    its failing tests. certs(cert_id, asked_by, issued_at); status needs credits; recorded(dedupe_key).
    """
    last = F.date_format("last_refreshed_at", "yyyy-MM-dd'T'HH:mm:ss")
    held = F.when(F.col("refresh_status") == "held", F.col("held_reason"))
    kinds = F.array_compact(
        F.array(
            F.when(~F.col("fresh"), F.struct(F.lit("freshness").alias("kind"), F.coalesce(held, last, F.lit("never")).alias("episode"))),
            F.when(F.col("quality_score") < WARN_BELOW, F.struct(F.lit("quality").alias("kind"), F.col("failing_tests").alias("episode"))),
        )
    )
    bad = status.where(F.col("credits") > 0).select("product", "credits", F.inline(kinds))
    bad = bad.withColumn("dedupe_key", F.concat_ws("|", F.col("product").cast("string"), "kind", "episode"))
    if recorded is not None:
        bad = bad.join(recorded.select("dedupe_key"), "dedupe_key", "left_anti")
    # the first certificate per product does not depend on the breach, so it is found before joining
    first = (
        cert_products.join(certs, "cert_id")
        .groupBy("product")
        .agg(F.min_by(F.struct("cert_id", "asked_by"), F.struct("issued_at", "cert_id")).alias("c"))
    )
    return bad.join(first, "product").select("dedupe_key", "product", "kind", "credits", "c.cert_id", F.col("c.asked_by").alias("consumer"))


def credits_since(ledger: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    recent = ledger.where(F.col("settled_at") >= F.lit(as_of) - F.make_interval(days=F.lit(days)))
    return recent.groupBy("product").agg(F.sum("credits").alias("credits"))
