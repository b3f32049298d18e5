"""Replay evaluation of answering agents, shadow trials, and marketplace evidence."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.quantiles import exact_quantiles
from plumbline.operators.recall import diff

# Promotion gate (fixed values).
MAX_DIVERGENCE = 0.01
MAX_COST_INCREASE_PCT = 10.0
ENTITLED_ROLES = ("ops_manager", "analyst", "ops_director", "data_engineer", "admin")
LEASE_DAYS = 90


def benchmark(
    users: DataFrame,
    feeders: DataFrame,
    metrics: list[str],
    dimensions: list[str],
    filter_metric: str,
    windows: tuple[str, str] = ("last_month", "last_3_months"),
    exempt: tuple[str, ...] = ("admin", "data_engineer", "ops_director"),
    counted: str = "outage_count",
    count_dimensions: tuple[str, ...] = ("substation_id", "feeder_id", "region"),
) -> DataFrame:
    """Question and gold plan per user: (user_id, text, metric, dimension, filter, time_window).

    Every metric by every dimension over both windows, every metric for each substation in the user's
    scope, how many outages by each count dimension, and the filter metric for each feeder in scope. Metric and dimension lists are configuration and
    travel as literal arrays; the scope is an equi-join on region.
    """
    who = users.select("user_id", F.when(F.col("role").isin(*exempt), F.lit("ALL")).otherwise(F.coalesce("region", F.lit("NONE"))).alias("scope"))
    none = F.lit(None).cast("string")

    def literal(values: list[str] | tuple[str, ...]) -> F.Column:
        return F.array(*[F.lit(v) for v in values])

    grouped = (
        who.withColumn("metric", F.explode(literal(metrics)))
        .withColumn("dimension", F.explode(literal(dimensions)))
        .withColumn("time_window", F.explode(literal(windows)))
        .select("user_id", "metric", "dimension", none.alias("filter"), "time_window")
    )
    places = feeders.select(F.explode(F.array("region", F.lit("ALL"))).alias("scope"), "substation_id", "feeder_id")
    substations = places.select("scope", "substation_id").distinct()
    by_station = (
        who.join(substations, "scope")
        .withColumn("metric", F.explode(literal(metrics)))
        .select("user_id", "metric", none.alias("dimension"), F.concat(F.lit("substation_id="), "substation_id").alias("filter"), F.lit(windows[0]).alias("time_window"))
    )
    counts = who.withColumn("dimension", F.explode(literal(count_dimensions))).select(
        "user_id", F.lit(counted).alias("metric"), "dimension", none.alias("filter"), F.lit(windows[0]).alias("time_window")
    )
    by_feeder = who.join(places.select("scope", "feeder_id").distinct(), "scope").select(
        "user_id",
        F.lit(filter_metric).alias("metric"),
        F.lit("read_date").alias("dimension"),
        F.concat(F.lit("feeder_id="), F.col("feeder_id").cast("string")).alias("filter"),
        F.lit("last_week").alias("time_window"),
    )
    text = F.concat_ws(" ", F.col("metric"), F.concat(F.lit("by "), "dimension"), F.concat(F.lit("for "), "filter"), F.replace("time_window", F.lit("_"), F.lit(" ")))
    return grouped.unionByName(by_station).unionByName(counts).unionByName(by_feeder).withColumn("text", text)


def accuracy(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """(agent, n, correct, accuracy, avg_cost, touched): replayed answers against the ground-truth hashes.

    answers(agent, question_id, result_hash, cost, product); truth(question_id, ground_truth_hash).
    """
    right = F.col("result_hash").eqNullSafe(F.col("ground_truth_hash"))
    judged = truth.join(answers, "question_id")
    # products are counted per agent first, so the distinct list is of product size, not of answer size
    per = judged.groupBy("agent", "product").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(right).alias("correct"), F.sum("cost").alias("cost")
    )
    return per.groupBy("agent").agg(
        F.sum("n").alias("n"),
        F.sum("correct").alias("correct"),
        F.round(F.sum("correct") / F.sum("n"), 6).alias("accuracy"),
        F.round(F.sum("cost") / F.sum("n"), 6).alias("avg_cost"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("correct") > 0, F.col("product"))))).alias("touched"),
    )


def p95_latency(answers: DataFrame, latency: str = "latency") -> float | None:
    """Exact, linearly interpolated. Large columns take several passes, so pass stored answers."""
    value = exact_quantiles(answers, [latency], [0.95])[latency, 0.95]
    return None if value is None else round(value, 4)


def traffic(replay: DataFrame, live: DataFrame, exported: DataFrame) -> DataFrame:
    """Questions a trial answers: the replay set, then live ones never exported, once per asker and text.

    replay(question_id, asked_by, text); live also asked_at; exported(question_id).
    """
    kept = live.join(exported, "question_id", "left_anti").select("question_id", "asked_by", "text", F.lit(1).alias("o"), "asked_at")
    both = replay.select("question_id", "asked_by", "text", F.lit(0).alias("o"), F.lit(None).cast("timestamp").alias("asked_at")).unionByName(kept)
    return both.groupBy("asked_by", "text").agg(F.min_by("question_id", F.struct("o", "asked_at", "question_id")).alias("question_id"))


def trial_divergence(outcomes: DataFrame, incumbent: DataFrame, candidate: DataFrame) -> DataFrame:
    """(question_id, divergence) of two agents' answers.

    outcomes(question_id, inc_outcome, cand_outcome, same_shape); cells(question_id, key, metric, value).
    0 when both gave the same rows or neither answered; 1 when only one answered or the shapes differ;
    else the larger of the row ratio and the largest relative change.
    """
    changes = diff(incumbent, candidate, ["question_id"]).groupBy("question_id").agg(F.max("pct").alias("pct"))

    def rows(cells: DataFrame, name: str) -> DataFrame:
        return cells.groupBy("question_id", "key").agg(F.lit(1).alias("r")).groupBy("question_id").agg(F.count("r").alias(name))

    ratio = F.when(F.coalesce("ni", F.lit(0)) > 0, F.abs(1 - F.coalesce("nc", F.lit(0)) / F.col("ni"))).otherwise(1.0)
    inc, cand = F.col("inc_outcome") == "answered", F.col("cand_outcome") == "answered"
    value = (
        F.when(~inc & ~cand, 0.0)
        .when(inc != cand, 1.0)
        .when(F.col("pct").isNull() & F.col("same_shape"), 0.0)
        .when(~F.col("same_shape"), 1.0)
        .otherwise(F.greatest(ratio, F.col("pct") / 100))
    )
    joined = outcomes.join(changes, "question_id", "left").join(rows(incumbent, "ni"), "question_id", "left").join(rows(candidate, "nc"), "question_id", "left")
    return joined.select(*outcomes.columns, value.alias("divergence"))


def trial_summary(results: DataFrame) -> DataFrame:
    """One row: divergent questions, new capability, regressions, cost change, and whether the gate passes.

    results(question_id, inc_outcome, cand_outcome, divergence, inc_cost, cand_cost).
    """
    d, inc = F.col("divergence") > 0, F.col("inc_outcome") == "answered"
    row = results.agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if(d).alias("divergent"),
        F.count_if(d & ~inc & (F.col("cand_outcome") == "answered")).alias("new_capability"),
        F.count_if(d & inc).alias("regressions"),
        F.count_if(inc).alias("_both"),
        F.coalesce(F.avg("inc_cost"), F.lit(0.0)).alias("_ic"),
        F.coalesce(F.avg("cand_cost"), F.lit(0.0)).alias("_cc"),
    )
    share = F.coalesce(F.try_divide("regressions", "_both"), F.lit(0.0))
    change = F.coalesce(F.try_divide(F.col("_cc") - F.col("_ic"), F.col("_ic")) * 100, F.lit(0.0))
    return row.select(
        "questions",
        "divergent",
        F.round(F.coalesce(F.try_divide(F.col("divergent") * 100, F.col("questions")), F.lit(0.0)), 2).alias("divergent_pct"),
        "new_capability",
        "regressions",
        F.round(share, 6).alias("regression_share"),
        F.round("_ic", 6).alias("incumbent_cost"),
        F.round("_cc", 6).alias("candidate_cost"),
        F.round(change, 2).alias("cost_change_pct"),
        ((share <= MAX_DIVERGENCE) & (change <= MAX_COST_INCREASE_PCT)).alias("passed"),
    )


def evidence(status: DataFrame, verdicts: DataFrame, demand: DataFrame, credits: DataFrame, subscribers: DataFrame) -> DataFrame:
    """What the marketplace shows per product: verdict, freshness, quality, demand, credits, subscribers."""
    return (
        status.select("product", "age_hours", "fresh", "quality_score", "criticality")
        .join(verdicts.select("product", "verdict"), "product", "left")
        .join(demand.select("product", "demand_score"), "product", "left")
        .join(credits.select("product", F.col("credits").alias("sla_credits_30d")), "product", "left")
        .join(subscribers.groupBy("product").agg(F.count_if(F.col("status") == "active").alias("subscribers")), "product", "left")
        .fillna({"sla_credits_30d": 0.0, "subscribers": 0})
    )


def bundles(subscriptions: DataFrame, required: DataFrame, published: DataFrame, usage: DataFrame) -> DataFrame:
    """(bundle_id, principal, status, missing, leases, credits_used, runs_used) per subscription.

    subscriptions(bundle_id, listing_id, principal, role); required(listing_id, product); usage(bundle_id,
    credits). Pending while any required product is unpublished or the role is not entitled; only active
    bundles hold leases, one per product.
    """
    have = published.select("product", F.lit(True).alias("_have")).distinct()
    # whether a listing is complete does not depend on who subscribes
    listing = (
        required.distinct()
        .join(have, "product", "left")
        .groupBy("listing_id")
        .agg(F.count(F.lit(1)).alias("products"), F.count_if(F.col("_have").isNull()).alias("absent"))
    )
    used = usage.groupBy("bundle_id").agg(F.sum("credits").alias("credits_used"), F.count(F.lit(1)).alias("runs_used"))
    missing = F.col("absent") + F.when(F.col("role").isin(*ENTITLED_ROLES), 0).otherwise(F.col("products"))
    return (
        subscriptions.join(listing, "listing_id")
        .join(used, "bundle_id", "left")
        .select(
            "bundle_id",
            "principal",
            F.when(missing > 0, "pending_approval").otherwise("active").alias("status"),
            missing.alias("missing"),
            F.when(missing > 0, 0).otherwise(F.col("products")).alias("leases"),
            F.round(F.coalesce("credits_used", F.lit(0.0)), 4).alias("credits_used"),
            F.coalesce("runs_used", F.lit(0)).alias("runs_used"),
        )
    )


def leases(subscriptions: DataFrame, required: DataFrame, scopes: DataFrame, bundle: DataFrame, at: datetime) -> DataFrame:
    """One lease per product of each active bundle, with the row filter of its principal and its expiry."""
    active = bundle.where("status = 'active'").select("bundle_id")
    held = subscriptions.join(active, "bundle_id", "left_semi").join(required.distinct(), "listing_id")
    return held.join(scopes.select(F.col("user_id").alias("principal"), "row_filter"), "principal", "left").select(
        "bundle_id", "principal", "product", "row_filter", F.date_add(F.lit(at).cast("date"), LEASE_DAYS).alias("expires_on")
    )
