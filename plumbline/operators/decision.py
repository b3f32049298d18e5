"""Decision thresholds: where a metric stands, and how little it takes to cross."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import rank_in_groups
from plumbline.functions.times import window_bounds
from plumbline.plans.policy import TRACER_PREFIX

MATCH_FLOOR = 0.15

# Totals a threshold metric is made of, and the metrics over them.
PARTS = {
    "minutes": "sum(customer_minutes_interrupted)",
    "interruptions": "sum(customer_interruptions)",
    "served": "sum(customers_served)",
    "avg_served": "avg(customers_served)",
}
WHOLE = ("interruptions", "served")  # whole-number columns
METRICS = {
    "saidi": lambda p: p["minutes"] / F.nullif(p["served"] / p["periods"], F.lit(0)),
    "customers_interrupted": lambda p: p["interruptions"],
}
# One unit of a driver as a synthetic product row (fixed values).
DRIVERS = {
    "outage_count_over_4h": {"interruptions": lambda a: a, "minutes": lambda a: a * 241},
    "customers_affected": {"interruptions": lambda a: F.lit(1.0)},
}


@dataclass(frozen=True)
class Threshold:
    metric: str
    comparator: str  # > >= < <=
    value: float
    driver: str | None = None


def _crossed(t: Threshold, v: Column) -> Column:
    return {">": v > t.value, ">=": v >= t.value, "<": v < t.value, "<=": v <= t.value}[t.comparator]


def _margin(t: Threshold, v: Column) -> Column:
    return F.lit(t.value) - v if t.comparator.startswith(">") else v - F.lit(t.value)


def scope_totals(product: DataFrame, scope: str, as_of: date | datetime, time: str = "month") -> DataFrame:
    """The parts of every metric for each scope value this month, tracers excluded: one aggregate for all."""
    lo, hi = window_bounds("this_month", as_of)
    first = F.lit(str(lo)).cast("date")
    inside = (F.col(time) >= first) & (F.col(time) < F.lit(str(hi)).cast("date"))
    kept = product.where(inside & ~F.col("feeder_id").cast("string").startswith(TRACER_PREFIX))
    return kept.groupBy(F.col(scope).cast("string").alias("scope_value")).agg(
        *[F.expr(e).alias(n) for n, e in PARTS.items()],
        F.count_distinct(time).alias("periods"),
        F.bool_or(F.col(time) == first).alias("has_first"),
    )


def _parts() -> dict[str, Column]:
    return {n: F.col(n) for n in (*PARTS, "periods")}


def _with_row(driver: str, delta: Column, rounded: bool = True) -> dict[str, Column]:
    """Parts after adding one synthetic row of the month worth `delta` driver units; unrounded, they are linear in `delta`."""
    p = _parts()
    for n, unit in DRIVERS[driver].items():
        add = unit(F.coalesce(F.col("avg_served"), F.lit(0.0))) * delta
        p[n] = p[n] + (F.rint(add).cast("bigint") if rounded and n in WHOLE else add)
    p["periods"] = p["periods"] + F.when(F.col("has_first"), 0).otherwise(1)
    return p


def _value(t: Threshold, parts: dict[str, Column]) -> Column:
    return F.coalesce(METRICS[t.metric](parts).cast("double"), F.lit(0.0))


def current(totals: DataFrame, thresholds: list[Threshold]) -> DataFrame:
    """(metric, comparator, threshold, scope_value, current, margin, breached) for every scope value."""
    items = []
    for t in thresholds:
        v = _value(t, _parts())
        items.append(
            F.struct(
                F.lit(t.metric).alias("metric"),
                F.lit(t.comparator).alias("comparator"),
                F.lit(float(t.value)).alias("threshold"),
                F.round(v, 4).alias("current"),
                F.round(_margin(t, v), 4).alias("margin"),
                _crossed(t, v).alias("breached"),
            )
        )
    return totals.select("scope_value", F.inline(F.array(*items)))


def counterfactual(totals: DataFrame, t: Threshold, driver: str, delta: int) -> DataFrame:
    return totals.select("scope_value", _value(t, _with_row(driver, F.lit(delta))).alias("value"))


def sensitivity(totals: DataFrame, t: Threshold) -> DataFrame:
    """(scope_value, flip_delta): smallest whole driver increment that crosses the threshold, for all scopes at once.

    0 if crossed already, null if no increment ever crosses. A metric is linear in the increment but for the rounding of whole
    numbers: the line gives the place, and bisection around it, as wide as rounding can shift it, the exact increment.
    """
    driver = str(t.driver)

    def flips(delta: Column) -> Column:
        return _crossed(t, _value(t, _with_row(driver, delta)))

    def line(delta: int, part: str | None = None) -> Column:
        parts = _with_row(driver, F.lit(delta), rounded=False)
        return (_value(t, parts) if part is None else parts[part]).cast("double")

    up = t.comparator.startswith(">")
    slope = (line(1) - line(0)) * (1 if up else -1)
    place = (F.lit(t.value) - line(0)) * (1 if up else -1) / F.col("_slope")
    # half a unit of a whole-number part is worth this many increments at most
    wide = [F.try_divide(F.lit(1.0), F.abs(line(1, p) - line(0, p))) for p in WHOLE if p in DRIVERS[driver]]
    slack = F.ceil(F.coalesce(F.greatest(F.lit(0.0), *wide), F.lit(0.0))) + 2
    start = F.struct(F.greatest(F.floor("_place") - slack, F.lit(0)).cast("bigint").alias("lo"), (F.ceil("_place") + slack).cast("bigint").alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        inside = s["lo"] + 1 < s["hi"]
        return F.struct(
            F.when(inside & ~flips(mid), mid).otherwise(s["lo"]).alias("lo"), F.when(inside & flips(mid), mid).otherwise(s["hi"]).alias("hi")
        )

    found = F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, halve, lambda s: s["hi"])
    return (
        totals.withColumn("_now", flips(F.lit(0).cast("bigint")))
        .withColumn("_slope", slope)
        .withColumn("_place", F.when(F.col("_slope") > 0, place))
        .select("scope_value", F.when(F.col("_now"), 0).when(F.col("_place").isNotNull(), found).cast("bigint").alias("flip_delta"))
    )


def tightest(standing: DataFrame) -> DataFrame:
    """The scope value with the least margin, per threshold."""
    best = F.min_by(F.struct("scope_value", "current", "margin", "breached"), F.struct("margin", "scope_value")).alias("b")
    return standing.groupBy("metric", "comparator", "threshold").agg(best).select(
        "metric", "comparator", "threshold", "b.scope_value", F.round("b.current", 2).alias("current"), F.round("b.margin", 2).alias("margin"), "b.breached"
    )


def resolve_scope(hints: DataFrame, feeders: DataFrame) -> DataFrame:
    """Region meant by each question: named itself, that of the named substation, then feeder, else the asker's.

    hints(question_id, region_hint, substation_hint, feeder_hint, user_region).
    """
    subs = feeders.groupBy(F.col("substation_id").alias("substation_hint")).agg(F.max("region").alias("_sub"))
    feeds = feeders.groupBy(F.col("feeder_id").alias("feeder_hint")).agg(F.max("region").alias("_feeder"))
    return (
        hints.join(subs, "substation_hint", "left")
        .join(feeds, "feeder_hint", "left")
        .select("question_id", F.coalesce("region_hint", "_sub", "_feeder", "user_region").alias("region"))
    )


def match(questions: DataFrame, examples: DataFrame, cues: list[str], floor: float = MATCH_FLOOR) -> DataFrame:
    """(question_id, decision, similarity) of questions with a decision cue that resemble a pack's examples.

    examples(decision, example_id, text). Similarity is fitted per question on one pack's examples.
    """
    text = F.lower("text")
    cued = questions.where(F.exists(F.array(*[F.lit(c) for c in cues]), lambda c: F.contains(text, c))).select("question_id", text.alias("text"))
    ranked = rank_in_groups(cued, examples.withColumn("text", text), "question_id", "decision", "example_id")
    best = ranked.groupBy("question_id", "decision").agg(F.max("similarity").alias("similarity")).where(F.col("similarity") >= floor)
    return best.select("question_id", "decision", F.round("similarity", 4).alias("similarity"))
