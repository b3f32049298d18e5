"""Data products: functions of a dict of source frames.

Sources: feeders(feeder_id, substation_id, region), meters(meter_id, feeder_id, ...),
outages(outage_id, feeder_id, start_ts, end_ts, cause_code, customers_affected) and
reads(meter_id, read_ts, kwh_delivered, kwh_received), unique per (meter_id, read_ts).
Running a product on other inputs means passing other frames.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.times import minutes_between, period
from plumbline.operators.intervals import interval_join, meeting_slots
from plumbline.operators.joins import split_join
from plumbline.operators.sweep import next_point

Sources = Mapping[str, DataFrame]
Product = Callable[[Sources], DataFrame]

LONG_OUTAGE_MINUTES = 240
#: Outages that a row of `outage_sets` lists.
OUTAGES_A_ROW = 1024
# Cause code to category (fixed values).
CAUSE_CATEGORY = {
    "WEATHER": "environmental",
    "VEGETATION": "environmental",
    "EQUIPMENT": "equipment",
    "ANIMAL": "wildlife",
    "PLANNED": "planned",
}


def consumption_daily(src: Sources) -> DataFrame:
    """Energy per meter and day. Reads shrink to one row per meter-day before any join."""
    daily = (
        src["reads"]
        .groupBy(F.to_date("read_ts").alias("read_date"), "meter_id")
        .agg(
            F.sum("kwh_delivered").alias("kwh_delivered"),
            F.sum("kwh_received").alias("kwh_received"),
            F.count(F.lit(1)).alias("read_count"),
        )
    )
    located = src["meters"].select("meter_id", "feeder_id").join(
        src["feeders"].select("feeder_id", "region"), "feeder_id"
    )
    return daily.join(located, "meter_id").select(
        "read_date", "meter_id", "feeder_id", "region", "kwh_delivered", "kwh_received", "read_count"
    )


def customers_served(src: Sources) -> DataFrame:
    return src["meters"].groupBy("feeder_id").agg(F.count(F.lit(1)).alias("customers_served"))


def period_spine(src: Sources, grain: str = "month") -> DataFrame:
    return src["outages"].select(period(F.col("start_ts"), grain).alias(grain)).distinct()


def feeder_slots(src: Sources) -> DataFrame:
    """Meters reporting usage per feeder and read time.

    Which meters are on depends on feeder and time only, so this is counted once, not once per outage.
    """
    return (
        src["reads"]
        .join(src["meters"].select("meter_id", "feeder_id"), "meter_id")
        .groupBy("feeder_id", "read_ts")
        .agg(F.count_if(F.col("kwh_delivered") > 0).alias("meters_on"))
    )


def interval_status(src: Sources) -> DataFrame:
    windows = src["outages"].select("outage_id", "feeder_id", "start_ts", "end_ts")
    return interval_join(windows, feeder_slots(src), ["feeder_id"], "start_ts", "end_ts", "read_ts").select(
        "outage_id", "read_ts", "meters_on"
    )


def verified_restoration(src: Sources, share: float = 0.5) -> DataFrame:
    """Outage end: first read time with at least `share` of the feeder's meters on, else the reported end."""
    served = customers_served(src)
    # the read time is kept only where the feeder counts as restored, so its lineage includes the usage read
    recovered = (
        feeder_slots(src)
        .join(served, "feeder_id")
        .select("feeder_id", F.when(F.col("meters_on") >= share * F.col("customers_served"), F.col("read_ts")).alias("on_ts"))
        .where(F.col("on_ts").isNotNull())
    )
    known = src["outages"].join(served.select("feeder_id"), "feeder_id", "left_semi")
    swept = next_point(known, recovered, ["feeder_id"], "start_ts", "on_ts", "next_on_ts")
    return swept.select(
        "outage_id",
        "feeder_id",
        "start_ts",
        "customers_affected",
        "cause_code",
        F.when(F.col("next_on_ts") < F.col("end_ts"), F.col("next_on_ts")).otherwise(F.col("end_ts")).alias("restored_ts"),
    )


def outage_totals(src: Sources, grain: str = "month", share: float = 0.5) -> DataFrame:
    v = verified_restoration(src, share).withColumn("minutes", minutes_between(F.col("start_ts"), F.col("restored_ts")))
    return v.groupBy("feeder_id", period(F.col("start_ts"), grain).alias(grain)).agg(
        F.count(F.lit(1)).alias("outage_count"),
        F.count_if(F.col("minutes") > LONG_OUTAGE_MINUTES).alias("outage_count_over_4h"),
        F.sum("customers_affected").alias("customer_interruptions"),
        F.sum(F.col("customers_affected") * F.col("minutes")).alias("customer_minutes_interrupted"),
    )


def _indices(src: Sources, totals: DataFrame, grain: str) -> DataFrame:
    """Every feeder with meters in every period, with the three reliability ratios.

    The spine is a calendar, bounded by the time covered and not by the rows, so it is exploded from a
    scalar subquery rather than joined.
    """
    calendar = period_spine(src, grain).agg(F.array_sort(F.collect_set(grain))).scalar()
    spine = (
        src["feeders"]
        .select("feeder_id", "substation_id", "region")
        .join(customers_served(src), "feeder_id")
        .withColumn(grain, F.explode(calendar))
    )
    zero = F.lit(0)
    minutes = F.coalesce("customer_minutes_interrupted", zero)
    interruptions = F.coalesce("customer_interruptions", zero)
    return (
        spine.join(totals, ["feeder_id", grain], "left")
        .withColumn("saidi", minutes / F.col("customers_served"))
        .withColumn("saifi", interruptions / F.col("customers_served"))
        .withColumn("caidi", minutes / F.nullif(F.col("customer_interruptions"), zero))
        .withColumn("customer_minutes_interrupted", minutes.cast("double"))
        .withColumn("customer_interruptions", interruptions)
        .withColumn("outage_count", F.coalesce("outage_count", zero))
        .withColumn("outage_count_over_4h", F.coalesce("outage_count_over_4h", zero))
    )


RELIABILITY_COLUMNS = [
    "feeder_id",
    "substation_id",
    "region",
    "customers_served",
    "outage_count",
    "outage_count_over_4h",
    "customer_interruptions",
    "customer_minutes_interrupted",
    "saidi",
    "saifi",
    "caidi",
]


def reliability(src: Sources, grain: str = "month", share: float = 0.5) -> DataFrame:
    return _indices(src, outage_totals(src, grain, share), grain).select(grain, *RELIABILITY_COLUMNS)


def dominant_cause(src: Sources, grain: str = "month") -> DataFrame:
    """Most frequent cause per feeder and period; ties go to the alphabetically first."""
    counted = (
        src["outages"]
        .join(customers_served(src).select("feeder_id"), "feeder_id", "left_semi")
        .where(F.col("cause_code").isNotNull())
        .groupBy("feeder_id", period(F.col("start_ts"), grain).alias(grain), "cause_code")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.groupBy("feeder_id", grain).agg(
        F.min_by("cause_code", F.struct((-F.col("n")).alias("r"), "cause_code")).alias("dominant_cause")
    )


def reliability_v2(src: Sources, grain: str = "month", share: float = 0.5) -> DataFrame:
    """Second version: `saidi` becomes `saidi_minutes`, plus the category of the dominant cause."""
    category = F.create_map(*[F.lit(x) for kv in CAUSE_CATEGORY.items() for x in kv])
    totals = outage_totals(src, grain, share).join(dominant_cause(src, grain), ["feeder_id", grain], "left")
    return (
        _indices(src, totals, grain)
        .withColumn("cause_category", F.try_element_at(category, F.col("dominant_cause")))
        .select(grain, *RELIABILITY_COLUMNS, "cause_category")
        .withColumnRenamed("saidi", "saidi_minutes")
    )


def exposure(src: Sources, silent: bool = True, sets: DataFrame | None = None, places: int | None = None) -> DataFrame:
    """(meter, outage on its feeder), with the reads inside the outage window; with `silent`, pairs without reads too.

    Pairs are made once, in the last join, and are neither shuffled nor stored. A meter comes to it with its reads near each slot
    of time in which its feeder has outages: rows that grow with the meters, the reads and the time covered. With `sets`, those of
    `outage_sets`, a meter meets a set instead of an outage, its reads are counted and summed once a set (rounded to `places`, if
    given), and the set's outages are listed last.
    """
    windows = src["outages"].select("feeder_id", "start_ts", "end_ts", "outage_id") if sets is None else sets
    windows = windows.join(src["feeders"].select("feeder_id", "region"), "feeder_id")
    reads = src["reads"].select("meter_id", "read_ts", "kwh_delivered")
    windows, reads = meeting_slots(windows, reads, "start_ts", "end_ts", "read_ts")
    # instants stand alone too: how many reads there are does not depend on what they say
    near = reads.groupBy("meter_id", "_level", "_slot").agg(
        F.array_sort(F.collect_list("read_ts")).alias("_at"),
        F.array_sort(F.collect_list(F.struct("read_ts", F.col("kwh_delivered").cast("double").alias("kwh")))).alias("_reads"),
    )
    slots = windows.select("feeder_id", "_level", "_slot").distinct()
    # few meters give many rows here, which tasks merged for the little they read would not share
    meters = split_join(src["meters"].select("meter_id", "feeder_id"), slots, ["feeder_id"], ["meter_id"])
    meters = meters.join(near, ["meter_id", "_level", "_slot"], "left" if silent else "inner")
    # a meter comes once to each slot of its feeder, or at most once if silent ones are left out
    come = slots.join(customers_served(src), "feeder_id").withColumnRenamed("customers_served", "_l")
    pairs = split_join(meters, windows, ["feeder_id", "_level", "_slot"], ["meter_id"], left_counts=come)

    def inside(t: Column) -> Column:
        return (t >= F.col("start_ts")) & (t < F.col("end_ts"))

    n = F.aggregate("_at", F.lit(0), lambda count, t: count + F.when(inside(t), 1).otherwise(0))
    read = F.aggregate("_reads", F.lit(0.0), lambda total, r: total + F.when(inside(r["read_ts"]), F.coalesce(r["kwh"], F.lit(0.0))).otherwise(0.0))
    n, kwh = F.coalesce(n, F.lit(0)), F.coalesce(read, F.lit(0.0))
    members = ["outage_id"] if sets is None else ["_ids", "_starts", "_ends"]
    out = pairs.select("meter_id", *members, "feeder_id", "region", "start_ts", "end_ts", n.alias("n"), kwh.alias("kwh"))
    if not silent:
        out = out.where("n > 0")
    told = F.col("kwh") if places is None else F.round("kwh", places)
    out = out.withColumns({"told": told, "zero": F.col("kwh") == 0})
    if sets is not None:
        out = out.select("*", F.posexplode("_ids").alias("_i", "outage_id")).withColumns({"start_ts": F.col("_starts")[F.col("_i")], "end_ts": F.col("_ends")[F.col("_i")]})
    return out.select(
        "meter_id",
        "outage_id",
        "feeder_id",
        "region",
        F.col("start_ts").alias("outage_start_ts"),
        F.col("end_ts").alias("outage_end_ts"),
        F.col("n").alias("reads_in_window"),
        F.col("told").alias("kwh_in_window"),
        F.col("zero").alias("zero_usage_flag"),
    )


def _between_instants(src: Sources) -> DataFrame:
    """Outages with `_start_ts` and `_end_ts`: where their start and end lie among the instants of their feeder's reads.

    A place is an hour and how many instants of it have passed; a struct is never null, so outages without a start or an end have one too.
    """
    hour = lambda c: F.floor(F.unix_micros(c) / 3_600_000_000)
    instants = src["reads"].select("meter_id", "read_ts").join(src["meters"].select("meter_id", "feeder_id"), "meter_id")
    instants = instants.select("feeder_id", "read_ts").distinct().groupBy("feeder_id", hour("read_ts").alias("_hour")).agg(F.collect_list("read_ts").alias("_at"))

    def passed(c: str) -> Column:
        return F.coalesce(F.array_size(F.filter("_at", lambda t: t < F.col(c))), F.lit(0)).alias("passed")

    placed = src["outages"]
    for c in ("start_ts", "end_ts"):
        placed = placed.withColumn("_hour", hour(c)).join(instants, ["feeder_id", "_hour"], "left")
        placed = placed.withColumn(f"_{c}", F.struct("_hour", passed(c))).drop("_hour", "_at")
    return placed


def alike_outages(src: Sources, apart: Column) -> tuple[DataFrame, DataFrame]:
    """One outage for all those of a feeder that lie between the same instants of its reads: every meter's reads in them are the same.

    Returns these outages (of each set the one of the smallest id), and all outages as (_like, outage_id, start_ts, end_ts) with the
    id of the one that stands for them. Outages with `apart` stand for themselves only. There are as many as feeders and instants
    give, however many outages there are.
    """
    key = F.struct("feeder_id", "_start_ts", "_end_ts", F.when(apart, F.col("outage_id")).alias("own"))
    placed = _between_instants(src).select(*src["outages"].columns, key.alias("_key"))
    sets = placed.groupBy("_key").agg(F.min_by(F.struct(*src["outages"].columns), "outage_id").alias("o"))
    members = placed.join(sets.select("_key", F.col("o.outage_id").alias("_like")), "_key").select("_like", "outage_id", "start_ts", "end_ts")
    return sets.select("o.*"), members


def outage_sets(src: Sources, most: int = OUTAGES_A_ROW) -> DataFrame:
    """Outages of a feeder that lie between the same instants of its reads, as one row for about `most` of them at the most: the window
    of one of them, which holds the same reads of every meter as theirs, and the ids, starts and ends of all.
    """
    key = F.struct("feeder_id", "_start_ts", "_end_ts")
    outages = src["outages"].select("outage_id", "feeder_id", "start_ts", "end_ts")
    placed = _between_instants({**src, "outages": outages}).select("outage_id", "start_ts", "end_ts", key.alias("_key"))
    large = placed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    part = F.pmod(F.xxhash64("outage_id", "start_ts", "end_ts"), F.coalesce(F.ceil(F.col("_n") / most), F.lit(1)))
    rows = placed.join(large, "_key", "left").groupBy("_key", part.alias("_part")).agg(
        F.min(F.struct("start_ts", "end_ts")).alias("w"), F.collect_list(F.struct("outage_id", "start_ts", "end_ts")).alias("o")
    )
    return rows.select("_key.feeder_id", "w.*", F.col("o.outage_id").alias("_ids"), F.col("o.start_ts").alias("_starts"), F.col("o.end_ts").alias("_ends"))


def dashboard(product: DataFrame, current: str, grain: str = "month") -> DataFrame:
    """Board of the current period by region and substation."""
    return (
        product.where(F.col(grain) == F.lit(current).cast("date"))
        .groupBy("region", "substation_id")
        .agg(
            (F.sum("customer_minutes_interrupted") / F.nullif(F.sum("customers_served"), F.lit(0))).alias("saidi_mtd"),
            F.max("saidi").alias("worst_feeder_saidi"),
            F.sum("outage_count").alias("outages"),
        )
        .orderBy("region", "substation_id")
    )
