"""Adapter frames: the engine's inputs derived from the driver's test tables.

Each function reads whole tables; the DuckDB text of the same frames is in `plumbline.queries.base`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import ready

RESTORE_SHARE = 0.1  # reads are sparse in the test tables, so fewer meters prove a restoration


_schemas: dict[str, T.StructType] = {}  # by path, so a table's footer is read for its schema only once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; zone-less timestamps become timestamps in the session's UTC."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = ready(spark).read.parquet(path).schema
    df = ready(spark).read.schema(_schemas[path]).parquet(path)
    return df.select(
        *[
            F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def grid(
    spark: SparkSession, sf_dir: str, text_keys: bool = False, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df
) -> dict[str, DataFrame]:
    """feeders, meters, outages and reads; with `text_keys` all identifiers are strings.

    `keep` (frame, name) may store what is derived from events, for products that use a source several times.
    """
    t = lambda n: table(spark, sf_dir, n)
    events = t("events")
    feeders = (
        t("nation")
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("n_nationkey").alias("feeder_id"), F.col("n_name").alias("substation_id"), F.col("r_name").alias("region")
        )
    )
    active = events.select(F.col("user_id").alias("c_custkey")).distinct()
    meters = (
        t("customer")
        .join(active, "c_custkey", "left_semi")
        .select(
            F.col("c_custkey").alias("meter_id"),
            F.col("c_nationkey").alias("feeder_id"),
            F.col("c_mktsegment").alias("meter_type"),
            F.col("c_name").alias("service_address"),
        )
    )
    meters = keep(meters, "meters")
    on_feeder = meters.groupBy("feeder_id").agg(F.count(F.lit(1)).alias("customers_affected"))
    outages = (
        events.where(F.col("event_type") == "error")
        .join(meters.select(F.col("meter_id").alias("user_id"), "feeder_id"), "user_id")
        .join(on_feeder, "feeder_id")
        .select(
            F.col("event_id").alias("outage_id"),
            "feeder_id",
            F.col("ts").alias("start_ts"),
            (F.col("ts") + F.expr("interval 6 hours")).alias("end_ts"),
            F.when(F.col("value") < 20, "WEATHER").when(F.col("value") < 60, "EQUIPMENT").otherwise("PLANNED").alias("cause_code"),
            "customers_affected",
        )
    )
    view, signup = F.col("event_type") == "view", F.col("event_type") == "signup"
    reads = (
        events.where(F.col("event_type") != "error")
        .groupBy(F.col("user_id").alias("meter_id"), F.date_trunc("hour", "ts").alias("read_ts"))
        .agg(
            F.sum(F.when(view, 0.0).otherwise(F.col("value"))).alias("kwh_delivered"),
            F.sum(F.when(signup, F.col("value")).otherwise(0.0)).alias("kwh_received"),
        )
    )
    out = {"feeders": feeders, "meters": meters, "outages": keep(outages, "outages"), "reads": keep(reads, "reads")}
    if text_keys:
        out = {
            n: df.withColumns({c: F.col(c).cast("string") for c in df.columns if c in ("feeder_id", "meter_id", "outage_id")})
            for n, df in out.items()
        }
    return out


# Market segment to role (fixed values of the test data's adapter).
SEGMENT_ROLE = {
    "AUTOMOBILE": "ops_manager",
    "BUILDING": "analyst",
    "FURNITURE": "data_engineer",
    "HOUSEHOLD": "ops_director",
    "MACHINERY": "admin",
}


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, role, region; region is missing for customers in debt."""
    role = F.create_map(*[F.lit(x) for kv in SEGMENT_ROLE.items() for x in kv])
    feeders = grid(spark, sf_dir)["feeders"].select(F.col("feeder_id").alias("c_nationkey"), "region")
    return (
        table(spark, sf_dir, "customer")
        .join(feeders, "c_nationkey", "left")
        .select(
            F.col("c_custkey").alias("user_id"),
            role[F.col("c_mktsegment")].alias("role"),
            F.when(F.col("c_acctbal") >= 0, F.col("region")).alias("region"),
        )
    )


# Event type to question outcome (fixed values of the test data's adapter).
EVENT_OUTCOME = {
    "view": "answered",
    "purchase": "answered",
    "click": "missing_data",
    "error": "abandoned",
    "signup": "low_confidence",
}


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question log from the event stream; the intent number is the event's `k` property."""
    outcome = F.create_map(*[F.lit(x) for kv in EVENT_OUTCOME.items() for x in kv])
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("question_id"),
        F.col("user_id").alias("asked_by"),
        F.col("ts").alias("asked_at"),
        outcome[F.col("event_type")].alias("outcome"),
        k.alias("topic"),
        F.when(k % 4 == 0, k).alias("intent_id"),
        F.when(k % 5 == 0, F.concat(F.lit("product_"), k)).alias("resolved_by_product"),
        F.when(k % 5 == 0, F.col("ts") + F.make_interval(hours=k)).alias("resolved_at"),
    )


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of the conversations as question texts."""
    return (
        table(spark, sf_dir, "conversations")
        .where(F.col("role") == "user")
        .select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), "text")
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as ledger rows, with damage planted by rule so that every check has hits.

    Damage: altered content every 11th conversation, a skipped predecessor every 13th, a foreign
    predecessor every 17th, a fork every 19th, a second root every 23rd.
    """
    conv, turn = F.col("conv_id"), F.col("turn")
    own = conv * 1000 + turn
    prev = (
        F.when(turn == 0, None)
        .when((turn == 2) & (conv % 13 == 0), own + 500)
        .when((turn == 2) & (conv % 17 == 0), own - 1001)
        .when((turn == 2) & (conv % 19 == 0), own - 2)
        .when((turn == 2) & (conv % 23 == 0), None)
        .otherwise(own - 1)
    )
    sealed = F.when((turn == 1) & (conv % 11 == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select(
        own.alias("artifact_id"),
        F.when(conv % 3 == 0, "patch").otherwise("model_sql").alias("artifact_kind"),
        F.concat(F.lit("product_"), conv).alias("target_fqn"),
        F.sha2(sealed, 256).alias("content_sha256"),
        F.when(F.col("role") == "assistant", "builder").otherwise(F.concat(F.lit("human:"), "role")).alias("agent"),
        F.when(conv % 4 == 0, None).when(conv % 4 == 1, "auto-gate").otherwise("reviewer").alias("approved_by"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=own)).alias("created_at"),
        prev.alias("prev_artifact_id"),
        F.col("text").alias("content"),
    )


def market(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Parts as products, orders as certificates over them, order lines as their lineage and artifacts."""
    line, part, orders = (table(spark, sf_dir, n) for n in ("lineitem", "part", "orders"))
    sold = line.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.max("l_shipdate").alias("last_refreshed_at"),
        F.round(F.avg((F.col("l_discount") <= 0.08).cast("double")), 4).alias("quality_score"),
        F.array_sort(F.collect_set(F.when(F.col("l_discount") > 0.08, F.col("l_returnflag")))).alias("failing"),
    )
    held = F.col("p_brand") == "Brand#3"
    products = part.join(sold, "p_partkey").select(
        F.col("p_partkey").alias("product"),
        "last_refreshed_at",
        (F.col("p_size") * 24.0 * 4).alias("sla_hours"),
        F.when(held, "held").otherwise("ok").alias("refresh_status"),
        F.when(held, "drift under review").alias("held_reason"),
        "quality_score",
        F.array_join("failing", ",").alias("failing_tests"),
        (F.col("p_size") % 4 + 1).alias("criticality"),
        (F.col("p_size") % 3).cast("double").alias("credits"),
        "p_type",
        "p_size",
    )
    newest = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_linestatus", "l_returnflag")
    artifacts = line.groupBy(F.col("l_partkey").alias("product")).agg(F.max(newest).alias("a")).select(
        "product",
        F.col("a.l_orderkey").alias("artifact_id"),
        F.when(F.col("a.l_linestatus") == "O", "builder").otherwise("human:x").alias("agent"),
        F.when(F.col("a.l_returnflag") == "N", "auto-gate").when(F.col("a.l_returnflag") == "R", "reviewer").alias("approved_by"),
        (F.col("a.l_linestatus") == "O").alias("is_agent"),
    )
    return {
        "products": products,
        "artifacts": artifacts,
        "certs": orders.select(
            F.col("o_orderkey").alias("cert_id"), F.col("o_custkey").alias("asked_by"), F.col("o_orderdate").alias("issued_at")
        ),
        "nodes": line.select(F.col("l_orderkey").alias("cert_id"), F.col("l_partkey").alias("product")),
        "metrics": line.select(
            F.col("l_orderkey").alias("cert_id"),
            F.col("l_partkey").alias("product"),
            F.concat("l_returnflag", "l_linestatus").alias("name"),
            (~((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"))).alias("certified"),
        ).distinct(),
    }


def served_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered questions as stored answers: who got which plan shape, when, and in which policy scope."""
    who = users(spark, sf_dir).select(F.col("user_id").alias("consumer"), "role", "region")
    scope = F.when(F.col("role").isin("admin", "data_engineer", "ops_director"), "ALL").otherwise(F.coalesce("region", F.lit("NONE")))
    return (
        questions(spark, sf_dir)
        .where(F.col("outcome") == "answered")
        .join(who.withColumnRenamed("consumer", "asked_by"), "asked_by")
        .select(
            F.col("question_id").alias("cert_id"),
            F.col("asked_by").alias("consumer"),
            F.col("asked_at").alias("served_at"),
            F.when(F.col("topic") % 2 == 0, "export").otherwise("answer").alias("kind"),
            F.element_at(F.array(F.lit("total"), F.lit("by_day"), F.lit("by_feeder")), F.col("topic") % 3 + 1).alias("shape"),
            scope.alias("scope"),
            "topic",
        )
    )
