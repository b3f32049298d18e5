"""Tracer records: known rows sent through the pipeline to prove it end to end."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.policy import TRACER_PREFIX
from plumbline.plans.products import Sources

# What the tracers must show of the products over the test grid: a read counts at a window's start and inside it, not at its
# end; off, on and barely on are told apart; both directions of flow and nine decimals arrive; all this in a window of many
# reads, in one shorter than the time between reads, and in one that crosses the end of a month. The first two lie in the last
# week, which the gate rebuilds.
WINDOWS = {
    "long": (datetime(2024, 1, 26, 2), timedelta(hours=7), "WEATHER"),
    "brief": (datetime(2024, 1, 28, 13, 10), timedelta(minutes=30), "EQUIPMENT"),
    "month-end": (datetime(2024, 1, 31, 22), timedelta(hours=4), "PLANNED"),
}
#: meter -> (share of the window passed at its read, delivered, received)
PROBES = {"start": (0.0, 0.0, 0.0), "inside": (0.5, 0.000000123, 0.5), "end": (1.0, 1.000000123, 0.0)}


def tracer_rows() -> dict[str, list[tuple]]:
    """One feeder, a meter per probe, an outage per window, and the read of each probe in each window."""
    feeder = f"{TRACER_PREFIX}feeder"
    outages, reads = [], []
    for name, (start, length, cause) in WINDOWS.items():
        outages.append((TRACER_PREFIX + name, feeder, str(start), str(start + length), cause, len(PROBES)))
        reads += [(TRACER_PREFIX + probe, str(start + share * length), out, back) for probe, (share, out, back) in PROBES.items()]
    return {
        "feeders": [(feeder, "NATION_3", "AMERICA")],
        "meters": [(TRACER_PREFIX + probe, feeder, "BUILDING", f"{probe} of every window") for probe in PROBES],
        "outages": outages,
        "reads": reads,
    }


TRACER_ROWS = tracer_rows()


def is_tracer(c: str):
    return F.col(c).startswith(TRACER_PREFIX)


def text_columns(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t == "string"]


def inject(df: DataFrame, rows: list[tuple], columns: list[str] | None = None) -> DataFrame:
    """`df` plus literal rows, cast to its types; columns not given are null."""
    names = columns or df.columns
    extra = df.sparkSession.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows], ", ".join(f"`{n}` string" for n in names))
    extra = extra.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in df.schema.fields if f.name in names])
    return df.unionByName(extra, allowMissingColumns=True)


def with_tracers(src: Sources, rows: dict[str, list[tuple]] | None = None) -> dict[str, DataFrame]:
    rows = TRACER_ROWS if rows is None else rows
    order = {
        "feeders": ["feeder_id", "substation_id", "region"],
        "meters": ["meter_id", "feeder_id", "meter_type", "service_address"],
        "outages": ["outage_id", "feeder_id", "start_ts", "end_ts", "cause_code", "customers_affected"],
        "reads": ["meter_id", "read_ts", "kwh_delivered", "kwh_received"],
    }
    return {n: inject(df, rows[n], order[n]) if n in rows else df for n, df in src.items()}


def key_column(df: DataFrame, primary_key: list[str]) -> str | None:
    """First string column, keys first, that holds tracer rows; one aggregate over all of them."""
    texts = text_columns(df)
    order = [c for c in primary_key if c in texts] + [c for c in texts if c not in primary_key]
    if not order:
        return None
    row = df.agg(*[F.max(is_tracer(c)).alias(c) for c in order]).first()
    return next((c for c in order if row[c]), None)


def isolate(df: DataFrame) -> DataFrame:
    """Only rows with a tracer key in some string column."""
    test = F.lit(False)
    for c in text_columns(df):
        test = test | F.coalesce(is_tracer(c), F.lit(False))
    return df.where(test)


def expected_rows(model, src: Sources, key: str) -> DataFrame:
    """What a product must hold for the tracers: the same product over the tracer rows alone."""
    return model({n: isolate(df) for n, df in src.items()}).where(is_tracer(key))


CLOSE = 1e-9


def mismatches(expected: DataFrame, actual: DataFrame, primary_key: list[str]) -> DataFrame:
    """(key, column, expected, actual) per differing cell; a missing row counts as one.

    The expected side has a few tracer rows, so the join is a broadcast of measured size.
    """
    cols = [c for c in expected.columns if c not in primary_key and c in actual.columns]
    right = actual.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(primary_key)], *[F.col(c).alias(f"_a_{c}") for c in cols], F.lit(True).alias("_found"))
    on = F.lit(True)
    for i, k in enumerate(primary_key):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    types = dict(expected.dtypes)
    cells = []
    for c in cols:
        e, a = F.col(c), F.col(f"_a_{c}")
        near = F.abs(e - a) <= CLOSE if types[c] in ("double", "float") else e == a
        same = F.coalesce(near, e.isNull() & a.isNull())
        cells.append(F.struct((~same).alias("bad"), F.lit(c).alias("column"), e.cast("string").alias("expected"), a.cast("string").alias("actual")))
    lost = F.struct(F.lit(True).alias("bad"), F.lit(None).cast("string").alias("column"), F.lit("row").alias("expected"), F.lit("missing").alias("actual"))
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in primary_key]).alias("key")
    return (
        expected.join(right, on, "left")
        .select(key, F.inline(F.when(F.col("_found"), F.array(*cells)).otherwise(F.array(lost))))
        .where("bad")
        .drop("bad")
    )


def latest_status(results: DataFrame) -> DataFrame:
    """Latest published verification per product, from (product, context, passed, checked, checked_at, result_id)."""
    last = F.max_by(F.struct("passed", "checked", "checked_at"), F.struct("checked_at", "result_id")).alias("r")
    return results.where(F.col("context") == "published").groupBy("product").agg(last).select("product", "r.*")


def matrix(records: DataFrame, expected: dict[str, DataFrame], actual: dict[str, DataFrame], keys: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Tracer record by product: passed, failed, or empty where no expected row is related to the record.

    records(record_id, link): the keys a record is known by (its own, its meter's and its feeder's);
    keys: per product the tracer key column and the primary key.
    """
    cells = None
    for name, exp in expected.items():
        column, pk = keys[name]
        bad = mismatches(exp, actual[name], pk).select("key").distinct().withColumn("_bad", F.lit(True))
        own = [F.col(column)] + ([F.col("outage_id")] if "outage_id" in exp.columns else [])
        rows = exp.select(F.concat_ws("|", *[F.col(k).cast("string") for k in pk]).alias("key"), F.explode(F.array_distinct(F.array(*own))).alias("link"))
        rows = rows.join(bad, "key", "left").select("link", F.lit(name).alias("product"), F.col("_bad").isNull().alias("ok"))
        cells = rows if cells is None else cells.unionByName(rows)
    return (
        records.join(cells, "link", "left")
        .groupBy("record_id")
        .pivot("product", sorted(expected))
        .agg(F.bool_and("ok"))
    )
