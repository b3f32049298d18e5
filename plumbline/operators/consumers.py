"""Consumers of a product across a breaking change."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.hashing import hash_sums
from plumbline.functions.positions import with_position
from plumbline.operators.intervals import interval_join
from plumbline.session import settle

SUNSET_DAYS = 90
CLOSE = 1e-9
#: Ranges opened at a time, digests looked at for them, and characters of the deepest range.
OPEN, GROUPS, DEEPEST = 256, 65_536, 12
#: Rows that are put in order without looking further.
FEW = 10_000


def affected(consumers: DataFrame, refs: DataFrame, product) -> DataFrame:
    """Consumers with a reference(consumer_id, product) to the product."""
    return consumers.join(refs.where(F.col("product") == F.lit(product)), "consumer_id", "left_semi")


def compatibility_view(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    """The new version under its old column names, for queries written against the old one."""
    for old, new in renames.items():
        df = df.withColumnRenamed(new, old)
    return df


def _runs(df: DataFrame, side: str) -> DataFrame:
    """Equal rows as one run [start, stop) of positions in the sorted result; columns by place, not by name."""
    cols = [f"c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*cols)
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(f"k{i}") for i, c in enumerate(cols)]
    counted = settle(plain.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")), "runs")
    placed = with_position(counted.select("*", *keys), [f"k{i}" for i in range(len(cols))] + cols, "i")
    # prefix sums of the run lengths: totals per block of positions, then within a block
    block = 1_000_000  # so even a trillion rows leave a million block totals
    placed = settle(placed.withColumn("b", F.expr(f"i div {block}")), "runs")
    sums = placed.groupBy("b").agg(F.sum("n").alias("s"))
    order = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("b", F.coalesce(F.sum("s").over(order), F.lit(0)).alias("before"))
    inner = Window.partitionBy("b").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(before, "b")
        .withColumn("start", F.col("before") + F.coalesce(F.sum("n").over(inner), F.lit(0)))
        .select(*[F.col(c).alias(f"{side}_{c}") for c in cols], F.col("start").alias(f"{side}_start"), (F.col("start") + F.col("n")).alias(f"{side}_stop"))
    )


def _texts(df: DataFrame) -> DataFrame:
    """Columns by place, with the text of the first as `k`; results are ordered by it first."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.withColumn("k", F.coalesce(F.col("c0").cast("string"), F.lit("None")))


def _digests(df: DataFrame, length: int, below: list[str]) -> DataFrame:
    """(p, n, d): count and order-free digest of the rows whose first text has each prefix of this length, under prefixes one shorter."""
    here = df if length <= 1 else df.where(F.substring("k", 1, length - 1).isin(below))
    row = F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in df.columns if c != "k"]))
    return here.groupBy(F.substring("k", 1, length).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.concat_ws("|", *hash_sums(row)).alias("d"))


def differing_ranges(old: DataFrame, new: DataFrame) -> list[tuple[int, list[str]]]:
    """Where two results of as many rows differ in sorted order: (prefix length, prefixes of the first column's text).

    A tree of digests over key ranges: the whole first, then ranges by one more character, but only below ranges that differ. A range
    is left out if as many rows come before it on both sides and its digests agree. Ranges with other counts are kept with all up
    to where the counts meet again, as their rows pair up across ranges. At most OPEN ranges are opened at a time and GROUPS
    digests looked at; where more differ, the ranges above are compared as they are. Equal results cost one aggregate each.
    """
    sides = [_texts(old), _texts(new)]
    kept: list[tuple[int, list[str]]] = []
    opened, length = [""], 0
    while opened:
        a, b = (_digests(x, length, opened) for x in sides)
        met = a.join(b.select("p", F.col("n").alias("m"), F.col("d").alias("e")), "p", "full").limit(GROUPS + 1).collect()
        if len(met) > GROUPS:
            kept.append((length - 1, opened))
            break
        single, mixed, block, ahead = [], [], [], 0
        for r in sorted(met, key=lambda r: r["p"].encode()):  # Spark sorts text by its bytes
            n, m = r["n"] or 0, r["m"] or 0
            if not ahead and n == m:
                if r["d"] != r["e"]:
                    (single if len(r["p"]) == length else mixed).append(r["p"])
                continue
            block.append(r["p"])
            ahead += n - m
            if not ahead:
                mixed, block = mixed + block, []
        mixed += block
        if mixed:
            kept.append((length, mixed))
        if len(single) > OPEN or length == DEEPEST or 0 < sum(r["n"] for r in met if r["p"] in single) <= FEW:
            kept.append((length, single))
            break
        opened, length = single, length + 1
    return kept


def value_divergence(old: DataFrame, new: DataFrame) -> float:
    """Largest relative difference of two results compared row by row in sorted order, names ignored.

    A different number of rows or columns, or any differing non-numeric value, counts as 1. Only key ranges whose digests
    differ are put in order. Equal rows are collapsed into runs of positions, so neither a long result nor a repeated row meets in one task.
    """
    if len(old.columns) != len(new.columns):
        return 1.0
    old, new = settle(old, "old"), settle(new, "new")
    if old.count() != new.count():
        return 1.0
    ranges = differing_ranges(old, new)
    if not ranges:
        return 0.0

    def within(df: DataFrame) -> DataFrame:
        k = F.coalesce(F.col(f"`{df.columns[0]}`").cast("string"), F.lit("None"))
        return df.where(reduce(or_, (F.substring(k, 1, n).isin(some) for n, some in ranges)))

    old, new = within(old), within(new)
    a, b = _runs(old, "a"), _runs(new, "b")
    at = F.timestamp_micros

    def as_intervals(df: DataFrame, s: str) -> DataFrame:
        return df.withColumns({"_one": F.lit(1), f"{s}_from": at(f"{s}_start"), f"{s}_to": at(f"{s}_stop")})

    # two runs overlap exactly where one of them starts inside the other
    a, b = as_intervals(a, "a"), as_intervals(b, "b")
    b_starts_in_a = interval_join(a, b, ["_one"], "a_from", "a_to", "b_from", finest_seconds=1)
    a_starts_in_b = interval_join(b, a, ["_one"], "b_from", "b_to", "a_from", finest_seconds=1)
    met = b_starts_in_a.unionByName(a_starts_in_b)
    numbers = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    worst = F.lit(0.0)
    for i, (x, y) in enumerate(zip(old.dtypes, new.dtypes)):
        p, q = F.col(f"a_c{i}"), F.col(f"b_c{i}")
        if {x[1], y[1]} <= numbers or (x[1].startswith("decimal") and y[1].startswith("decimal")):
            p, q = p.cast("double"), q.cast("double")
            gap = F.abs(p - q)
            cell = F.when(p.isNull() & q.isNull(), 0.0).when(p.isNull() | q.isNull(), 1.0).when(gap > CLOSE, gap / F.greatest(F.abs(p), F.lit(CLOSE))).otherwise(0.0)
        else:
            cell = F.when(p.cast("string").eqNullSafe(q.cast("string")), 0.0).otherwise(1.0)
        worst = F.greatest(worst, cell)
    return float(met.agg(F.coalesce(F.max(worst), F.lit(0.0))).first()[0])


def decide(migrations: DataFrame, sunset_days: int = SUNSET_DAYS) -> DataFrame:
    """Consumers after their owners decided: accepted ones move on, rejected ones stay on the old version for a while.

    migrations(consumer_id, from_version, to_version, accepted, decided_at).
    """
    no = ~F.col("accepted")
    return migrations.select(
        "consumer_id",
        F.when(no, "held_on_previous").otherwise("accepted").alias("status"),
        F.when(no, F.col("from_version")).alias("pinned_version"),
        F.when(no, F.date_add(F.to_date("decided_at"), sunset_days)).alias("sunset_on"),
    )
