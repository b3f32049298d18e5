"""The next point in time for every start, by one sorted sweep."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_SECONDS = 86_400


def next_point(starts: DataFrame, points: DataFrame, keys: list[str], start: str, at: str, name: str, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """`starts` with the first point of the same keys at or after `start` as `name`, null if there is none.

    Starts and points are sorted together within blocks of (keys, time), so that a key with a large share of the rows lies in many
    blocks. Within a block the next point is looked back from its end; what a block cannot answer is carried in from the first
    point of a later one, of which there is a row a key and block. The work is one sort of both sides, with no row for each
    start and point. Repeated points count once; null keys meet nothing and null starts have no next point.
    """
    columns = starts.columns
    block = F.floor(F.unix_micros("_at") / (block_seconds * 1_000_000))
    point = points.where(F.col(at).isNotNull()).select(*keys, F.col(at).alias("_at"), F.col(at).alias("_point"))
    line = starts.withColumns({"_at": F.col(start), "_point": F.lit(None).cast("timestamp"), "_kind": F.lit(0)})
    for c in columns:
        if c not in keys:
            point = point.withColumn(c, F.lit(None).cast(starts.schema[c].dataType))
    line = line.unionByName(point.withColumn("_kind", F.lit(1))).withColumn("_block", block)
    # in a block, points of a moment come after its starts, and the nearest point at or after a row is the first non-null ahead
    within = Window.partitionBy(*keys, "_block").orderBy("_at", "_kind")
    ahead = F.first("_point", ignorenulls=True).over(within.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    firsts = line.groupBy(*keys, "_block").agg(F.min("_point").alias("_first"))
    later = Window.partitionBy(*keys).orderBy("_block").rowsBetween(1, Window.unboundedFollowing)  # a row a block
    carried = firsts.withColumn("_carried", F.first("_first", ignorenulls=True).over(later)).drop("_first")
    found = line.withColumn("_ahead", ahead).where("_kind = 0").join(carried, [*keys, "_block"], "left")
    known = reduce(and_, (F.col(c).isNotNull() for c in [*keys, start]))
    return found.select(*columns, F.when(known, F.coalesce("_ahead", "_carried")).alias(name))
