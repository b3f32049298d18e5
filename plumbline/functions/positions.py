"""Global positions in a sorted table, without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import settle

_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def with_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Number rows from 0 in `order` (which should be unique): range-partitioned sort plus one offset per partition."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = settle(ranged.withColumn("_m", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_m", _BITS)
    sizes = dict(marked.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    total, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, total))
        total += sizes[p]
    offset = df.sparkSession.createDataFrame(offsets, "_p bigint, _offset bigint")
    within = F.col("_m").bitwiseAND(F.lit((1 << _BITS) - 1))
    return (
        marked.withColumn("_p", part)
        .join(offset, "_p")
        .withColumn(name, F.col("_offset") + within)
        .drop("_m", "_p", "_offset")
    )
