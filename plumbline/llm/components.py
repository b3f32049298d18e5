"""Connected components by alternating large-star and small-star, in DataFrame operations only.

Large-star links every larger neighbour of a node to the least node it knows; small-star does so for the smaller ones. Both
keep components and flatten them, in a number of rounds that grows with the logarithm of their size. A node's neighbours are
never gathered: a round is a minimum per node, combined before the shuffle, and a join that Spark can split where a node is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import discard, settle


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for each node of `edges` (u, v): root is the least node that it reaches.

    Edges with a null end count for nothing, nor do loops; repeated ones count once; no edges give no rows. Nodes may be of
    any ordered type.
    """
    pair = edges.select(F.col(edges.columns[0]).alias("u"), F.col(edges.columns[1]).alias("v")).where("u is not null and v is not null and u <> v")
    now = settle(pair.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = _least(large)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = settle(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
        discard(now)
        now, before = after, state
        state = _state(now)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
