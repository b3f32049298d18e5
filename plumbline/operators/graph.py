"""Reachability over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import settle


def reach(edges: DataFrame, seeds: DataFrame, inclusive: bool = False, reverse: bool = False) -> DataFrame:
    """Nodes reachable from `seeds(node)` along `edges(src, dst)`, with their distance.

    One join per level of depth, from the newly found nodes only. Each level is written to the shared
    folder, so plans stay short and a lost executor repeats one level. Cycles end because found nodes are
    never visited again.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    e = settle(edges.select(F.col(a).alias("node"), F.col(b).alias("next")), "edges")
    frontier = settle(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "reach")
    found, depth = frontier, 0
    while True:
        depth += 1
        step = (
            frontier.join(e, "node")
            .select(F.col("next").alias("node"))
            .distinct()
            .join(found.select("node"), "node", "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        frontier = settle(step, "reach")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found if inclusive else found.where(F.col("depth") > 0)


#: Nodes that may be broadcast; beyond, both sides of a join are shuffled: files of numbered names are much smaller than the names.
FEW = 100_000
#: Jumps that a node may have for jumps of twice the length to be derived from them.
FANOUT = 4


def _doubled(jumps: DataFrame, fanout: int) -> DataFrame:
    """Jumps of twice the length from nodes that would have at most `fanout` of them; counted before any two are joined."""
    n = settle(jumps.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "jump-counts")
    light = n.where(F.col("n") <= fanout).select("node")
    after = n.select(F.col("node").alias("next"), "n")
    some = (
        jumps.join(light, "node", "left_semi")
        .join(after, "next")
        .groupBy("node")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") <= fanout)
        .select("node")
    )
    first = jumps.join(some, "node", "left_semi").withColumnRenamed("next", "middle")
    second = jumps.select(F.col("node").alias("middle"), "next")
    return first.join(second, "middle").select("node", "next").distinct()


def _side(df: DataFrame, rows: int) -> DataFrame:
    return df if rows <= FEW else df.hint("merge")


def reachable(
    edges: DataFrame, seeds: DataFrame, inclusive: bool = False, reverse: bool = False, fanout: int = FANOUT, patience: int = 0, kinds: tuple[str, str] | None = None
) -> tuple[DataFrame, int]:
    """Nodes reachable from `seeds(node)` along `edges(src, dst)`, and the number of rounds it took.

    Every round takes the single edges of what the last round found, and from all found nodes the jumps at hand. Jumps start as
    edges and are joined with themselves once a round, so that a chain or a cycle of n nodes is walked in about log2(n) rounds.
    A node keeps at most `fanout` jumps of a length, which keeps each table of jumps linear in the nodes; where a graph branches
    more, its single edges carry on, level by level. Repeated edges count once; edges without an end are ignored.
    Seeds are part of the result only if `inclusive`. Rounds are written to the shared folder.

    Jumps cost several passes over all edges a round and pay in deep graphs only: they are made once `patience` rounds have not ended
    the walk. `kinds` names two columns of `edges`, the kinds of `src` and of `dst`; kinds are few, never null, and a node has one. A
    round then reads the edges from the kinds found in the last round only, straight from their source, and edges are stored only
    if the walk outlasts `patience`. Seeds may state theirs as `kind`; else the first round reads all edges.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    columns = [F.col(a).alias("node"), F.col(b).alias("next")]
    if kinds:
        columns += [F.col(kinds[1] if reverse else kinds[0]).alias("from"), F.col(kinds[0] if reverse else kinds[1]).alias("to")]
    plain = edges.select(*columns).where("node is not null and next is not null and node <> next")
    e = None if kinds else settle(plain.distinct(), "edges")
    reached = [r[0] for r in seeds.select("kind").distinct().collect()] if kinds and "kind" in seeds.columns else None
    seeds = settle(seeds.select("node").distinct(), "seeds")
    found = fresh = seeds
    given = new = total = seeds.count()
    jumps, rounds, deep = e, 0, False
    while True:
        rounds += 1
        if rounds > patience and not deep:
            deep = True
            if e is None:
                e = settle(plain.select("node", "next").distinct(), "edges")
            jumps = e
            step = _side(fresh, new).join(e, "node").select(F.col("next").alias("node"))
        elif deep:
            step = _side(fresh, new).join(e, "node").select(F.col("next").alias("node"))
            if jumps is not None:
                step = step.unionByName(_side(found, total).join(jumps, "node").select(F.col("next").alias("node")))
        elif kinds:
            near = plain if reached is None else plain.where(F.col("from").isin(*reached))
            step = _side(fresh, new).join(near, "node").select(F.col("next").alias("node"), "to")
        else:
            step = _side(fresh, new).join(e, "node").select(F.col("next").alias("node"))
        step = step.distinct().join(_side(found, total), "node", "left_anti")
        fresh = settle(step, "reach")
        new = fresh.count()
        if not new:
            break
        total += new
        if kinds and not deep:
            reached = [r[0] for r in fresh.select("to").distinct().collect()]
            fresh = fresh.select("node").distinct() if len(reached) > 1 else fresh.select("node")
        found = found.unionByName(fresh)
        if deep and jumps is not None:
            jumps = settle(_doubled(jumps, fanout), "jumps")
            jumps = None if jumps.isEmpty() else jumps
    return (found if inclusive else found.join(_side(seeds, given), "node", "left_anti")), rounds
