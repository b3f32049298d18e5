"""Near-duplicate embeddings: a navigable small-world graph per shard, every shard queried, cosines verified, links joined.

Equal vectors are one class from the start. Classes are dealt to shards by a hash; a shard is at most SHARD_MOST vectors, so
one task builds its graph whatever the size of the table, and widens its beam until an audit against brute force passes, for
its own vectors and for a sample of the others.
Blocks of query vectors meet every shard; a search whose beam is full of links goes on with twice the beam. What comes back is
a count of links per vector and a spanning forest of the links of a block and a shard, never the pairs themselves. Components
are joined over the forests by large-star and small-star.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import width
from plumbline.llm.components import components
from plumbline.llm.hnsw import Graph
from plumbline.llm.words import mix
from plumbline.session import discard, settle

COSINE = 0.9
#: Shards at least and vectors in one at most; vectors in a block; blocks that one task takes through a shard.
SHARDS, SHARD_MOST, BLOCK, TURN = 6, 25_000, 2048, 16
BEAM, RECALL, AUDITED = 16, 0.99, 512
#: About how many vectors of a dimension every shard is audited with besides its own.
GUESTS = 2048
_BLOCKS = "dim int, block int, size int, ids binary, classes binary, counts binary, vectors binary"


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    v = flat.reshape(-1, dim)
    v = v / np.abs(v).max(1)[:, None]  # so that squares neither vanish nor overflow
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links (a, b) with the least node it is linked to through them, where that is another."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, x, low)
        np.minimum.at(after, y, low)
        np.minimum.at(after, label[x], low)
        np.minimum.at(after, label[y], low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _blocks(classes: DataFrame) -> DataFrame:
    """Classes (id, cls, n, dim, v) as rows of up to BLOCK vectors of one dimension each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = 0
        for b in batches:
            t = pa.Table.from_batches([b])
            for dim in np.unique(t["dim"].to_numpy()).tolist():
                own = t.filter(pa.array(t["dim"].to_numpy() == dim))
                for at in range(0, len(own), BLOCK):
                    c = own.slice(at, BLOCK)
                    v = c["v"].combine_chunks().flatten().to_numpy()
                    cols = [c[k].to_numpy().astype("<i8").tobytes() for k in ("id", "cls", "n")]
                    row = [dim, block, len(c), *cols, _unit(v, dim).astype("<f8").tobytes()]
                    kinds = [pa.int32()] * 3 + [pa.binary()] * 4
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=[x.split()[0] for x in _BLOCKS.split(", ")])
                    block += 1

    return classes.mapInArrow(run, _BLOCKS)


def _graphs(classes: DataFrame, shards: int, least: float) -> DataFrame:
    def build(t: pa.Table) -> pa.Table:
        guests, t = t.filter(t["guest"]), t.filter(pc.invert(t["guest"]))
        if not len(t):
            return pa.table({"dim": pa.array([], pa.int32()), "shard": pa.array([], pa.int32()), "beam": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())})
        ids, cls = t["id"].to_numpy(), t["cls"].to_numpy()
        key = mix(cls.view(np.uint64))
        order = np.argsort(key, kind="stable")
        dim = t["dim"][0].as_py()
        v = _unit(t["v"].combine_chunks().flatten().to_numpy(), dim)[order]
        draws = ((mix(key[order] ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(11)).astype(float) + 1) / (1 << 53)
        g = Graph.build(v, draws)
        others = _unit(guests["v"].combine_chunks().flatten().to_numpy(), dim) if len(guests) else None
        beam = g.audited_beam(least, BEAM, RECALL, AUDITED, others)
        payload = g.tobytes(np.stack([ids[order], cls[order], t["n"].to_numpy()[order]]))
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": t["shard"][:1], "beam": pa.array([beam], pa.int32()), "payload": pa.array([payload], pa.binary())})

    own = F.pmod("cls", F.lit(shards)).cast("int")
    one_in = F.greatest(F.lit(1), F.floor(F.col("of_dim") / F.lit(GUESTS)))
    guests = classes.join(classes.groupBy("dim").agg(F.count(F.lit(1)).alias("of_dim")), "dim")
    guests = guests.where(F.pmod(F.xxhash64(F.lit("guest"), "cls"), one_in) == 0).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    guests = guests.where(F.col("shard") != own).withColumn("guest", F.lit(True)).drop("of_dim")
    dealt = classes.withColumn("shard", own).withColumn("guest", F.lit(False)).unionByName(guests)
    return dealt.repartition(2 * shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, beam int, payload binary")


def _links(blocks: DataFrame, graphs: DataFrame, shards: int, turns: int, least: float) -> DataFrame:
    """Rows (cls, n, a, b): links counted for a class, or a link of a forest."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        counts: list[tuple[np.ndarray, np.ndarray]] = []
        trees: list[tuple[np.ndarray, np.ndarray]] = []
        if len(left) and len(right):
            g, known = Graph.frombytes(right["payload"][0].as_py())
            ids, cls, n = known
            for row in left.select(["ids", "classes", "vectors"]).to_pylist():
                q_ids, q_cls = (np.frombuffer(row[k], "<i8") for k in ("ids", "classes"))
                q = np.frombuffer(row["vectors"], "<f8").reshape(len(q_ids), -1)
                total = np.zeros(len(q_ids), np.int64)
                for a, b in g.within(q, least, right["beam"][0].as_py()):
                    other = q_cls[a] != cls[b]
                    a, b = a[other], b[other]
                    np.add.at(total, a, n[b])
                    trees.append(_forest(q_ids[a], ids[b]))
                counts.append((q_cls[total > 0], total[total > 0]))
        c, n = (np.concatenate([x[k] for x in counts] or [np.zeros(0, np.int64)]) for k in (0, 1))
        a, b = (np.concatenate([x[k] for x in trees] or [np.zeros(0, np.int64)]) for k in (0, 1))
        a, b = _forest(a, b)
        none = lambda k: pa.nulls(k, pa.int64())
        cols = [(pa.array(c), none(len(a))), (pa.array(n), none(len(a))), (none(len(c)), pa.array(a)), (none(len(c)), pa.array(b))]
        return pa.table({k: pa.chunked_array(x, pa.int64()) for k, x in zip(("cls", "n", "a", "b"), cols)})

    keys = ["dim", "shard", "turn"]
    asked = blocks.withColumn("turn", F.pmod(F.hash("ids"), F.lit(turns))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    ready = graphs.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    tasks = 2 * shards * turns
    asked, ready = (d.repartition(tasks, *keys) for d in (asked, ready))
    return asked.groupBy(*keys).cogroup(ready.groupBy(*keys)).applyInArrow(search, "cls long, n long, a long, b long")


def vector_components(vectors: DataFrame, least: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of `vectors`.

    Vectors are linked where their cosine, in double precision, is at least `least` (more than 0); equal ones always are. A vector
    that is null, empty, zero, or holds null or non-finite components is linked with nothing, and so is a row without id
    (component null, kept). Vectors of different dimensions are not linked. Rows with equal ids and different vectors count
    as separate vectors of one component. Other columns are ignored; an empty table gives no rows.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    fine = F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull()
    key = F.sha2(F.to_json(F.struct(F.transform("v", lambda x: F.when(x == 0, 0.0).otherwise(x)).alias("v"))), 256)
    rows = rows.withColumn("key", F.when(fine, key))
    classes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    classes = settle(classes.select("key", "id", F.xxhash64("key").alias("cls"), "n", F.size("v").alias("dim"), "v"), "classes")
    total = classes.count()
    shards = max(SHARDS, -(-total // SHARD_MOST))
    narrow = classes.drop("key")
    blocks = settle(_blocks(narrow.repartition(min(width(vectors.sparkSession), 1 + total // BLOCK), "cls")), "blocks")
    graphs = settle(_graphs(narrow, shards, least), "graphs")
    turns = max(1, -(-blocks.count() // TURN))
    found = settle(_links(blocks, graphs, shards, turns, least), "links")
    known = settle(components(found.where("a is not null").select("a", "b")), "components")
    counts = found.where("cls is not null").groupBy("cls").agg(F.sum("n").alias("links"))
    per = classes.select("key", "id", "cls", F.col("n").alias("copies")).join(counts, "cls", "left")
    per = per.join(known.select(F.col("node").alias("id"), "root"), "id", "left")
    per = per.select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("component"))
    discard(blocks, graphs)
    out = rows.select("vec_id", "key").join(per, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
