"""What several corpus operators share: folds, size-checked joins, stored steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of up to two numbers that may be broadcast: about 32 MB in an executor. Larger sides are shuffled.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Partitions that a keyed redistribution gets."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Ask for a broadcast only where the counted rows are within BROADCAST_ROWS; else Spark shuffles both sides."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def held_out(doc_id: str | Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a missing id is held out, as nothing may be learnt from it."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def modest(docs: DataFrame) -> DataFrame:
    """`docs`, with Arrow batches of 8 MB at most unless the session sets another size than Spark's: texts may be very long."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == "67108864b":
        conf.set(key, "8m")
    return docs


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, giving freed Arrow memory back to the system after each: idle workers share an executor with its heap."""
    for b in batches:
        yield b
        del b
        pa.default_memory_pool().release_unused()


def utf8(col: str = "text") -> Column:
    """A text as bytes; a missing text is empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def fresh(name: str, df: DataFrame) -> str:
    """A column name that `df` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
