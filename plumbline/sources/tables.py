"""Scans, loads and versioned tables.

A versioned table is a folder with one sub-folder per version and a `_pointer` table naming the published
one. Nothing a reader may hold open is ever overwritten: publishing writes a new version, then moves the
pointer; older versions stay readable as the archive.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAMILIES = {
    "varchar": (T.StringType, T.VarcharType, T.CharType),
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "double": (T.DoubleType, T.FloatType),
    "boolean": (T.BooleanType,),
    "date": (T.DateType,),
    "timestamp": (T.TimestampType, T.TimestampNTZType),
}


def family(dt: T.DataType) -> str:
    """Contract type family of a Spark type; other types go by their own name."""
    return next((n for n, kinds in FAMILIES.items() if isinstance(dt, kinds)), dt.simpleString())


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def query(spark: SparkSession, sql: str, args: Mapping[str, Any] | None = None, **tables: DataFrame) -> DataFrame:
    """SQL with bound parameters over named frames: `{name}` in the text is a frame, `:name` a value."""
    return spark.sql(sql, args=dict(args or {}), **tables)


def describe(name: str, df: DataFrame) -> list[tuple[str, int, str, str, bool]]:
    return [(name, i, f.name, family(f.dataType), f.nullable) for i, f in enumerate(df.schema.fields)]


def append(df: DataFrame, path: str, like: T.StructType | None = None) -> None:
    """Bulk append; columns are matched by name and cast to the table's types."""
    if like is not None:
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in like.fields])
    df.write.mode("append").parquet(path)


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _version_path(self, version: int) -> str:
        return f"{self.path}/v={version}"

    def write(self, df: DataFrame, version: int, partition_by: list[str] | None = None) -> None:
        w = df.write.mode("errorifexists")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(self._version_path(version))

    def publish(self, version: int) -> None:
        """Point readers at `version`: one folder per sequence number, the highest wins. Of two writers that take the same
        number, the second fails and may publish again."""
        seq = (self._pointers().agg(F.max("seq")).first()[0] if self._exists() else 0) + 1
        row = self.spark.createDataFrame([(version,)], "version int").coalesce(1)
        row.write.mode("errorifexists").parquet(f"{self.path}/_pointer/seq={seq}")

    def _exists(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_pointer")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _pointers(self) -> DataFrame:
        return self.spark.read.schema("version int, seq bigint").parquet(f"{self.path}/_pointer")

    def current_version(self) -> int:
        return self._pointers().agg(F.max_by("version", "seq")).first()[0]

    def current(self) -> int | None:
        """The published version, None before the first."""
        return self.current_version() if self._exists() else None

    def drop(self, version: int) -> None:
        """Delete a version that readers are not pointed at."""
        if version == self.current():
            raise ValueError(f"version {version} is published")
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self._version_path(version))
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self._version_path(self.current_version() if version is None else version))

    def swap_in(self, df: DataFrame, version: int, partition_by: list[str] | None = None) -> DataFrame:
        self.write(df, version, partition_by)
        self.publish(version)
        return self.read()


def clone_window(df: DataFrame, at: str, start: datetime, end: datetime) -> DataFrame:
    """Rows in `[start, end)`. A filter, not a copy: it reaches the scan, or prunes date partitions."""
    return df.where((F.col(at) >= F.lit(start)) & (F.col(at) < F.lit(end)))


def last_known_good(df: DataFrame, at: str, as_of: datetime, days: int = 7) -> DataFrame:
    """Feed snapshot of the last `days`, with the date column it is partitioned by when written."""
    kept = clone_window(df, at, as_of - timedelta(days=days), as_of)
    return kept.withColumn("snapshot_date", F.to_date(at))


def map_feed(feed: DataFrame, mapping: Mapping[str, str | Column]) -> DataFrame:
    """Conformed frame from a landing feed: output name to source column or expression."""
    return feed.select(*[(F.col(e) if isinstance(e, str) else e).alias(n) for n, e in mapping.items()])


def restate(
    reads: DataFrame,
    meters: DataFrame,
    feeder_id: Any,
    start: datetime,
    end: datetime,
    columns: list[str],
    value: float = 0.0,
) -> DataFrame:
    """Set `columns` to `value` for the meters of one feeder inside `[start, end)`."""
    hit = meters.where(F.col("feeder_id") == F.lit(feeder_id)).select("meter_id").distinct().withColumn("_hit", F.lit(True))
    inside = F.col("_hit") & (F.col("read_ts") >= F.lit(start)) & (F.col("read_ts") < F.lit(end))
    out = reads.join(hit, "meter_id", "left")
    for c in columns:
        out = out.withColumn(c, F.when(inside, F.lit(value)).otherwise(F.col(c)))
    return out.select(*reads.columns)


def rename_retype(df: DataFrame, old: str, new: str, to: str) -> DataFrame:
    return df.withColumn(old, F.col(old).cast(to)).withColumnRenamed(old, new)
