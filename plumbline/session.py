"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "plumbline", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; everything else is left to the cluster's own settings."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = b.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ready(spark: SparkSession) -> SparkSession:
    """Timestamps are naive UTC throughout, so the session must be too."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: `spark.checkpoint.dir`, or a local one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    local = tempfile.mkdtemp(prefix="plumbline-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/plumbline/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "step") -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Iterative jobs use this instead of in-memory caching: lost executors recompute nothing, and the next
    plan sees real file sizes, so Spark picks broadcast or shuffle joins on measured data.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.settled_at = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames made by `settle()` once nothing reads them any more; other frames are left alone."""
    for df in frames:
        path = df.__dict__.get("settled_at")
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
