"""Session settings and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators are planned for.  Shuffle partition counts are left to
#: adaptive execution: start wide, coalesce to the advisory size at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Semi joins on row ids have a tiny build side per partition: hash it
    # rather than sorting the wide article side.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A task has one core; matrix products in as many threads as the machine has get in each other's way.
    "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
}


def build_session(app: str = "tickerpress", master: str | None = None, **conf: str) -> SparkSession:
    """A session with ``SETTINGS``; keyword arguments use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; one process on one machine may leave it unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="tickerpress-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_through(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where several jobs read the same intermediate result.  Unlike a cache
    it outlives lost executors, and unlike ``checkpoint()`` it computes the
    input once and keeps column pruning for the readers.  ``codec`` is the session's
    unless given; whole texts take a third less disk as ``zstd``.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
