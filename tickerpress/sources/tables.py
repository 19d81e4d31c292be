"""Typed table reads and stage writes."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of finished hand-offs; they ascend with the time of writing.
_MANIFEST = "version string"


def read_table(spark: SparkSession, path: str, schema: T.StructType | str,
               fmt: str | None = None) -> DataFrame:
    """Read Parquet, ORC, JSON or headed CSV with an explicit schema, never an inferred one.

    In CSV an empty field is null, and quoted fields may span lines, which
    article bodies do.
    """
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema)
    if fmt == "csv":
        return reader.csv(path, header=True, multiLine=True, escape='"', nullValue="",
                          dateFormat="yyyy-MM-dd")
    return reader.format(fmt).load(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a small scan as many partitions as the cluster has cores.

    A single file with one row group would be read, tokenised and scored by one
    task.  Inputs with enough splits of their own are returned as they are, so
    nothing large is ever shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> None:
    """Write a stage table; ``sort_by`` orders rows inside each file, without a global sort."""
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.csv(path, header=True, escape='"', dateFormat="yyyy-MM-dd")
    else:
        writer.format(fmt).save(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write chosen parameters or metric rows as JSON lines."""
    df.write.mode(mode).json(path)


def hand_off(aligned: DataFrame, calendar: DataFrame, folder: str, fmt: str = "parquet") -> str:
    """Write aligned articles and the calendar they were aligned to as one version; returns its name.

    Both go into folders of their own, and the version enters the manifest last, so a run that
    stops in between, and a reader that comes in between, leave and see the version before.
    """
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    write_table(aligned, f"{folder}/articles/{version}", fmt, "errorifexists")
    write_table(calendar, f"{folder}/rate/{version}", fmt, "errorifexists")
    aligned.sparkSession.createDataFrame([(version,)], _MANIFEST).coalesce(1).write.mode("append").json(f"{folder}/manifest")
    return version


def read_hand_off(spark: SparkSession, folder: str, articles: T.StructType | str, calendar: T.StructType | str,
                  fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """Articles and calendar of the latest version in the manifest, with the given schemas."""
    version = spark.read.schema(_MANIFEST).json(f"{folder}/manifest").agg(F.max("version")).first()[0]
    if version is None:
        raise FileNotFoundError(f"{folder} holds no finished hand-off")
    return (read_table(spark, f"{folder}/articles/{version}", articles, fmt),
            read_table(spark, f"{folder}/rate/{version}", calendar, fmt))
