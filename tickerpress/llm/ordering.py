"""Rows in one global order, dealt over many tasks, with a key that keeps the order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerpress.session import write_through

#: Bits of a row number inside its partition, as Spark's increasing ids have them.
_INSIDE = 33


def in_order(rows: DataFrame, ranges: list, order: list, name: str) -> DataFrame:
    """Write ``rows`` range-partitioned by ``ranges`` and sorted by ``order``; adds ``at`` and ``part``.

    ``at`` ascends in the order of the rows and ``part`` is the range a row lies in.  A group
    of any size is cut where a range ends, so (group, part) is a piece that one task can
    stream.  ``order`` has to begin with ``ranges`` or refine it.
    """
    frozen = write_through(rows, f"{name}-rows")  # sampled first, then sorted: read twice
    at = F.monotonically_increasing_id()
    spread = frozen.repartitionByRange(*ranges).sortWithinPartitions(*order)
    return write_through(spread.withColumn("at", at).withColumn("part", F.shiftright("at", _INSIDE)), f"{name}-order")


def with_run(ordered: DataFrame, group: str, weight: str, run: str) -> DataFrame:
    """Running sum of ``weight`` inside each ``group``, in the order of ``at``.

    Sums run inside the pieces; a piece then adds the sums of its group's earlier pieces, of
    which there are at most as many as ranges.
    """
    inside = Window.partitionBy(group, "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = ordered.groupBy(group, "part").agg(F.sum(weight).alias("_sum"))
    offsets = pieces.select(F.col(group).alias("_group"), F.col("part").alias("_part"),
                            F.sum("_sum").over(earlier).alias("_before")).where("_before is not null")
    joined = ordered.withColumn(run, F.sum(weight).over(inside)).join(
        offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("part") == F.col("_part")), "left")
    return joined.withColumn(run, F.col(run) + F.coalesce("_before", F.lit(0))).drop("_group", "_part", "_before")
