"""Article rows to one row per trading day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The statistics taken of every score.
STATISTICS = ("mean", "std", "min", "max")


def aggregate_daily(df: DataFrame, date_col: str, columns: Sequence[str], prefix: str = "",
                    out_date: str = "obs_date") -> DataFrame:
    """Mean, sample deviation, minimum and maximum per day, the article count, nulls as 0.

    One hash aggregate with map-side partials: a day that holds a third of the
    articles is one row per input split by the time it is shuffled.
    """
    take = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    stats = [take[s](F.col(c).cast("double")).alias(f"{c}_{s}") for c in columns for s in STATISTICS]
    daily = (df.groupBy(F.to_date(date_col).alias(out_date))
             .agg(*stats, F.count(F.lit(1)).alias(f"{prefix}news_count")))
    return daily.where(F.col(out_date).isNotNull()).fillna(0)


def daily_vector_mean(df: DataFrame, date_col: str, vector_col: str, size: int, prefix: str = "",
                      out_date: str = "obs_date") -> DataFrame:
    """Mean of every component of an array column per day, as ``<prefix>svd_<i>``."""
    means = [F.avg(F.get(vector_col, F.lit(i)).cast("double")).alias(f"{prefix}svd_{i}")
             for i in range(size)]
    return (df.groupBy(F.to_date(date_col).alias(out_date)).agg(*means)
            .where(F.col(out_date).isNotNull()))


def assemble_daily(first: DataFrame, *others: DataFrame, on: str = "obs_date") -> DataFrame:
    """Left join of daily blocks; each has one row per day at most."""
    for other in others:
        first = first.join(other, on, "left")
    return first
