"""Descriptive statistics of prices, news volume and features.

Every statistic is per series.  Windows and exact percentiles run over one
series and split at most, whose rows are bounded by the calendar.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerpress.operators.panel import SPLITS

# Fixed values of the reports.
ROLLING_ROWS = 20
HISTOGRAM_BINS = 40
TOP_CORRELATIONS = 12

#: Permutations of one series that a task takes at once.
PERMUTATIONS = 25


def split_order(split: Column) -> Column:
    """Position of a split in reports."""
    return F.array_position(F.array(*[F.lit(s) for s in SPLITS]), split)


def level_ranges(panel: DataFrame, level: str = "level", series: str = "series_id") -> DataFrame:
    """Minimum, maximum and mean level per split, as whole numbers, in split order."""
    whole = panel.groupBy(series, "split").agg(*[
        F.round(take(level), 0).cast("bigint").alias(f"level_{name}")
        for name, take in (("min", F.min), ("max", F.max), ("mean", F.avg))])
    return whole.orderBy(series, split_order(F.col("split")))


def rolling_mean(panel: DataFrame, column: str, rows: int = ROLLING_ROWS, series: str = "series_id",
                 date: str = "obs_date", out: str = "rolling_mean") -> DataFrame:
    """Mean of the last ``rows`` rows within the split; null until that many are there."""
    w = Window.partitionBy(series, "split").orderBy(date).rowsBetween(1 - rows, 0)
    return panel.withColumn(out, F.when(F.count(column).over(w) == rows, F.avg(column).over(w)))


def _share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def volume_profile(panel: DataFrame, count: str = "news_count",
                   series: str = "series_id") -> DataFrame:
    """Mean, median and largest daily count, and the share of days without news."""
    return panel.groupBy(series, "split").agg(
        F.avg(count).alias("mean_articles"), F.percentile(count, F.lit(0.5)).alias("median_articles"),
        F.max(count).alias("max_articles"), _share(F.col(count) == 0).alias("share_without_news"))


def to_long(df: DataFrame, keep: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``(keep, feature, value)`` rows."""
    wide = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(list(keep), list(columns), "feature", "value")


def with_news(panel: DataFrame, count: str = "news_count") -> DataFrame:
    return panel.where(F.col(count) > 0)


def describe_features(panel: DataFrame, columns: Sequence[str],
                      series: str = "series_id") -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of each feature on days with news."""
    quartiles = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = to_long(with_news(panel), [series], columns).groupBy(series, "feature").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), quartiles.alias("q"),
        F.max("value").alias("max"))
    return stats.select(series, "feature", "n", "mean", "std", "min", F.col("q")[0].alias("q25"),
                        F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")


def _average_rank(column: str, *keys: str) -> Column:
    """Rank from 1; equal values share the mean of their places.

    Values are compared to nine digits: a daily mean may differ in its last bit
    between runs, as partial sums arrive in any order, and must not break a tie.
    """
    value = F.round(column, 9)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (ties - 1) / F.lit(2.0)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; null where a side does not vary."""
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    n, sx, sy = F.count(F.lit(1)), F.avg(x), F.avg(y)
    cov = F.avg(x * y) - sx * sy
    scale = F.sqrt((F.avg(x * x) - sx * sx) * (F.avg(y * y) - sy * sy))
    return F.when(varies & (n > 1), cov / F.when(varies, scale))


def spearman_with_target(panel: DataFrame, columns: Sequence[str], target: str = "diff",
                         series: str = "series_id") -> DataFrame:
    """Rank correlation of each feature with the target; undefined ones left out."""
    long = to_long(panel.where(F.col(target).isNotNull()), [series, target], columns)
    long = long.where("value IS NOT NULL")
    ranked = long.select(series, "feature", _average_rank("value", series, "feature").alias("rx"),
                         _average_rank(target, series, "feature").alias("ry"))
    rho = ranked.groupBy(series, "feature").agg(safe_corr(F.col("rx"), F.col("ry")).alias("rho"))
    return rho.where("rho IS NOT NULL").withColumn("abs_rho", F.abs("rho"))


def top_correlations(panel: DataFrame, columns: Sequence[str], k: int = TOP_CORRELATIONS,
                     target: str = "diff", series: str = "series_id") -> DataFrame:
    """The ``k`` strongest correlations of each series, ties by name."""
    rho = spearman_with_target(panel, columns, target, series)
    strongest = Window.partitionBy(series).orderBy(F.round("abs_rho", 9).desc(), "feature")
    return rho.withColumn("place", F.row_number().over(strongest)).where(F.col("place") <= k)


def spearman_matrix(panel: DataFrame, columns: Sequence[str],
                    series: str = "series_id") -> DataFrame:
    """``(series, a, b, rho)`` for all pairs of the columns, which have no nulls.

    Columns are ranked in one pass over the series; each pair is one aggregate
    expression, so rows are never multiplied by the number of pairs.
    """
    ranks = panel.select(series, *[_average_rank(c, series).alias(c) for c in columns])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = ranks.groupBy(series).agg(*[
        safe_corr(F.col(a), F.col(b)).alias(f"c{n}") for n, (a, b) in enumerate(pairs)])
    entries = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"c{n}").alias("rho"))
               for n, (a, b) in enumerate(pairs) for x, y in {(a, b), (b, a)}]
    return wide.select(series, F.inline(F.array(*entries)))


def split_summary(panel: DataFrame, series: str = "series_id", date: str = "obs_date") -> DataFrame:
    """Days, date and level range, mean news volume and share of rising days per split."""
    return panel.groupBy(series, "split").agg(
        F.count(F.lit(1)).alias("n_days"), F.min(date).alias("first_date"),
        F.max(date).alias("last_date"), F.min("level").alias("level_min"),
        F.max("level").alias("level_max"), F.avg("news_count").alias("articles_per_day"),
        _share(F.col("diff") > 0).alias("share_up"))


def histograms(panel: DataFrame, columns: Sequence[str], bins: int = HISTOGRAM_BINS,
               series: str = "series_id") -> DataFrame:
    """Counts in equal bins between each feature's extremes, on days with news."""
    long = to_long(with_news(panel), [series], columns).where("value IS NOT NULL")
    edges = long.groupBy(series, "feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / F.lit(float(bins)))
    place = F.when(width.isNull(), 0).otherwise(
        F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1)))
    return (long.join(edges, [series, "feature"])
            .groupBy(series, "feature", place.cast("int").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n")))


def profile(panel: DataFrame, articles: DataFrame, calendar: DataFrame, lexicon: Sequence[str],
            vectors: Sequence[str], date: str = "obs_date") -> DataFrame:
    """Sizes and date range of a panel and what it was made from, as ``(item, value)``."""
    days = panel.agg(F.count(F.lit(1)).alias("panel_rows"), F.min(date).alias("first_date"),
                     F.max(date).alias("last_date"))
    n_articles = articles.agg(F.count(F.lit(1))).scalar()
    n_sessions = calendar.agg(F.count(F.lit(1))).scalar()
    return days.select(
        "panel_rows", "first_date", "last_date", n_articles.alias("articles"),
        n_sessions.alias("sessions"), F.lit(len(panel.columns)).alias("panel_columns"),
        F.lit(len(lexicon)).alias("lexicon_features"), F.lit(len(vectors)).alias("vector_features"))


def permutation_null(panel: DataFrame, columns: Sequence[str], n_permutations: int,
                     target: str = "diff", series: str = "series_id", date: str = "obs_date",
                     level: float = 0.95) -> DataFrame:
    """Distribution of the best absolute rank correlation when targets are shuffled.

    Ranks are taken once.  A permutation orders the days by a hash of series, day and
    permutation number, and the target ranks are dealt out in that order.  The unit is a
    block of permutations of one series: one product of the matrix of feature ranks with
    the dealt target ranks, so days are repeated once per block.
    """
    usable = panel.where(F.col(target).isNotNull())
    place = F.row_number().over(Window.partitionBy(series).orderBy(date))
    blocks = F.sequence(F.lit(0), F.lit((n_permutations - 1) // PERMUTATIONS))
    ranks = usable.select(
        series, place.alias("place"), F.concat_ws("|", series, date, F.lit("")).alias("label"),
        _average_rank(target, series).alias("y"),
        F.array(*[_average_rank(c, series) for c in columns]).alias("x"))
    spread = ranks.withColumn("block", F.explode(blocks))

    def strongest(key: tuple, days: pd.DataFrame) -> pd.DataFrame:
        days = days.sort_values("place")
        numbers = range(key[1] * PERMUTATIONS + 1, min((key[1] + 1) * PERMUTATIONS, n_permutations) + 1)
        y = days["y"].to_numpy()
        dealt = np.column_stack([y[_dealt(days["label"], number)] for number in numbers])
        best = _correlations(np.stack(days["x"].to_numpy()), dealt).max(axis=0, initial=0.0)
        return pd.DataFrame({series: key[0], "permutation": list(numbers), "best": best})

    kind = panel.schema[series].dataType.simpleString()
    best = spread.groupBy(series, "block").applyInPandas(
        strongest, f"`{series}` {kind}, permutation int, best double")
    return best.groupBy(series).agg(
        F.count(F.lit(1)).alias("n_permutations"),
        F.percentile("best", F.lit(level)).alias("threshold"), F.avg("best").alias("mean_best"))


def _dealt(labels: pd.Series, number: int) -> np.ndarray:
    """Places in the order of the MD5 of label and permutation number; ties stay in order."""
    tail = str(number).encode()
    digests = b"".join(hashlib.md5(label.encode() + tail).digest() for label in labels)
    halves = np.frombuffer(digests, ">u8").reshape(-1, 2)
    return np.lexsort((halves[:, 1], halves[:, 0]))


def _correlations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Absolute correlation of every column of x with every column of y; 0 where one does not vary.

    Ranks are halves of whole numbers, so the centred sums of a column without spread are exactly 0.
    """
    middle = (len(x) + 1) / 2
    x, y = x - middle, y - middle
    spread = np.sqrt(np.outer((x * x).sum(axis=0), (y * y).sum(axis=0)))
    return np.abs(np.divide(x.T @ y, spread, out=np.zeros_like(spread), where=spread > 0))
