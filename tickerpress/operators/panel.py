"""Prices and lagged features as a chronologically split panel.

A panel has one row per series and trading day.  Windows run per series, so the
longest partition is one calendar (some 25,000 rows for a century) whatever the
number of series; ``difference`` fails on a repeated day rather than letting a
partition grow past that.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Split bounds as shares of the rows.
TRAIN_SHARE, VAL_SHARE = 0.7, 0.85
SPLITS = ("train", "val", "test")
# Columns that are never features.
PRICE_COLUMNS = ("series_id", "obs_date", "level", "diff", "diff_lag1", "split", "row_no")
AR_LAG = "diff_lag1"


def _by_series(series: str, date: str):
    return Window.partitionBy(series).orderBy(date)


def join_features(rates: DataFrame, features: DataFrame, date: str = "obs_date",
                  stray: Sequence[str] = ("level",)) -> DataFrame:
    """Every price row, with that day's features where there are any.

    Price columns that found their way into the features are dropped.  Features
    have one row per day; the planner picks the join from their actual size.
    """
    extra = [c for c in stray if c in features.columns]
    return rates.join(features.drop(*extra), date, "left")


def difference(df: DataFrame, level: str = "level", series: str = "series_id",
               date: str = "obs_date", out: str = "diff") -> DataFrame:
    """Change from the row before; fails if a series repeats a day."""
    w = _by_series(series, date)
    before = F.when(F.lag(date).over(w) == F.col(date),
                    F.raise_error(F.lit("a series has two rows for one day")).cast("double")
                    ).otherwise(F.lag(level).over(w))
    return df.withColumn(out, F.col(level) - before)


def lag_target(df: DataFrame, target: str = "diff", series: str = "series_id",
               date: str = "obs_date", out: str = AR_LAG) -> DataFrame:
    return df.withColumn(out, F.lag(target).over(_by_series(series, date)))


def lag_features(df: DataFrame, columns: Sequence[str], series: str = "series_id",
                 date: str = "obs_date") -> DataFrame:
    """Each feature from the row before, so the day's own news is never seen."""
    w = _by_series(series, date)
    lagged = set(columns)
    return df.select(*[F.lag(c).over(w).alias(c) if c in lagged else F.col(c) for c in df.columns])


def neutral_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.fillna(0.0, subset=list(columns)) if columns else df


def drop_incomplete(df: DataFrame, columns: Sequence[str] = ("diff", AR_LAG)) -> DataFrame:
    return df.dropna(subset=list(columns))


def split_rows(df: DataFrame, series: str = "series_id", date: str = "obs_date",
               train: float = TRAIN_SHARE, val: float = VAL_SHARE) -> DataFrame:
    """Label rows train, val or test by position in date order, per series."""
    w = _by_series(series, date)
    n = F.count(F.lit(1)).over(Window.partitionBy(series))
    placed = df.withColumn("row_no", F.row_number().over(w) - 1).withColumn("n_rows", n)

    def bound(share):
        return F.floor(F.col("n_rows") * F.lit(float(share)))

    label = (F.when(F.col("row_no") < bound(train), "train")
             .when(F.col("row_no") < bound(val), "val").otherwise("test"))
    return placed.withColumn("split", label).drop("row_no", "n_rows")


def cutoff_date(rates: DataFrame, share: float = TRAIN_SHARE, series: str = "series_id",
                date: str = "obs_date") -> DataFrame:
    """``(series, cutoff)``: the date at row ``int(share * n)`` of each whole calendar."""
    days = rates.groupBy(series).agg(F.sort_array(F.collect_list(date)).alias("days"))
    place = F.floor(F.size("days") * F.lit(float(share))).cast("int")
    return days.select(series, F.get("days", place).alias("cutoff"))


def union_splits(*labelled: tuple[str, DataFrame]) -> DataFrame:
    """Separate split tables as one table with a ``split`` column."""
    tables = [df.withColumn("split", F.lit(name)) for name, df in labelled]
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def only_splits(df: DataFrame, *names: str) -> DataFrame:
    return df.where(F.col("split").isin(*names))


def feature_columns(columns: Sequence[str], pattern: str | None = None,
                    prefixes: Sequence[str] = (), exclude: Sequence[str] = PRICE_COLUMNS,
                    wanted: Sequence[str] | None = None) -> list[str]:
    """Column names by pattern, prefix, exclusion and, for a wished list, existence."""
    if wanted is not None:
        return [c for c in wanted if c in columns]
    return [c for c in columns
            if c not in exclude
            and (pattern is None or re.search(pattern, c))
            and (not prefixes or c.startswith(tuple(prefixes)))]


def lexicon_columns(columns: Sequence[str]) -> list[str]:
    return feature_columns(columns, r"vader|lm_")


def vector_columns(columns: Sequence[str]) -> list[str]:
    return feature_columns(columns, r"svd_")


def model_columns(columns: Sequence[str]) -> list[str]:
    """Predictors of the tree models: everything known the day before, bar the news volume."""
    return [AR_LAG, *feature_columns(columns, exclude=(*PRICE_COLUMNS, "news_count"))]


def build_panel(rates: DataFrame, features: DataFrame) -> DataFrame:
    """Join, difference, lag, fill, drop, split."""
    joined = join_features(rates, features)
    names = feature_columns(joined.columns)
    lagged = lag_features(lag_target(difference(joined)), names)
    return split_rows(drop_incomplete(neutral_fill(lagged, names)))


def level_forecast(df: DataFrame, level: str = "level", diff: str = "diff",
                   prediction: str = "y_hat") -> DataFrame:
    """Yesterday's level and the level the predicted change leads to."""
    return (df.withColumn("level_before", F.col(level) - F.col(diff))
            .withColumn("level_hat", F.col("level_before") + F.col(prediction)))
