"""Price table normalisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerpress.functions.dates import parse_mixed_date

# Date spellings a downloaded fixing table may use.
DATE_FORMATS = ("yyyy-MM-dd", "M/d/yyyy h:mm:ss a", "dd/MM/yyyy", "d MMM yyyy")


def project_rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Only the named columns, under their new names."""
    return df.select(*[F.col(old).alias(new) for old, new in names.items()])


def normalise_dates(df: DataFrame, date_col: str,
                    formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    return df.withColumn(date_col, parse_mixed_date(F.col(date_col), formats))


def sort_by_date(df: DataFrame, date_col: str, *then: str) -> DataFrame:
    """A total order by date: a range-partitioned sort, each partition one date range."""
    return df.orderBy(date_col, *then)


def normalise_rates(df: DataFrame, names: Mapping[str, str], date_col: str = "obs_date",
                    formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    return sort_by_date(normalise_dates(project_rename(df, names), date_col, formats), date_col)
