"""Articles to trading days, forward as-of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerpress.functions import dates as dt
from tickerpress.session import write_through


def trading_calendar(rates: DataFrame, date_col: str = "obs_date") -> DataFrame:
    """The distinct trading dates."""
    return rates.select(F.to_date(date_col).alias("session")).where("session IS NOT NULL").distinct()


def session_by_day(calendar: DataFrame) -> DataFrame:
    """``(day, session)``: every day from the first session to the last, with the next session.

    A trading date serves the days since the one before it.  The list of dates
    is one small array, so no window over an unpartitioned table is needed.
    """
    ordered = calendar.agg(F.sort_array(F.collect_set("session")).alias("sessions"))
    spans = ordered.select(F.explode(F.transform(
        "sessions", lambda d, i: F.struct(
            F.coalesce(F.date_add(F.get("sessions", i - 1), 1), d).alias("from_day"),
            d.alias("session")))).alias("s")).select("s.*")
    return spans.select(F.explode(F.sequence("from_day", "session")).alias("day"), "session")


def forward_asof(df: DataFrame, day_col: str, calendar: DataFrame,
                 out_col: str = "adjusted_date") -> DataFrame:
    """The first trading date at or after ``day_col``.

    Days before the calendar go to its first date; days past its end stay, but
    for weekends, which roll to Monday.  The day map has one row per calendar
    day.  It is written, so its size is known: Spark broadcasts it below its
    threshold, and the articles are not shuffled then; beyond it they are.
    """
    first = calendar.agg(F.min("session")).scalar()
    day_map = write_through(session_by_day(calendar).select(
        F.col("day").alias("asof_day"), F.col("session").alias(out_col)), "day-map")
    keyed = df.withColumn("asof_day", F.greatest(F.col(day_col), first))
    joined = keyed.join(day_map, "asof_day", "left")
    return joined.withColumn(out_col, F.coalesce(out_col, dt.roll_weekend(F.col(day_col)))
                             ).drop("asof_day")


def align_to_calendar(articles: DataFrame, calendar: DataFrame, time_col: str = "published_at",
                      zone: str = dt.MARKET_ZONE, cutoff_hour: int = dt.CUTOFF_HOUR,
                      out_col: str = "adjusted_date") -> DataFrame:
    """Market time, after-close shift, next trading date; only ``out_col`` is added."""
    local = dt.to_market_time(articles, time_col, zone)
    shifted = articles.withColumn("news_day", dt.shift_after_close(local, cutoff_hour))
    return forward_asof(shifted, "news_day", calendar, out_col).drop("news_day")


def publication_hours(df: DataFrame, time_col: str, zone: str = dt.MARKET_ZONE,
                      bins: int = 48) -> DataFrame:
    """Histogram of the local time of day, equal bins between its extremes.

    Articles are first counted per minute of the day, at most 1,440 rows; the
    bin edges come from those.
    """
    local = dt.to_market_time(df, time_col, zone)
    per_minute = (df.select(dt.fractional_hour(local).alias("hour"))
                  .where("hour IS NOT NULL").groupBy("hour").agg(F.count(F.lit(1)).alias("n")))
    edges = per_minute.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"),
                           F.collect_list(F.struct("hour", "n")).alias("counts"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    place = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(
        F.floor((F.col("c.hour") - F.col("lo")) / F.when(width > 0, width)), F.lit(bins - 1)))
    return (edges.select("lo", "hi", F.explode("counts").alias("c"))
            .select(place.cast("int").alias("bin"), F.col("c.n").alias("n"))
            .groupBy("bin").agg(F.sum("n").alias("n_articles")))


def hour_band_share(df: DataFrame, time_col: str, from_hour: int = 9, to_hour: int = 15,
                    zone: str = dt.MARKET_ZONE) -> DataFrame:
    """Share of articles with local hour in ``[from_hour, to_hour)``."""
    hour = F.hour(dt.to_market_time(df, time_col, zone))
    inside = ((hour >= from_hour) & (hour < to_hour)).cast("double")
    return df.agg(F.avg(F.coalesce(inside, F.lit(0.0))).alias("share"))
