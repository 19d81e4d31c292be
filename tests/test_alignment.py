import datetime as dtm

import pytest
from pyspark.sql import functions as F

from tickerpress.functions import dates as dt
from tickerpress.operators import alignment as al
from tickerpress.operators import prices as pr

D = dtm.date


def calendar(spark, *days):
    return al.trading_calendar(spark.createDataFrame([(d,) for d in days], "obs_date date"))


@pytest.fixture(scope="module")
def week(spark):
    # Monday 8 January 2024 is a holiday; the calendar ends on Thursday the 11th.
    return calendar(spark, D(2024, 1, 4), D(2024, 1, 5), D(2024, 1, 9), D(2024, 1, 10), D(2024, 1, 11))


CASES = [
    ("2024-01-05 07:59:59", D(2024, 1, 5)),   # 14:59:59 local
    ("2024-01-05 08:00:00", D(2024, 1, 9)),   # 15:00:00 local, over weekend and holiday
    ("2024-01-04 17:00:00", D(2024, 1, 5)),   # midnight local
    ("2023-06-01 00:00:00", D(2024, 1, 4)),   # before the calendar
    ("2024-01-11 09:00:00", D(2024, 1, 12)),  # past the end, weekday
    ("2024-01-13 01:00:00", D(2024, 1, 15)),  # past the end, Saturday
    ("2024-01-12 09:00:00", D(2024, 1, 15)),  # past the end, Friday after close
    ("2024-01-14 01:00:00", D(2024, 1, 15)),  # past the end, Sunday
]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_alignment_cases(spark, week, kind):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id int, t string")
    df = df.select("id", F.col("t").cast(kind).alias("published_at"))
    got = {r["id"]: r["adjusted_date"] for r in al.align_to_calendar(df, week).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}
    assert al.align_to_calendar(df, week).columns == ["id", "published_at", "adjusted_date"]


def test_alignment_does_not_depend_on_the_session_zone(spark, week):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id int, t string")
    stamped = df.select("id", F.expr("to_timestamp(t || '+00:00')").alias("published_at"))
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = {r["id"]: r["adjusted_date"] for r in al.align_to_calendar(stamped, week).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_articles_are_not_shuffled(spark, week):
    df = spark.range(10).select(F.expr("timestamp '2024-01-05 00:00:00'").alias("published_at"))
    plan = al.align_to_calendar(df, week)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_empty_calendar_only_rolls_weekends(spark):
    df = spark.createDataFrame([(D(2024, 1, 6),), (D(2024, 1, 3),)], "d date")
    got = sorted(r["adjusted_date"] for r in al.forward_asof(df, "d", calendar(spark, D(2024, 1, 1))
                                                             .where("false")).collect())
    assert got == [D(2024, 1, 3), D(2024, 1, 8)]


def test_dates_in_several_spellings(spark):
    df = spark.createDataFrame([("2024-02-03",), ("2/3/2024 12:00:00 AM",), ("13/02/2024",), ("x",)],
                               "Tanggal string")
    got = [r[0] for r in pr.normalise_dates(df, "Tanggal").collect()]
    assert got == [D(2024, 2, 3), D(2024, 2, 3), D(2024, 2, 13), None]


def test_histogram_and_share(spark):
    df = spark.sql("""SELECT CAST(t AS TIMESTAMP) AS t FROM VALUES ('2024-01-01 00:00:00'),
        ('2024-01-01 02:00:00'), ('2024-01-01 08:30:00'), ('2024-01-01 16:59:00') AS v(t)""")
    # Local hours 7, 9, 15.5 and 23.98.
    got = {r["bin"]: r["n_articles"] for r in al.publication_hours(df, "t", bins=2).collect()}
    assert got == {0: 2, 1: 2}
    assert al.hour_band_share(df, "t").first()["share"] == 0.25


def test_instants_with_and_without_offsets(spark):
    eight = ["2024-01-05T15:00:00+0700", "2024-01-05T15:00:00+07:00", "2024-01-05T15:00:00+07", "2024-01-05T08:00:00Z",
             "2024-01-05 08:00:00", "Fri, 05 Jan 2024 08:00:00 GMT", "2024-01-05T02:30:00.000-0530", " 2024-01-05T08:00 "]
    df = spark.createDataFrame([(t,) for t in [*eight, "", None, "rubbish"]], "t string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [r[0] for r in df.select(dt.parse_instant(F.col("t")).cast("string")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == ["2024-01-05 08:00:00"] * 8 + [None] * 3
    with pytest.raises(Exception, match="not an instant: rubbish"):
        df.select(dt.parse_instant(F.col("t"), strict=True)).collect()


def test_texts_are_no_times(spark):
    with pytest.raises(TypeError):
        dt.to_market_time(spark.createDataFrame([("2024-01-05",)], "t string"), "t")
