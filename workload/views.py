"""Price, news and HTML views of the given tables, in Spark and as DuckDB text.

Every view reads its whole table.  The lexicon of the views is made of words
the generated prose contains, as the default lists hardly hit it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerpress.functions.dates import roll_weekend
from tickerpress.sources.tables import spread
from tickerpress.operators.scoring import Lexicon, ValenceRules

ZONE_SHIFT = "INTERVAL 7 HOUR"  # the market zone has no daylight saving time

WORDS = {
    "positive": ["the", "and", "is", "for"],
    "negative": ["of", "to", "that", "was"],
    "uncertainty": ["in", "a", "it", "that"],
}
LEXICON = Lexicon(WORDS["positive"], WORDS["negative"], WORDS["uncertainty"])
VALENCE = {**{w: 1.5 for w in WORDS["positive"]}, **{w: -1.2 for w in WORDS["negative"]}}
BOOSTERS, DAMPENERS, NEGATIONS = ["it", "le", "el"], ["on", "les"], ["in", "de", "und"]
RULES = ValenceRules(BOOSTERS, DAMPENERS, NEGATIONS, contrast="as")
PLAIN_RULES = ValenceRules(context=False)
STOP_WORDS = ["the", "and", "of", "to", "in", "de", "la", "le", "der", "die", "un", "it"]


def sql_list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _daily_price(orders: DataFrame, *keys) -> DataFrame:
    """Mean price per weekday, in whole cents so that both engines round alike.

    What is ordered at a weekend counts for the Monday after.
    """
    return (orders.groupBy(*keys, roll_weekend(F.to_date("o_orderdate")).alias("obs_date"))
            .agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("s"),
                 F.count(F.lit(1)).alias("n"))
            .select("series_id", "obs_date",
                    (F.expr("(2 * s + n) div (2 * n)").cast("double") / 100.0).alias("level")))


def rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily_price(table(spark, sf_dir, "orders"), F.lit("ALL").alias("series_id"))


def rate_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily_price(table(spark, sf_dir, "orders"), F.col("o_orderpriority").alias("series_id"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Titles are cut ahead of the join, so that what reads titles alone does not shuffle whole texts.
    docs = spread(table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.split("text", "\n", 2)[0].alias("title"), "text"), "doc_id")
    dates = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderdate")
    seconds = (F.col("doc_id") * 7919 % 86400).cast("int")
    return docs.join(dates, "doc_id").select(
        F.col("doc_id").alias("ingest_id"), "source",
        "title",
        F.concat(F.lit("u"), (F.col("doc_id") % 900).cast("string")).alias("url"),
        (F.col("o_orderdate") + F.make_dt_interval(secs=seconds)).alias("published_at"),
        F.col("text").alias("full_text"))


def news_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("ingest_id")
    text = F.concat(F.when(i % 7 == 0, F.lit("In this article\n")).otherwise(""), F.col("full_text"),
                    F.when(i % 11 == 0, F.lit(" https://example.com/x")).otherwise(""))
    return news(spark, sf_dir).withColumns({
        "full_text": F.when(i % 50 != 0, text),
        "media_type": F.when(i % 10 == 0, "Video Clip").when(i % 10 == 1, "LiveBlog")
                       .otherwise("article"),
    })


_LEVEL = """CAST((2 * sum(CAST(round(o_totalprice * 100) AS BIGINT)) + count(*))
                               // (2 * count(*)) AS DOUBLE) / CAST(100 AS DOUBLE) AS level"""

_ROLLED = """CAST(CAST(o_orderdate AS DATE) + (CASE dayofweek(o_orderdate)
                               WHEN 6 THEN 2 WHEN 0 THEN 1 ELSE 0 END) AS DATE)"""

DUCK = {
    "rate": f"""
        rate AS (SELECT 'ALL' AS series_id, {_ROLLED} AS obs_date,
                        {_LEVEL}
                 FROM orders GROUP BY 2)""",
    "rate_multi": f"""
        rate_multi AS (SELECT o_orderpriority AS series_id, {_ROLLED} AS obs_date,
                              {_LEVEL}
                       FROM orders GROUP BY 1, 2)""",
    "news": """
        news AS (SELECT doc_id AS ingest_id, source, split_part(text, chr(10), 1) AS title,
                        'u' || (doc_id % 900) AS url,
                        o_orderdate + to_seconds(doc_id * 7919 % 86400) AS published_at,
                        text AS full_text
                 FROM documents JOIN orders ON o_orderkey = doc_id)""",
    "news_dirty": """
        news_dirty AS (SELECT ingest_id, source, title, url, published_at,
            CASE WHEN ingest_id % 50 <> 0 THEN
                 (CASE WHEN ingest_id % 7 = 0 THEN 'In this article' || chr(10) ELSE '' END)
                 || full_text
                 || (CASE WHEN ingest_id % 11 = 0 THEN ' https://example.com/x' ELSE '' END) END
                 AS full_text,
            CASE ingest_id % 10 WHEN 0 THEN 'Video Clip' WHEN 1 THEN 'LiveBlog' ELSE 'article' END
                 AS media_type
            FROM news)""",
    # Forward as-of alignment of the news view to the rate view.
    "aligned": f"""
        calendar AS (SELECT DISTINCT obs_date AS session FROM rate),
        local_news AS (SELECT *, published_at + {ZONE_SHIFT} AS local_time FROM news),
        shifted AS (SELECT *, CAST(local_time AS DATE)
                        + (CASE WHEN hour(local_time) >= 15 THEN 1 ELSE 0 END) AS news_day
                    FROM local_news),
        aligned AS (SELECT s.* EXCLUDE (local_time, news_day), s.news_day,
                        coalesce(c.session, s.news_day + (CASE dayofweek(s.news_day)
                            WHEN 6 THEN 2 WHEN 0 THEN 1 ELSE 0 END)) AS adjusted_date
                    FROM shifted s ASOF LEFT JOIN calendar c ON s.news_day <= c.session)""",
}
_NEEDS = {"news_dirty": ["news"], "aligned": ["rate", "news"]}


def ctes(*names: str, tail: str = "") -> str:
    """``WITH`` clause for the views and what they build on, and more CTEs."""
    order: list[str] = []
    for name in names:
        for n in (*_NEEDS.get(name, []), name):
            if n not in order:
                order.append(n)
    parts = [DUCK[n].strip() for n in order] + ([tail.strip()] if tail.strip() else [])
    return "WITH " + ",\n".join(parts) + "\n"


def r(expr: str, digits: int = 6) -> str:
    """Rounded double without a negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round double columns (all of them by default) for comparison."""
    names = columns or [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in names})
