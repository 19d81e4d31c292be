"""Table layouts of the stages."""

from __future__ import annotations

from pyspark.sql import types as T

RATE = T.StructType([
    T.StructField("series_id", T.StringType()),
    T.StructField("obs_date", T.DateType()),
    T.StructField("level", T.DoubleType()),
])

ARTICLE = T.StructType([
    T.StructField("ingest_id", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("published_at", T.TimestampType()),
    T.StructField("full_text", T.StringType()),
])

#: Long form every forecaster emits and every metric reads.
PREDICTION = T.StructType([
    T.StructField("series_id", T.StringType()),
    T.StructField("obs_date", T.DateType()),
    T.StructField("split", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("y_hat", T.DoubleType()),
])

# The keys of one search hit.
HIT_DATE, HIT_TYPE, HIT_TITLE, HIT_URL = "datePublished", "cn:type", "cn:title", "url"

HITS = T.StructType([
    T.StructField("results", T.ArrayType(T.StructType([
        T.StructField(HIT_DATE, T.StringType()),
        T.StructField(HIT_TYPE, T.StringType()),
        T.StructField(HIT_TITLE, T.StringType()),
        T.StructField(HIT_URL, T.StringType()),
    ]))),
])
