"""Article harvest and cleaning.

Rows are identified by a unique ``order`` column (an ingest id).  "Keep first"
means the smallest order value, so the result does not depend on file order.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerpress.functions import text as tx
from tickerpress.operators.near_duplicates import drop_near_duplicates
from tickerpress.session import write_through

# Harvest floor, excluded media types, shortest article kept.
DATE_FLOOR = "2021-09-01"
EXCLUDED_TYPES = ("video", "live")
MIN_WORDS = 30
# Texts that stand for a missing article body.
NO_BODY_TEXT = "No full text available (Video/Live Blog)"
FETCH_ERROR_TEXT = "Error fetching text"


def date_floor(df: DataFrame, date_col: str, floor: str = DATE_FLOOR) -> DataFrame:
    """Rows dated at or after ``floor``; for ISO strings the comparison is lexical."""
    bound = F.lit(floor)
    if df.schema[date_col].dataType.typeName() != "string":
        bound = bound.cast(df.schema[date_col].dataType)
    return df.where(F.col(date_col) >= bound)


def exclude_types(df: DataFrame, type_col: str,
                  words: Sequence[str] = EXCLUDED_TYPES) -> DataFrame:
    """Drop rows whose type contains one of the words, in any case."""
    kind = F.lower(F.coalesce(F.col(type_col), F.lit("")))
    found = reduce(lambda a, b: a | b, [kind.contains(w) for w in words])
    return df.where(~found)


def keep_first(df: DataFrame, keys: Sequence[str] | Sequence[Column], order: str) -> DataFrame:
    """One row per key: the one with the smallest ``order``; rows without a key go.

    The grouping shuffles 32-byte digests and ids only and combines map-side,
    so a key that holds a third of all rows reaches its reducer as one small
    row per input split.  Only the losers, rows of keys that occur again, then meet
    the wide rows, on the unique id, which cannot skew.  They are written first: few
    losers are broadcast by their known size, and no wide row is shuffled.
    """
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    keyed = write_through(df.select(tx.digest(*columns).alias("key"), order), "keys")
    again = write_through(keyed.groupBy("key").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
                          .where("n > 1 AND key IS NOT NULL").select("key", "first"), "repeated-keys")
    later = keyed.join(again, "key").where(F.col(order) > F.col("first")).select(order)
    losers = write_through(later.unionByName(keyed.where("key IS NULL").select(order)), "losers")
    return df.join(losers, order, "left_anti")


def merge_hits(hits: Iterable[DataFrame], key: str = "url", order: Sequence[str] = ("position",),
               source: str | None = None) -> DataFrame:
    """Union the hits of many searches and keep the first per key.

    The order is the number of the search, then ``order`` within it.  Hits carry
    no article text yet, so the whole row travels as the aggregate's value.
    """
    numbered = [h.withColumn("query_no", F.lit(n)) for n, h in enumerate(hits)]
    merged = reduce(lambda a, b: a.unionByName(b), numbered)
    rest = [c for c in merged.columns if c not in (key, "query_no", *order)]
    row = F.struct("query_no", *order, *rest)
    kept = merged.groupBy(key).agg(F.min(row).alias("row")).select("row.*", key)
    kept = kept.select(*[c for c in merged.columns])
    return kept.withColumn("source", F.lit(source)) if source is not None else kept


def drop_missing(df: DataFrame, columns: Sequence[str], empty_is_missing: bool = False) -> DataFrame:
    """Drop rows without the required texts; a CSV round trip makes ``""`` missing too."""
    kept = df.dropna(subset=list(columns))
    if empty_is_missing:
        for c in columns:
            kept = kept.where(F.col(c) != "")
    return kept


def exact_dedupe(df: DataFrame, text_col: str, order: str) -> DataFrame:
    """Keep the first of the rows with the same whole text."""
    return keep_first(df, [text_col], order)


def strip_boilerplate(df: DataFrame, text_col: str, pattern: str = tx.PREFIX_PATTERN) -> DataFrame:
    return df.withColumn(text_col, tx.strip_prefix(F.col(text_col), pattern))


def min_words(df: DataFrame, text_col: str, n: int = MIN_WORDS) -> DataFrame:
    return df.where(tx.word_count(F.col(text_col)) >= n)


def strip_links(df: DataFrame, text_col: str) -> DataFrame:
    return df.withColumn(text_col, tx.remove_links(F.col(text_col)))


def clean_articles(df: DataFrame, text_col: str, order: str, n_words: int = MIN_WORDS,
                   links: bool = False, near: bool = False,
                   stop_words: Sequence[str] | None = None) -> DataFrame:
    """Missing text, exact copies, boilerplate, short texts: in that order.

    Copies are told apart before the prefix goes, so two texts that become
    equal only afterwards both stay.  ``near`` drops near duplicates as well, with
    ``stop_words`` left out of the comparison; ``links`` also removes URLs.
    """
    kept = drop_missing(df, [text_col], empty_is_missing=True)
    kept = exact_dedupe(kept, text_col, order)
    kept = min_words(strip_boilerplate(kept, text_col), text_col, n_words)
    if near:
        # Read several times from here on, and each of the steps before shuffles texts.
        kept = write_through(kept, "kept", "zstd")
        kept = drop_near_duplicates(kept, order, text_col, stop_words=stop_words)
    return strip_links(kept, text_col) if links else kept


def cleaning_report(df: DataFrame, text_col: str, n_words: int = MIN_WORDS,
                    empty_is_missing: bool = True, near_order: str | None = None,
                    stop_words: Sequence[str] | None = None) -> DataFrame:
    """Rows left after each step, as ``(step_no, step, n_rows)``, from one pass.

    Whether a text is long enough depends on the text alone, so one aggregate
    per distinct text carries all counts.  With ``near_order``, the column that tells
    which article comes first, the near duplicates are dropped and counted too.
    """
    if near_order is not None:
        df = write_through(df.select(near_order, text_col), "texts", "zstd")
    text = F.col(text_col)
    if empty_is_missing:
        text = F.when(text != "", text)
    per_text = df.groupBy(tx.digest(text).alias("key")).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(tx.word_count(tx.strip_prefix(text)) >= n_words).alias("long_enough"))
    present = F.col("key").isNotNull()
    totals = per_text.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("start"),
        F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("with_text"),
        F.count("key").alias("distinct_text"),
        F.count(F.when(present & F.col("long_enough"), 1)).alias("long_enough"))
    steps = "1, 'start', start, 2, 'drop_missing', with_text, 3, 'exact_dedupe', distinct_text, 4, 'min_words', long_enough"
    report = totals.selectExpr(f"stack(4, {steps}) AS (step_no, step, n_rows)")
    if near_order is None:
        return report
    left = clean_articles(df, text_col, near_order, n_words, near=True, stop_words=stop_words)
    return report.unionByName(left.agg(F.lit(5).alias("step_no"), F.lit("near_duplicates").alias("step"),
                                       F.count(F.lit(1)).alias("n_rows")))
