"""From search hits and fetched pages to articles on trading days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerpress.functions import dates as dt
from tickerpress.operators import alignment as al
from tickerpress.operators import cleaning as cl
from tickerpress.operators import extraction as ex
from tickerpress.session import write_through
from tickerpress.sources import hits as hs


def harvest_hits(searches: Sequence[DataFrame], json_col: str = "page", page_no: str = "page_no",
                 floor: str = cl.DATE_FLOOR, source: str | None = None) -> DataFrame:
    """Hits of many searches, each a table of numbered JSON pages: dated, typed, first per url.

    ``ingest_id`` orders them by search, page and place on the page; ``published_at`` is the
    instant of the hit's time, in UTC.
    """
    flat = [cl.exclude_types(cl.date_floor(hs.flatten_hits(s, json_col, [page_no]), "published", floor), "media_type")
            for s in searches]
    merged = cl.merge_hits(flat, "url", [page_no, "position"], source)
    return merged.select(
        F.struct("query_no", page_no, "position").alias("ingest_id"), "url", "title", "media_type",
        *(["source"] if source is not None else []), dt.parse_instant(F.col("published")).alias("published_at"))


def harvest_articles(searches: Sequence[DataFrame], pages: DataFrame, rates: DataFrame,
                     floor: str = cl.DATE_FLOOR, tag: str = ex.BODY_TAG, css_class: str | None = ex.BODY_CLASS,
                     source: str | None = None, json_col: str = "page", page_no: str = "page_no") -> DataFrame:
    """Hits joined with their pages (``url``, ``html``), body text cut out, cleaned and aligned.

    A hit whose page was not fetched has no text and falls at the missing-text step. Bodies are cut
    out once and written: what compares, filters and returns them reads texts, not pages.
    """
    hits = harvest_hits(searches, json_col, page_no, floor, source)
    fetched = hits.join(pages.select("url", "html").dropDuplicates(["url"]), "url", "left")
    articles = write_through(ex.extract_body(fetched, "html", tag=tag, css_class=css_class), "harvested")
    cleaned = cl.clean_articles(articles.where(F.col("full_text") != cl.NO_BODY_TEXT), "full_text", "ingest_id")
    return al.align_to_calendar(cleaned, al.trading_calendar(rates))
