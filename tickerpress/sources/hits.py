"""Search hits: JSON pages to article rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerpress import schemas


def flatten_hits(df: DataFrame, json_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per hit of each JSON page; keys a hit lacks become ``""``.

    ``position`` is the place of the hit in its page, so a later keep-first
    step has an order to go by.
    """
    page = F.from_json(F.col(json_col), schemas.HITS)

    def value(key: str, name: str):
        return F.coalesce(F.col("hit").getField(key), F.lit("")).alias(name)

    return (
        df.select(*keep, F.posexplode_outer(page["results"]).alias("position", "hit"))
        .where("position IS NOT NULL")
        .select(*keep, "position",
                value(schemas.HIT_DATE, "published"), value(schemas.HIT_TYPE, "media_type"),
                value(schemas.HIT_TITLE, "title"), value(schemas.HIT_URL, "url"))
    )
