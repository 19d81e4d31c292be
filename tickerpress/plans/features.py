"""From raw articles and prices to the daily feature table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerpress.operators import alignment as al
from tickerpress.operators import cleaning as cl
from tickerpress.operators import daily as da
from tickerpress.operators import panel as pn
from tickerpress.operators import scoring as sc
from tickerpress.operators import vectors as vc
from tickerpress.session import write_through

TITLE, BODY = "title", "full_text"
# Prefixes of the two texts' score columns.
PREFIXES = {TITLE: "title_", BODY: "text_"}


def prepare_articles(raw: DataFrame, rates: DataFrame, order: str = "ingest_id",
                     time_col: str = "published_at") -> DataFrame:
    """Cleaned articles with their trading day."""
    cleaned = cl.clean_articles(raw, BODY, order)
    return al.align_to_calendar(cleaned, al.trading_calendar(rates), time_col)


def training_cutoff(rates: DataFrame, share: float = pn.TRAIN_SHARE):
    """The date texts must precede to take part in fitting, from the whole calendar."""
    days = rates.select(F.lit(0).alias("series_id"), "obs_date").distinct()
    return pn.cutoff_date(days, share).select("cutoff").scalar()


def extract_features(articles: DataFrame, rates: DataFrame, lexicon: sc.Lexicon | None = None,
                     valence: Mapping[str, float] | None = None,
                     rules: sc.ValenceRules | None = None, stop_words: Sequence[str] | None = None,
                     date_col: str = "adjusted_date", title: tuple[int, int] = (vc.TITLE_TERMS, vc.TITLE_RANK),
                     body: tuple[int, int] = (vc.BODY_TERMS, vc.BODY_RANK),
                     min_df: int = vc.MIN_DOC_FREQ) -> DataFrame:
    """Daily lexicon and valence statistics, article counts and mean text vectors.

    Vocabulary and components are fitted on articles before the cutoff only.
    The prepared articles are written once, as they come from a scan, a dedupe and a join;
    scoring, fitting and projecting read that table, and shuffle daily partial
    aggregates only.
    """
    texts = write_through(articles.select(date_col, TITLE, BODY).dropna(subset=[TITLE, BODY]), "prepared")
    scored = sc.score_texts(texts, PREFIXES, lexicon, valence, rules)
    blocks = [da.aggregate_daily(scored, date_col, sc.score_columns(list(PREFIXES.values()), bool(valence)))]
    train = vc.before_cutoff(texts, date_col, training_cutoff(rates))
    for column, (terms, rank) in ((TITLE, title), (BODY, body)):
        tfidf, svd = vc.fit_tfidf_svd(train, column, terms, rank, min_df, stop_words)
        blocks.append(vc.transform_daily(texts, date_col, column, tfidf, svd, PREFIXES[column]))
    return da.assemble_daily(*blocks)
