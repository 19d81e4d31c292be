"""Article body text out of fetched HTML."""

from __future__ import annotations

import html as html_rules
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerpress.functions import text as tx
from tickerpress.operators.cleaning import NO_BODY_TEXT

# The container that holds an article body.
BODY_TAG, BODY_CLASS = "div", "ArticleBody-articleBody"

_MARK = "\u0001"
#: What may hold tags that are none: scripts, styles and comments.
_HIDDEN = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where the value is computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def container_html(html: Column, tag: str, css_class: str | None = None) -> Column:
    """Inner HTML of the first matching element, or null.

    Scripts, styles and comments go first, so tags inside them do not count.
    The text after the opening tag is cut at every further opening or closing
    tag of the same name; the element ends where the nesting depth returns to 0.
    """
    wanted = rf'[^>]*\bclass\s*=\s*["\']?[^"\'>]*(?<![\w-]){css_class}(?![\w-])' if css_class else ""
    opening = rf"(?is)<{tag}\b{wanted}[^>]*>"
    rest = F.get(F.split(F.regexp_replace(html, _HIDDEN, ""), opening, 2), F.lit(1))

    def inner(pieces: Column) -> Column:
        # Running state: depth, and how many pieces lie before the closing tag.
        scan = F.aggregate(
            pieces, F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n")),
            lambda s, p: F.when(s["depth"] == 0, s).otherwise(F.struct(
                (s["depth"] + F.when(p.rlike(rf"(?i)^</{tag}\b"), -1)
                 .when(p.rlike(rf"(?i)^<{tag}\b"), 1).otherwise(0)).alias("depth"),
                (s["n"] + F.when((s["depth"] == 1) & p.rlike(rf"(?i)^</{tag}\b"), 0).otherwise(1))
                .alias("n"))))
        return F.array_join(F.slice(pieces, F.lit(1), scan["n"]), "")

    return _once(F.split(rest, rf"(?i)(?=</?{tag}\b)"), inner)


@F.pandas_udf(T.ArrayType(T.StringType()))
def unescape(texts: pd.Series) -> pd.Series:
    """Character references of all kinds, named and numeric, for what they stand for."""
    return texts.map(lambda row: None if row is None else [
        t if t is None or "&" not in t else html_rules.unescape(t) for t in row])


def paragraph_text(inner: Column) -> Column:
    """Paragraphs, tags removed, each trimmed, joined by one blank.

    A paragraph ends at its closing tag, the next opening one, or the end of
    the container; unclosed paragraphs do not nest.
    """
    marked = F.regexp_replace(inner, r"(?i)<p(\s[^>]*)?>", _MARK)
    plain = F.transform(
        _once(F.split(marked, _MARK), lambda cut: F.slice(cut, F.lit(2), F.size(cut))),
        lambda p: F.regexp_replace(F.split(p, r"(?i)</p\s*>", 2)[0], r"(?s)<[^>]*>", ""))
    # Only rows that hold a reference go through Python.
    texts = F.coalesce(unescape(F.when(inner.contains("&"), plain)), plain)
    return F.array_join(F.transform(texts, tx.strip_space), " ")


def extract_body(df: DataFrame, html_col: str, out_col: str = "full_text", tag: str = BODY_TAG,
                 css_class: str | None = BODY_CLASS) -> DataFrame:
    """Replace a page by its article text; the sentinel text where there is no container.

    A null page, one that could not be fetched, stays missing: its text is null.
    """
    inner = df.withColumn("inner_html", container_html(F.col(html_col), tag, css_class))
    inner = inner.withColumn("body_", paragraph_text(F.coalesce("inner_html", F.lit(""))))
    body = F.when(F.col(html_col).isNull(), None).when(
        F.col("inner_html").isNull(), F.lit(NO_BODY_TEXT)).otherwise(F.col("body_"))
    return inner.withColumn(out_col, body).drop("inner_html", "body_", html_col)
