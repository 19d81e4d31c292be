"""Column expressions over text, which run inside the JVM, and words of Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that count as whitespace: the Unicode spaces and the four separator
# controls.  Patterns that use the class start with the (?U) flag.
SPACE = r"\s\x1C-\x1F"

# Patterns of the cleaning and scoring rules.
PREFIX_PATTERN = f"(?U)^In this article[{SPACE}]*"
URL_PATTERN = f"(?U)https?://[^{SPACE}]+|www\\.[^{SPACE}]+"
NON_LETTER_PATTERN = f"(?U)[^a-zA-Z{SPACE}]"
ALPHA_TOKEN_PATTERN = "[a-zA-Z]+"
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"
NON_WORD_PATTERN = r"[^\p{L}\p{N}_]+"

#: Texts whose terms are counted at a time.
ROWS = 256
_LETTERS = re.compile(ALPHA_TOKEN_PATTERN)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip_space(text: Column) -> Column:
    """Trim every kind of whitespace; SQL ``trim`` takes blanks only."""
    return F.regexp_replace(text, f"(?U)^[{SPACE}]++|[{SPACE}]++$", "")


def strip_prefix(text: Column, pattern: str = PREFIX_PATTERN) -> Column:
    return strip_space(F.regexp_replace(text, pattern, ""))


def remove_links(text: Column) -> Column:
    """URLs out, whitespace runs to one blank, ends trimmed.

    Single blanks, nearly all of the whitespace, are left alone rather than
    replaced by themselves.
    """
    plain = F.regexp_replace(text, URL_PATTERN, "")
    return F.trim(F.regexp_replace(plain, f"(?U)[{SPACE}]{{2,}}|[{SPACE}&&[^ ]]", " "))


def word_count(text: Column) -> Column:
    """Whitespace-separated words; 0 for empty text."""
    return F.regexp_count(text, F.lit(f"(?U)[^{SPACE}]+"))


def clean_ascii(text: Column) -> Column:
    """Everything but ASCII letters and whitespace becomes a blank, then lower case."""
    return F.lower(F.regexp_replace(text_or_empty(text), NON_LETTER_PATTERN, " "))


def alpha_tokens(text: Column) -> Column:
    """The words of ``clean_ascii(text)``, cut straight from the text."""
    words = F.regexp_extract_all(text_or_empty(text), F.lit(ALPHA_TOKEN_PATTERN), F.lit(0))
    return F.transform(words, F.lower)


def word_tokens(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Lower-cased runs of two or more word characters, stop words left out."""
    tokens = F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(WORD_PATTERN), F.lit(0))
    if not stop_words:
        return tokens
    stops = list(stop_words)
    return F.filter(tokens, lambda t: ~t.isin(stops))


def add_bigrams(tokens: Column) -> Column:
    """The tokens followed by each pair of neighbours."""
    pairs = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.concat(tokens, F.zip_with(
        F.slice(tokens, F.lit(1), pairs), F.slice(tokens, F.lit(2), pairs),
        lambda a, b: F.concat_ws(" ", a, b)))


def unnest(df: DataFrame, keep: Sequence[str], array: Column, name: str) -> DataFrame:
    """One row per array element.

    The outer form is used and the null row of an empty array dropped after:
    for a plain ``explode`` Spark adds a filter on the array's size below it,
    which would compute the tokens of every text a second time.
    """
    rows = df.select(*keep, F.explode_outer(array).alias(name))
    return rows.where(F.col(name).isNotNull())


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])))
def term_counts(tokens: pa.Array) -> pa.Array:
    """The distinct tokens of each array with their numbers, ``ROWS`` arrays at a time; none for null."""
    kind = pa.list_(pa.struct([("term", pa.string()), ("n", pa.int64())]))
    return pa.concat_arrays([pa.array([], kind)] + [
        _counted(tokens.slice(i, ROWS)).cast(kind) for i in range(0, len(tokens), ROWS)])


def _counted(rows: pa.Array) -> pa.Array:
    sizes = pc.list_value_length(rows).fill_null(0).to_numpy(zero_copy_only=False)
    coded = rows.flatten().dictionary_encode()
    terms, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keys, n = np.unique(np.repeat(np.arange(len(rows)), sizes) * max(1, len(terms)) + codes, return_counts=True)
    row, code = np.divmod(keys, max(1, len(terms)))
    ends = np.cumsum(np.bincount(row, minlength=len(rows)))
    pairs = pa.StructArray.from_arrays([terms.take(pa.array(code)).cast(pa.string()), pa.array(n.astype(np.int64))], ["term", "n"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pairs)


def spaced_words(text: Column) -> Column:
    """Lower-cased text with a blank for all between words, for ``split_words``: the JVM tells what is a letter."""
    return F.regexp_replace(F.lower(text), NON_WORD_PATTERN, " ")


def split_words(texts: pa.Array, stop_words: Sequence[str] = ()) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of ``spaced_words``: the row and code of each of ``word_tokens``, in order, and the words by code."""
    stops = frozenset(stop_words)
    lists = [[w for w in t.split(" ") if len(w) > 1 and w not in stops] if t else [] for t in texts.to_pylist()]
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    coded = pa.array(chain.from_iterable(lists), pa.string()).dictionary_encode()
    return row, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def split_letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The row and code of each of the ``alpha_tokens`` of texts, and the tokens by code; two codes may have one token."""
    lists = [_LETTERS.findall(t) if t else [] for t in texts.to_pylist()]
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    coded = pa.array(chain.from_iterable(lists), pa.string()).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return row, codes, [w.lower() for w in coded.dictionary.to_pylist()]


def digest(*cols: Column) -> Column:
    """A 32-byte key for text; null if any column is null."""
    if len(cols) == 1:
        return F.unhex(F.sha2(cols[0].cast("string"), 256))
    parts = F.concat(*[F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"),
                                c.cast("string")) for c in cols])
    return F.unhex(F.sha2(parts, 256))
