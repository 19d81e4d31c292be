"""TF-IDF and truncated SVD of article text.

Fitting is one distributed aggregate whose result has at most ``max_features``
rows; the transform is map-only, with the fitted vocabulary in every task,
so articles are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerpress.functions import text as tx
from tickerpress.operators.svd import leading_pairs
from tickerpress.session import write_through

# Vocabulary floor and sizes for titles and bodies.
MIN_DOC_FREQ = 5
TITLE_TERMS, TITLE_RANK = 1_000, 25
BODY_TERMS, BODY_RANK = 3_000, 50
#: Weights projected at a time.
ENTRIES = 1 << 16
#: Terms of a text and their numbers.
COUNTED = T.StructType([T.StructField(x, T.ArrayType(T.IntegerType())) for x in ("terms", "counts")])


def english_stop_words() -> list[str]:
    """Spark's English list, the default; any other list can be passed instead."""
    return StopWordsRemover.loadDefaultStopWords("english")


def with_terms(df: DataFrame, text_col: str, stop_words: Sequence[str], bigrams: bool = True,
               out: str = "terms") -> DataFrame:
    """Add the term array; stop words go before neighbours are paired."""
    staged = df.withColumn("tokens_", tx.word_tokens(F.col(text_col), stop_words))
    value = tx.add_bigrams(F.col("tokens_")) if bigrams else F.col("tokens_")
    return staged.withColumn(out, value).drop("tokens_")


def term_stream(df: DataFrame, id_col: str, text_col: str, stop_words: Sequence[str],
                bigrams: bool = True, counted: bool = False) -> DataFrame:
    """``(id, term)``, one row per occurrence, or if ``counted`` ``(id, term, n)``, one row per term of a text."""
    staged = with_terms(df.select(id_col, text_col), text_col, stop_words, bigrams)
    if counted:
        return tx.unnest(staged, [id_col], tx.term_counts("terms"), "t").select(id_col, "t.term", "t.n")
    return tx.unnest(staged, [id_col], F.col("terms"), "term")


def term_counts(df: DataFrame, id_col: str, text_col: str, stop_words: Sequence[str],
                bigrams: bool = True, partitions: int | None = None) -> DataFrame:
    """``(id, term, n)``, one row per term of an id.

    The terms of a text are counted inside its row, which is all there is for an id that comes once.
    Only terms of ids that come again are shuffled, to ``partitions`` partitions, and added up.
    """
    n_rows = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    again = write_through(n_rows.where("n > 1").select(F.col(id_col).alias("again_")), "repeated-ids")
    same = F.col(id_col).eqNullSafe(F.col("again_"))
    once, shared = (term_stream(df.join(again, same, how), id_col, text_col, stop_words, bigrams, counted=True)
                    for how in ("left_anti", "left_semi"))
    dealt = shared.repartition(partitions, id_col, "term") if partitions else shared
    return once.unionByName(dealt.groupBy(id_col, "term").agg(F.sum("n").alias("n")))


def term_statistics(df: DataFrame, text_col: str, stop_words: Sequence[str],
                    bigrams: bool = True) -> DataFrame:
    """``(term, tf, df)`` over the corpus, plus a row with a null term whose ``df`` is its size.

    Texts are cut and their terms counted in Arrow, ``tx.ROWS`` at a time, each batch a row per term
    with both counts; a map-side combined aggregate adds them up, without a shuffle per text.
    """
    stops = list(stop_words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), tx.ROWS):
                yield _statistics(batch.column(0).slice(at, tx.ROWS), stops, bigrams)

    spaced = df.select(tx.spaced_words(F.col(text_col)).alias("text"))
    parts = spaced.mapInArrow(count, "term string, tf long, df long")
    return parts.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def _statistics(texts: pa.Array, stops: Sequence[str], bigrams: bool) -> pa.RecordBatch:
    row, code, words = tx.split_words(texts, stops)
    found = [(words, *_occurrences(row, code, len(words)))]
    if bigrams:
        pair_row, pair = _neighbours(row, code, len(words))
        pairs, place = np.unique(pair, return_inverse=True)
        first, second = (words.take(pa.array(c)) for c in np.divmod(pairs, max(1, len(words))))
        found.append((pc.binary_join_element_wise(first, second, " "), *_occurrences(pair_row, place, len(pairs))))
    n = np.array([len(texts)])
    found.append((pa.nulls(1, pa.string()), n, n))
    terms, tf, df = zip(*found)
    return pa.RecordBatch.from_arrays([pa.concat_arrays([t.cast(pa.string()) for t in terms]), pa.array(np.concatenate(tf)),
                                       pa.array(np.concatenate(df))], ["term", "tf", "df"])


def _neighbours(row: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and joint code of each pair of neighbours."""
    same = row[1:] == row[:-1]
    return row[1:][same], code[:-1][same] * n + code[1:][same]


def _occurrences(row: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each code occurs, and in how many rows."""
    once = np.unique(row * max(1, n) + code) % max(1, n)
    return np.bincount(code, minlength=n), np.bincount(once, minlength=n)


def vocabulary(df: DataFrame, text_col: str, stop_words: Sequence[str], max_features: int,
               min_df: int = MIN_DOC_FREQ, bigrams: bool = True) -> DataFrame:
    """The most frequent terms of those in enough texts: ``tf`` down, then term up."""
    return (term_statistics(df, text_col, stop_words, bigrams)
            .where(F.col("term").isNotNull() & (F.col("df") >= min_df))
            .orderBy(F.desc("tf"), F.asc("term")).limit(max_features))


def idf(n_docs: Column, df: Column) -> Column:
    """Smoothed inverse document frequency, ``ln((1+n)/(1+df)) + 1``."""
    return F.log((n_docs + 1.0) / (df + 1.0)) + 1.0


@dataclass
class TfidfModel:
    """A fitted vocabulary: terms in alphabetical order and their idf."""

    terms: list[str]
    idf: np.ndarray
    n_docs: int
    stop_words: Sequence[str]
    bigrams: bool

    def frame(self, spark: SparkSession) -> DataFrame:
        """``(term, idx, idf)``."""
        rows = pd.DataFrame({"term": self.terms, "idx": np.arange(len(self.terms), dtype="int32"),
                             "idf": self.idf})
        return spark.createDataFrame(rows, "term string, idx int, idf double")

    def transform(self, df: DataFrame, text_col: str, out: str = "tfidf") -> DataFrame:
        """Add the L2-normalised TF-IDF vector of each text; null text is empty."""
        @F.arrow_udf(VectorUDT())
        def weigh(texts: pa.Array) -> pa.Array:
            return pa.concat_arrays([_sparse([], [], [0], len(self.terms))] + [
                self._vectors(texts.slice(i, tx.ROWS)) for i in range(0, len(texts), tx.ROWS)])

        return df.withColumn(out, weigh(tx.spaced_words(F.col(text_col))))

    @cached_property
    def _keys(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The words of all terms, and the terms' keys from their numbers, ascending, with the terms' places.

        The key of a word alone is below that of any pair.
        """
        parts = sorted({w for t in self.terms for w in t.split(" ")})
        number = {w: i for i, w in enumerate(parts)}
        split = [t.partition(" ") for t in self.terms]
        keys = np.array([number[a] + (number[b] + 1) * len(parts) if b else number[a] for a, _, b in split], dtype=np.int64)
        order = np.argsort(keys)
        return pa.array(parts, pa.string()), keys[order], order

    def counts(self, df: DataFrame, text_col: str, out: str = "counted") -> DataFrame:
        """Add the vocabulary's terms in each text and their numbers, over the greatest common divisor; null text has none."""
        @F.arrow_udf(COUNTED)
        def count(texts: pa.Array) -> pa.Array:
            return pa.concat_arrays([self._counted(texts.slice(0, 0))] + [
                self._counted(texts.slice(i, tx.ROWS)) for i in range(0, len(texts), tx.ROWS)])

        return df.withColumn(out, count(tx.spaced_words(F.col(text_col))))

    def _counted(self, texts: pa.Array) -> pa.Array:
        rows, idx, n = self._cells(texts)
        ends = np.cumsum(np.bincount(rows, minlength=len(texts)))
        filled = np.unique(rows, return_index=True)[1]
        if len(filled):
            n = n // np.repeat(np.gcd.reduceat(n, filled), np.diff(np.append(filled, len(n))))
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (idx, n)],
                                          ["terms", "counts"])

    def _cells(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place of the term and number of each term of the vocabulary in each text, in that order."""
        row, code, words = tx.split_words(texts, self.stop_words)
        parts, keys, order = self._keys
        number = pc.index_in(words.cast(pa.string()), parts).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[code]
        found, rows = number, row
        if self.bigrams:
            both = (row[1:] == row[:-1]) & (number[1:] >= 0) & (number[:-1] >= 0)
            found = np.concatenate([number, number[:-1][both] + (number[1:][both] + 1) * len(parts)])
            rows = np.concatenate([row, row[1:][both]])
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        hit = keys[at] == found
        cells, n = np.unique(rows[hit] * len(keys) + order[at[hit]], return_counts=True)
        return *np.divmod(cells, len(keys)), n

    def _vectors(self, texts: pa.Array) -> pa.Array:
        rows, idx, n = self._cells(texts)
        weights = n * self.idf[idx]
        length = np.sqrt(np.bincount(rows, weights * weights, minlength=len(texts)))
        ends = np.cumsum(np.bincount(rows, minlength=len(texts)))
        return _sparse(idx, weights / length[rows], np.concatenate([[0], ends]), len(self.terms))


def _sparse(idx: Sequence[int], values: Sequence[float], offsets: Sequence[int], size: int) -> pa.Array:
    """Sparse vectors as Spark ML stores them."""
    n, offsets = len(offsets) - 1, pa.array(np.asarray(offsets, dtype=np.int32))
    return pa.StructArray.from_arrays(
        [pa.array(np.zeros(n, dtype=np.int8)), pa.array(np.full(n, size, dtype=np.int32)),
         pa.ListArray.from_arrays(offsets, pa.array(np.asarray(idx, dtype=np.int32))),
         pa.ListArray.from_arrays(offsets, pa.array(np.asarray(values, dtype=float)))], ["type", "size", "indices", "values"])


def fit_tfidf(df: DataFrame, text_col: str, max_features: int, min_df: int = MIN_DOC_FREQ,
              stop_words: Sequence[str] | None = None, bigrams: bool = True) -> TfidfModel:
    """Fit on the given texts; filter to the training period before calling.

    The vocabulary, ``max_features`` terms at most, lives on the driver and in every task.
    """
    stops = english_stop_words() if stop_words is None else list(stop_words)
    stats = term_statistics(df, text_col, stops, bigrams)
    # The null term carries the corpus size; it sorts ahead of the top terms.
    top = (stats.where(F.col("term").isNull() | (F.col("df") >= min_df))
           .orderBy(F.col("term").isNull().desc(), F.desc("tf"), F.asc("term"))
           .limit(max_features + 1).collect())
    if len(top) < 2:
        raise ValueError("no term is left after pruning")
    n_docs, kept = top[0]["df"], sorted((r["term"], r["df"]) for r in top[1:])
    doc_freq = np.array([d for _, d in kept], dtype=float)
    return TfidfModel([t for t, _ in kept], np.log((1 + n_docs) / (1 + doc_freq)) + 1.0,
                      n_docs, stops, bigrams)


def before_cutoff(df: DataFrame, date_col: str, cutoff, inclusive: bool = False) -> DataFrame:
    """Texts a model may be fitted on: strictly before the cutoff unless ``inclusive``."""
    bound = cutoff if isinstance(cutoff, Column) else F.lit(cutoff)
    return df.where(F.col(date_col) <= bound if inclusive else F.col(date_col) < bound)


def sparse_parts(vector_col: str) -> tuple[Column, Column]:
    """Indices and values of a sparse vector column as plain arrays."""
    raw = F.unwrap_udt(F.col(vector_col))
    return raw["indices"], raw["values"]


def long_weights(df: DataFrame, id_cols: Sequence[str], model: TfidfModel,
                 vector_col: str = "tfidf") -> DataFrame:
    """``(ids, term, weight)`` for the non-zero weights."""
    idx, values = sparse_parts(vector_col)
    zipped = F.arrays_zip(idx.alias("idx"), values.alias("weight"))
    pairs = tx.unnest(df, id_cols, zipped, "p").select(*id_cols, "p.idx", "p.weight")
    # At most max_features rows: a bounded dictionary.
    names = F.broadcast(model.frame(df.sparkSession).select("idx", "term"))
    return pairs.join(names, "idx").select(*id_cols, "term", "weight")


def top_terms(df: DataFrame, text_col: str, max_features: int = BODY_TERMS, k: int = 25,
              min_df: int = MIN_DOC_FREQ, stop_words: Sequence[str] | None = None) -> DataFrame:
    """Terms with the highest mean weight over all texts, absent counting as 0."""
    model = fit_tfidf(df, text_col, max_features, min_df, stop_words)
    means = model.transform(df.select(text_col), text_col).select(
        Summarizer.mean(F.col("tfidf")).alias("mean")).first()["mean"].toArray()
    order = sorted(range(len(means)), key=lambda i: (-means[i], model.terms[i]))[:k]
    rows = [(model.terms[i], float(means[i])) for i in order]
    return df.sparkSession.createDataFrame(rows, "term string, mean_weight double")


@dataclass
class SvdModel:
    """Right singular vectors (terms x rank) and singular values."""

    components: np.ndarray
    singular_values: np.ndarray

    @property
    def rank(self) -> int:
        return self.components.shape[1]

    def frame(self, spark: SparkSession, terms: Sequence[str]) -> DataFrame:
        """``(component, term, loading)``, terms x rank rows at most."""
        place, component = np.indices(self.components.shape)
        rows = pd.DataFrame({"component": component.ravel(), "term": np.asarray(terms, dtype=object)[place.ravel()],
                             "loading": self.components.ravel()})
        return spark.createDataFrame(rows, "component int, term string, loading double")

    def project(self, df: DataFrame, vector_col: str = "tfidf", out: str = "svd") -> DataFrame:
        """Add the coordinates of each sparse vector."""
        @F.pandas_udf("array<double>")
        def placed(idx: pd.Series, values: pd.Series) -> pd.Series:
            return pd.Series(list(self.coordinates(idx, values)))

        return df.withColumn(out, placed(*sparse_parts(vector_col)))

    def coordinates(self, idx: Sequence[np.ndarray], values: Sequence[np.ndarray]) -> np.ndarray:
        """Coordinates of sparse vectors, by slices of some ``ENTRIES`` weights: a product has rank times as many numbers."""
        v, idx, values = self.components, list(idx), list(values)
        sizes = np.array([len(x) for x in idx], dtype=np.int64)
        result = np.zeros((len(idx), self.rank))
        filled = np.flatnonzero(sizes)
        ends = np.flatnonzero(np.diff(np.cumsum(sizes[filled]) // ENTRIES)) + 1
        for part in np.split(filled, ends) if len(filled) else []:
            rows = np.concatenate([np.asarray(idx[i], dtype=np.int64) for i in part])
            weights = np.concatenate([np.asarray(values[i], dtype=float) for i in part])
            starts = np.concatenate([[0], np.cumsum(sizes[part])])[:-1]
            result[part] = np.add.reduceat(v[rows] * weights[:, None], starts, axis=0)
        return result


def _fix_signs(v: np.ndarray) -> np.ndarray:
    """Make the entry of largest magnitude of every component positive."""
    peak = v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])]
    return v * np.where(peak < 0, -1.0, 1.0)


def fit_svd(vectors: DataFrame, vector_col: str, n_terms: int, rank: int) -> SvdModel:
    """Uncentred truncated SVD of the rows, rank clamped to ``[1, n_terms - 1]``.

    The vectors are written once and read by every pass; no task nor the driver holds more
    than a few times terms x rank numbers.
    """
    k = max(1, min(rank, n_terms - 1))
    idx, values = sparse_parts(vector_col)
    written = write_through(vectors.select(idx.alias("idx"), values.alias("val")), "svd-vectors")
    components, sizes = leading_pairs(written, n_terms, k)
    return SvdModel(_fix_signs(components), sizes)


def component_columns(df: DataFrame, vector_col: str, rank: int, prefix: str = "") -> DataFrame:
    """An array column as ``<prefix>svd_0 ..`` columns."""
    return df.select(*[c for c in df.columns if c != vector_col],
                     *[F.get(vector_col, F.lit(i)).alias(f"{prefix}svd_{i}") for i in range(rank)])


def fit_tfidf_svd(train: DataFrame, text_col: str, max_features: int, rank: int,
                  min_df: int = MIN_DOC_FREQ, stop_words: Sequence[str] | None = None
                  ) -> tuple[TfidfModel, SvdModel]:
    tfidf = fit_tfidf(train, text_col, max_features, min_df, stop_words)
    vectors = tfidf.transform(train.select(text_col), text_col)
    return tfidf, fit_svd(vectors, "tfidf", len(tfidf.terms), rank)


def transform_daily(df: DataFrame, date_col: str, text_col: str, tfidf: TfidfModel, svd: SvdModel,
                    prefix: str = "", out_date: str = "obs_date") -> DataFrame:
    """Mean projection of each day's texts."""
    from tickerpress.operators.daily import daily_vector_mean

    vectors = tfidf.transform(df.select(date_col, text_col), text_col)
    placed = svd.project(vectors).select(date_col, "svd")
    return daily_vector_mean(placed, date_col, "svd", svd.rank, prefix, out_date)
