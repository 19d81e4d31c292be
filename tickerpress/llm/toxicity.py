"""Toxicity scores: boosted trees over dense text features, with isotonic calibration.

The labelled rows are dealt by the checksum of their id into a part that is held
out and three that are learnt from: one gives a lexicon of words and word stems
(with a short general list before it), one the trees, one the calibration, so no
part judges what it was made from.  Features are densities of lexicon words, how
often a second-person word stands near one, capitals, punctuation and obfuscation.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerpress.llm.remembered import remembered
from tickerpress.session import write_through

#: Labelled rows to learn from at most, taken by the hash of their id.
FIT_ROWS = 30_000
#: Learnt lexicon entries at most, the surest first.
LEXICON = 4_000
#: Stem lengths looked at besides whole words, and words a task remembers.
STEMS = (3, 4, 5, 6, 7, 8)
REMEMBERED = 300_000
#: A learnt entry occurs in so many toxic rows, and its log odds exceed this by two standard errors.
LEAST_ROWS, LEAST_ODDS = 4, 1.0
NEAR = 3
#: Characters of a text split at a time.
SLICE = 1 << 20

GENERAL = frozenset("""
    idiot idiots moron morons stupid dumb loser losers pathetic worthless trash garbage scum clown disgusting
    ugly filthy imbecile fool jerk bastard bitch asshole shit fuck fucking
    dumm dumme dummkopf trottel abschaum widerlich arschloch versager scheisse
    imbécile crétin débile salaud ordure minable dégoûtant connard merde
    estúpido estúpida imbécil basura escoria asqueroso payaso inútil mierda
    """.split())
SECOND_PERSON = frozenset("""
    you your yours yourself you're youre u ya
    du dich dir dein deine deinen deiner ihr euch euer eure
    tu te toi ton ta tes vous votre vos
    tú ti usted ustedes vosotros vuestro vuestra
    """.split())
_LEET = str.maketrans("013457@$", "oieastas")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")
_SPACE = re.compile(r"\s")
_STRETCHED = re.compile(r"(.)\1{2,}")

FEATURES = ["strong_density", "strong_log", "weak_density", "weight_density", "weight_max", "near_second_person",
            "second_person_density", "capitals", "shouted", "exclamation", "question", "punctuation",
            "obfuscated_density", "obfuscated_hits", "words_log"]
_ENDS = 3.0  # a lexicon entry of so much log odds is strong


def deal(id_col):
    """0 to 4 for an id; 0 is held out.  Null ids get null."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5


class Words:
    """What a word is to the lexicon, remembered: None, or (weight, obfuscated, second person, shouted)."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.known = lexicon, {}

    def of(self, words: list[str]) -> list:
        if len(self.known) > REMEMBERED:
            self.known = {}
        for w in set(words).difference(self.known):
            self.known[w] = self._look(w)
        return list(map(self.known.__getitem__, words))

    def _look(self, word: str):
        bare = _EDGES.sub("", word)
        low = bare.lower()
        weight, obfuscated = self._weight(low), False
        if weight <= 0 and low:
            plain = _STRETCHED.sub(r"\1", _INNER.sub("", low.translate(_LEET)))
            obfuscated = plain != low and not low.isdigit()
            if obfuscated and plain:
                weight = self._weight(plain)
        second, shouted = low in SECOND_PERSON, len(bare) > 2 and bare.isupper()
        return (weight, obfuscated, second, shouted) if weight > 0 or obfuscated or second or shouted else None

    def _weight(self, low: str) -> float:
        get = self.lexicon.get
        weight = get(low, 0.0)
        for n in STEMS:
            if len(low) > n:
                weight = max(weight, get(low[:n] + "-", 0.0))
        return weight


def _words(lexicon: dict[str, float]) -> Words:
    """One per worker process and lexicon, so that what a task has looked up serves the next."""
    return remembered(("toxicity", hash(tuple(sorted(lexicon.items())))), lambda: Words(lexicon))


def _class(c: str) -> int:
    """1 capital, 2 other letter, 3 and 4 the marks ! and ?, 5 other ASCII punctuation, 0 all else."""
    if c.isalpha():
        return 1 if c.isupper() else 2
    return 3 if c == "!" else 4 if c == "?" else 5 if "!" <= c <= "~" and not c.isdigit() else 0


#: By code point; those beyond the basic plane share the last entry.
_CLASS = np.array([_class(chr(c)) for c in range(0x10000)], dtype=np.uint8)


def _slices(text: str) -> Iterator[str]:
    """A text in parts of ``SLICE`` characters or a little more, cut before white space."""
    start = 0
    while start < len(text):
        cut = _SPACE.search(text, start + SLICE)
        stop = cut.start() if cut else len(text)
        yield text[start:stop]
        start = stop


def features(text: str | None, words: Words) -> list[float]:
    """``FEATURES`` of a text; all zero for a null or empty one.

    Time grows with the length; only words that mean something are kept, so a long text
    takes little more memory than itself.
    """
    odd, n_words, size, kind = [], 0, 0, np.zeros(6, dtype=np.int64)
    for part in _slices(text or ""):
        found = words.of(part.split())
        odd += [(n_words + i, x) for i, x in enumerate(found) if x is not None]
        n_words += len(found)
        size += len(part)
        points = np.frombuffer(part.encode("utf-32-le"), "<u4")
        kind += np.bincount(_CLASS[np.minimum(points, len(_CLASS) - 1)], minlength=6)
    n, size = max(1, n_words), max(1, size)
    second = np.array([i for i, x in odd if x[2]], dtype=np.int64)
    hits = np.array([i for i, x in odd if x[0] > 0], dtype=np.int64)
    weights = [x[0] for _, x in odd if x[0] > 0]
    strong = sum(w >= _ENDS for w in weights)
    near = int((np.searchsorted(second, hits + NEAR, "right") > np.searchsorted(second, hits - NEAR, "left")).sum())
    letters = max(1, kind[1] + kind[2])
    return [strong / n, np.log1p(strong), (len(hits) - strong) / n, sum(weights) / n, max(weights, default=0.0),
            near / max(1, len(hits)), len(second) / n, kind[1] / letters, sum(x[3] for _, x in odd) / n,
            kind[3] / size, kind[4] / size, kind[5] / size, sum(x[1] for _, x in odd) / n,
            float(sum(x[1] for _, x in odd if x[0] > 0)), np.log1p(n_words)]


def learn_lexicon(rows: DataFrame, entries: int = LEXICON) -> dict[str, float]:
    """Log odds of the words and stems ("abc-") that mark toxic rows (text, toxic), with the general list.

    Rows are counted over the whole texts, first per batch, then by term.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch["text"], batch["toxic"]):
                terms = set()
                for part in _slices(text or ""):
                    for w in set(part.split()):
                        low = _EDGES.sub("", w).lower()
                        terms.add(low)
                        terms.update(low[:n] + "-" for n in STEMS if len(low) > n)
                terms.discard("")
                seen[int(toxic)].update(terms)
            for toxic, counter in seen.items():
                yield pd.DataFrame({"term": list(counter), "toxic": toxic, "n": list(counter.values())})

    lexicon = dict.fromkeys(GENERAL, _ENDS)
    n = dict(rows.groupBy("toxic").count().collect())
    if n.get(1, 0) and n.get(0, 0):
        one, zero = F.col("one"), F.col("zero")
        odds = F.log((one + 0.5) / (n[1] + 1)) - F.log((zero + 0.5) / (n[0] + 1))
        sure = odds - 2 * F.sqrt(1 / (one + 0.5) + 1 / (zero + 0.5))
        terms = (rows.select("text", "toxic").mapInPandas(count, "term string, toxic int, n long").groupBy("term").agg(
            F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("one"),
            F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("zero"))
            .where((one >= LEAST_ROWS) & (sure > LEAST_ODDS)))
        for term, weight in (terms.select("term", odds.alias("odds")).orderBy(sure.desc(), "term").limit(entries)
                             .collect()):
            lexicon[term] = max(weight, lexicon.get(term, 0.0))
    return lexicon


def with_features(rows: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """``rows`` with a column ``f`` (array of ``FEATURES``) in place of ``text``.

    Only texts go to Python and only features come back; the other columns stay where they are.
    """
    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        words = _words(lexicon)
        return pa.array([features(t.as_py(), words) for t in texts], pa.list_(pa.float64()))  # one text at a time

    # Not deterministic by name only: what filters on a score is not to look at the texts a second time.
    return rows.withColumn("f", of.asNondeterministic()("text")).drop("text")


def _assembled(rows: DataFrame) -> DataFrame:
    columns = {name: F.col("f")[i] for i, name in enumerate(FEATURES)}
    return VectorAssembler(inputCols=[f"_{c}" for c in FEATURES], outputCol="features").transform(
        rows.withColumns({f"_{c}": x for c, x in columns.items()})).drop(*[f"_{c}" for c in FEATURES])


class Model:
    """A lexicon, trees and a calibration; without rows of both classes, the share of toxic ones."""

    def __init__(self, lexicon, trees, isotonic, share):
        self.lexicon, self.trees, self.isotonic, self.share = lexicon, trees, isotonic, share

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``text``) with ``score`` instead of the text."""
        if self.trees is None:
            return rows.drop("text").withColumn("score", F.lit(float(self.share)))
        out = _margin(self.trees, _assembled(with_features(rows, self.lexicon)))
        if self.isotonic is None:
            return out.drop("features", "f", "margin").withColumn("score", F.col("raw"))
        return (self.isotonic.transform(out).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "calibrated")))
                .drop("features", "f", "margin", "raw", "calibrated"))


def _margin(trees, rows: DataFrame) -> DataFrame:
    out = trees.transform(rows)
    return (out.withColumn("margin", vector_to_array("rawPrediction")[1])
            .withColumn("raw", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction"))


def calibrate(rows: DataFrame):
    """Isotonic calibration of (toxic double, margin), with steps made slopes.

    An isotonic fit is constant over blocks of margins, which would tie most texts.  Each block is
    drawn in to its mean margin, and the function is linear between these centres (Oron & Flournoy
    2017).  Shares are drawn in from 0 and 1 by half a row of all, and the ends run out to 0 and 1 as
    far again as the margins range, so texts beyond the outer centres are told apart too.
    """
    def regression():
        return IsotonicRegression(featuresCol="margin", labelCol="toxic", predictionCol="calibrated", weightCol="weight")

    rows = rows.withColumn("weight", F.lit(1.0))
    blocks = (regression().fit(rows).transform(rows).groupBy("calibrated")
              .agg(F.avg("margin").alias("margin"), F.count(F.lit(1)).cast("double").alias("weight")))
    low, high, n = rows.agg(F.min("margin"), F.max("margin"), F.count(F.lit(1))).first()
    half = 0.5 / (n + 1)
    centres = blocks.select((half + (1 - 2 * half) * F.col("calibrated")).alias("toxic"), "margin", "weight")
    ends = rows.sparkSession.createDataFrame(
        [(0.0, 2 * low - high - 1.0, 1e-6), (1.0, 2 * high - low + 1.0, 1e-6)], "toxic double, margin double, weight double")
    return regression().fit(centres.unionByName(ends))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", fit_rows: int = FIT_ROWS, lexicon_entries: int = LEXICON) -> Model:
    """Learn from the labelled rows whose deal is not 0, ``fit_rows`` at most; ``lexicon_entries`` bounds the lexicon.

    Repeated labels of an id count as toxic if one does; null labels, null ids and
    labels without a document are left out.
    """
    known = (labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id"))
             .agg(F.max(label_col).cast("int").alias("toxic")).withColumn("deal", deal(F.col("doc_id")).cast("int"))
             .where("deal > 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    # At most ``fit_rows`` ids and labels, so the documents need no shuffle.
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id")
    rows = write_through(rows, "toxic-rows")
    lexicon = learn_lexicon(rows.where("deal in (1, 2)"), lexicon_entries)
    dense = write_through(with_features(rows.where("deal > 2").select("toxic", "deal", "text"), lexicon), "toxic-features")
    n = {(d, t): c for d, t, c in dense.groupBy("deal", "toxic").count().collect()}
    total = sum(n.values())
    share = sum(c for (_, t), c in n.items() if t == 1) / total if total else 0.0
    if not (n.get((3, 0)) and n.get((3, 1))):
        return Model(lexicon, None, None, share)
    ready = _assembled(dense)
    trees = GBTClassifier(labelCol="toxic", featuresCol="features", maxIter=30, maxDepth=4, stepSize=0.2,
                          maxBins=64, minInstancesPerNode=3, seed=11).fit(ready.where("deal = 3"))
    isotonic = None
    if n.get((4, 0)) and n.get((4, 1)):
        isotonic = calibrate(_margin(trees, ready.where("deal = 4")).select(F.col("toxic").cast("double").alias("toxic"), "margin"))
    return Model(lexicon, trees, isotonic, share)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          lexicon_entries: int = LEXICON) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Every whole text is scored, from its text alone; null counts as empty.  Repeated rows get
    equal scores; a null id is not held out.  Without labels of both classes all scores are
    the share of toxic ones (0 without labels).  An empty table gives no rows; long texts are
    read whole, in slices.
    """
    model = fit(docs, labels, id_col, text_col, lexicon_entries=lexicon_entries)
    out = model.score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return out.select("doc_id", F.coalesce(deal(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below 0.5, all columns."""
    model = fit(docs, labels, id_col, text_col)
    scored = model.score(docs.withColumnsRenamed({c: f"_in_{c}" for c in docs.columns})
                         .withColumn("text", F.col(f"_in_{text_col}")))
    return scored.where("score < 0.5").select(*[F.col(f"_in_{c}").alias(c) for c in docs.columns])
