"""Lexicon and valence scores per text.

Scores are computed inside the row, so no text row is exploded or shuffled: the words of
a batch of texts are told apart in Arrow, and each is looked up once; the
valence rules run over Arrow batches of token arrays.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tickerpress.functions import lexicons as lx
from tickerpress.functions import text as tx

# Names of the score columns.
LM_SCORES = ("lm_pos", "lm_neg", "lm_unc", "lm_polarity", "lm_unc_ratio", "lm_hit")
VALENCE_SCORES = ("vader_neg", "vader_neu", "vader_pos", "vader_compound")


@dataclass(frozen=True)
class Lexicon:
    """Word lists per category; categories may overlap.

    ``more`` holds further categories, each counted in a column of its own.
    """

    positive: Sequence[str] = field(default_factory=lambda: list(lx.POSITIVE))
    negative: Sequence[str] = field(default_factory=lambda: list(lx.NEGATIVE))
    uncertainty: Sequence[str] = field(default_factory=lambda: list(lx.UNCERTAINTY))
    more: Mapping[str, Sequence[str]] = field(default_factory=dict)

    @property
    def words(self) -> list[str]:
        return sorted({*self.positive, *self.negative, *self.uncertainty,
                       *(w for words in self.more.values() for w in words)})


@dataclass(frozen=True)
class ValenceRules:
    """Degree words, negations and which of the context rules apply."""

    boosters: Sequence[str] = field(default_factory=lambda: list(lx.BOOSTERS))
    dampeners: Sequence[str] = field(default_factory=lambda: list(lx.DAMPENERS))
    negations: Sequence[str] = field(default_factory=lambda: list(lx.NEGATIONS))
    contrast: str = "but"
    context: bool = True


def lexicon_from_table(df: DataFrame, term: str = "term", category: str = "category") -> Lexicon:
    """Read a ``(term, category)`` table, all categories; for one that no task can hold see `lexicon_hits_by_join`."""
    words = defaultdict(list)
    for row in df.select(term, category).dropna().distinct().collect():
        words[row[1]].append(row[0])
    lists = {name: sorted(w) for name, w in words.items()}
    main = [lists.pop(name, []) for name in ("positive", "negative", "uncertainty")]
    return Lexicon(*main, more=dict(sorted(lists.items())))


def lexicon_counts(df: DataFrame, text_col: str, prefix: str = "",
                   lexicon: Lexicon | None = None) -> DataFrame:
    """Add ``n_tokens`` and the hits per category."""
    lexicon = lexicon or Lexicon()
    lists = {"lm_pos": lexicon.positive, "lm_neg": lexicon.negative, "lm_unc": lexicon.uncertainty,
             **{f"lm_{name}": words for name, words in lexicon.more.items()}}
    staged = df.select(*[F.col(c) for c in df.columns], _hit_counts(list(lists.values()))(F.col(text_col)).alias("counts_"))
    return staged.select(*[F.col(c) for c in df.columns], *[
        F.col(f"counts_.c{i}").alias(f"{prefix}{name}") for i, name in enumerate(["n_tokens", *lists])])


def _hit_counts(lists: Sequence[Sequence[str]]):
    """The number of words of each text and those in each list, ``tx.ROWS`` texts at a time; none for null."""
    sets, names = [frozenset(words) for words in lists], [f"c{i}" for i in range(len(lists) + 1)]

    def count(texts: pa.Array) -> pa.Array:
        row, code, words = tx.split_letters(texts)
        held = [np.array([w in words_of for w in words], dtype=float) for words_of in sets]
        columns = [np.bincount(row, minlength=len(texts)), *(np.bincount(row, h[code], len(texts)) for h in held)]
        return pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in columns], names)

    @arrow_udf(f"struct<{', '.join(f'{n}: int' for n in names)}>")
    def counts(texts: pa.Array) -> pa.Array:
        empty = pa.array([], pa.struct([(n, pa.int32()) for n in names]))
        return pa.concat_arrays([empty] + [count(texts.slice(i, tx.ROWS)) for i in range(0, len(texts), tx.ROWS)])

    return counts


def lexicon_ratios(df: DataFrame, prefix: str = "") -> DataFrame:
    """Add polarity, uncertainty ratio and the hit flag to the counts."""
    pos, neg, unc, n = (F.col(f"{prefix}{c}") for c in ("lm_pos", "lm_neg", "lm_unc", "n_tokens"))
    total = pos + neg
    return df.withColumns({
        f"{prefix}lm_polarity": F.when(total > 0, (pos - neg) / F.when(total > 0, total))
                                 .otherwise(F.lit(0.0)),
        f"{prefix}lm_unc_ratio": unc / F.greatest(n, F.lit(1)),
        f"{prefix}lm_hit": (total > 0).cast("int"),
    })


def score_lexicon(df: DataFrame, text_col: str, prefix: str = "",
                  lexicon: Lexicon | None = None) -> DataFrame:
    scored = lexicon_ratios(lexicon_counts(df, text_col, prefix, lexicon), prefix)
    return scored.drop(f"{prefix}n_tokens")


def lexicon_hits_by_join(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame) -> DataFrame:
    """Hits per ``(id, category)`` for a lexicon table of any size.

    Terms are counted inside the row; a text meets the lexicon with one row per
    distinct term.  The planner broadcasts a lexicon below its threshold;
    beyond it a frequent term is split by adaptive execution.
    """
    terms = tx.unnest(df, [id_col], tx.term_counts(tx.alpha_tokens(F.col(text_col))), "t")
    return (terms.select(id_col, "t.term", "t.n")
            .join(lexicon.select("term", "category").distinct(), "term")
            .groupBy(id_col, "category").agg(F.sum("n").alias("hits")))


# -- valence ----------------------------------------------------------------

_PUNCT = r"(?:[.!?,;:\-'\"]|!{2,3}|\?{2,3}|\?!\?!?|!\?!\??)"
_BARE = rf"([^\p{{Punct}}{tx.SPACE}]{{2,}})"
_EDGE = f"[^{tx.SPACE}]"
_UNWRAP = rf"(?U)(?<!{_EDGE})(?:{_PUNCT}{_BARE}|{_BARE}{_PUNCT})(?!{_EDGE})"


def valence_words(text: Column) -> Column:
    """Blank-separated tokens of two or more characters, one-sided punctuation taken off."""
    plain = F.regexp_replace(text, _UNWRAP, "$1$2")
    return F.filter(F.split(plain, f"(?U)[{tx.SPACE}]+"), lambda w: F.length(w) > 1)


_SUMS = "struct<words: int, total: double, up: double, down: double, moved: int>"
_FADE = {1: 1.0, 2: 0.95, 3: 0.9}


class _Valence:
    """The rules, applied to the words of one text."""

    def __init__(self, lexicon: Mapping[str, float], rules: ValenceRules):
        self.lexicon, self.rules = dict(lexicon), rules
        self.degree = dict.fromkeys(rules.dampeners, -lx.BOOST) | dict.fromkeys(rules.boosters, lx.BOOST)
        self.negations = frozenset(rules.negations)
        skipped = {*rules.boosters, *rules.dampeners} if rules.context else set()
        self.scored = {w: float(v) for w, v in lexicon.items() if w not in skipped}

    def all_sums(self, texts: pa.Array) -> list[tuple[int, float, float, float, int]]:
        """The sums of each array of words; a word that comes again is looked up once."""
        sizes = pc.list_value_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        coded = texts.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        low = [w.lower() for w in words]
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        scored = np.array([w in self.scored for w in low], dtype=bool)[code]
        loud = np.array([_shouted(w) for w in words], dtype=bool)[code]
        out, start = [], 0
        for size in sizes.tolist():
            part = slice(start, start := start + size)
            hits = np.flatnonzero(scored[part]).tolist()
            own = code[part].tolist() if hits else []
            out.append((size, *self.sums([words[c] for c in own], [low[c] for c in own], hits, int(loud[part].sum()))))
        return out

    def sums(self, words: list[str], low: list[str], hits: list[int], shouted: int) -> tuple[float, float, float, int]:
        total, up, down, moved = 0.0, 0.0, 0.0, 0
        mixed, turn = False, -1
        if hits and self.rules.context:
            mixed = 0 < shouted < len(words)
            turn = low.index(self.rules.contrast) if self.rules.contrast in low else -1
        for i in hits:
            v = self.scored[low[i]]
            if self.rules.context:
                v = self._heard(v, i, words, low, mixed)
                v *= 1.0 if turn < 0 or i == turn else 0.5 if i < turn else 1.5
            total += v
            if v > 0:
                up += v + 1.0
            elif v < 0:
                down += v - 1.0
            moved += v != 0
        return total, up, down, moved

    def _heard(self, v: float, i: int, words: list[str], low: list[str], mixed: bool) -> float:
        """The valence of word i after its neighbours have been heard."""
        if low[i] == "kind" and i + 1 < len(low) and low[i + 1] == "of":
            return 0.0
        if mixed and _shouted(words[i]):
            v += lx.CAPITALS if v > 0 else -lx.CAPITALS if v < 0 else 0.0
        for back in (1, 2, 3):
            if v == 0 or back > i:
                break
            before = low[i - back]
            if before in self.lexicon:
                continue
            if before in self.degree:
                loud = 0.0
                if mixed and _shouted(words[i - back]):
                    loud = lx.CAPITALS if v > 0 else -lx.CAPITALS
                v += (self.degree[before] * (-1.0 if v < 0 else 1.0) + loud) * _FADE[back]
            if back > 1 and before == "never" and {"so", "this"} & set(low[i - back + 1:i]):
                v *= 1.5 if back == 2 else 1.25
            elif before in self.negations or "n't" in before:
                v *= lx.NEGATION
        if i and low[i - 1] == "least" and "least" not in self.lexicon and not (i > 1 and low[i - 2] in ("at", "very")):
            v *= lx.NEGATION
        return v


def _shouted(word: str) -> bool:
    return word == word.upper() and word != word.lower()


def _valence_sums(lexicon: Mapping[str, float], rules: ValenceRules):
    scorer = _Valence(lexicon, rules)
    names, kinds = ["words", "total", "up", "down", "moved"], [pa.int32(), *[pa.float64()] * 3, pa.int32()]

    @arrow_udf(_SUMS)
    def sums(words: pa.Array) -> pa.Array:
        parts = (words.slice(i, tx.ROWS) for i in range(0, len(words), tx.ROWS))
        rows = list(zip(*[r for part in parts for r in scorer.all_sums(part)])) or [[]] * 5
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names)

    return sums


def score_valence(df: DataFrame, text_col: str, lexicon: Mapping[str, float], prefix: str = "",
                  rules: ValenceRules | None = None) -> DataFrame:
    """Add negative, neutral and positive shares and the normalised compound.

    ``lexicon`` maps lower-case terms to valences, of any number.  The context rules are those
    of Hutto & Gilbert (2014): degree words, negation within three words,
    capitals, "but", exclamation and question marks.
    """
    if not lexicon:
        raise ValueError("the valence lexicon is empty")
    rules = rules or ValenceRules()
    text = tx.text_or_empty(F.col(text_col))
    amplifier = F.lit(0.0)
    if rules.context:
        questions = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
        exclaims = F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))
        amplifier = (F.least(exclaims, F.lit(lx.MAX_EXCLAMATIONS)) * F.lit(lx.EXCLAMATION)
                     + F.when(questions > 3, F.lit(lx.MANY_QUESTIONS))
                     .when(questions > 1, questions * F.lit(lx.QUESTION)).otherwise(F.lit(0.0)))
    df_cols = [F.col(c) for c in df.columns]
    staged = df.select(*df_cols, _valence_sums(lexicon, rules)(valence_words(text)).alias("sums_"),
                       amplifier.alias("amp_"))
    total, up, down = (F.col(f"sums_.{c}") for c in ("total", "up", "down"))
    amp, neutral = F.col("amp_"), (F.col("sums_.words") - F.col("sums_.moved")).cast("double")
    staged = staged.select(
        *df_cols, neutral.alias("neu_"),
        (total + F.signum(total) * amp).alias("all_"),
        (up + F.when(up > -down, amp).otherwise(0.0)).alias("up_"),
        (-down + F.when(up < -down, amp).otherwise(0.0)).alias("down_"))
    everything = F.col("up_") + F.col("down_") + F.col("neu_")
    safe = F.when(everything > 0, everything)

    def share(name):
        return F.round(F.coalesce(F.col(name) / safe, F.lit(0.0)), 3)

    s = F.col("all_")
    return staged.select(
        *df_cols, share("down_").alias(f"{prefix}vader_neg"),
        share("neu_").alias(f"{prefix}vader_neu"), share("up_").alias(f"{prefix}vader_pos"),
        F.round(s / F.sqrt(s * s + F.lit(lx.NORMALISER)), 4).alias(f"{prefix}vader_compound"))


def score_texts(df: DataFrame, prefixes: Mapping[str, str], lexicon: Lexicon | None = None,
                valence: Mapping[str, float] | None = None,
                rules: ValenceRules | None = None) -> DataFrame:
    """Score several text columns, each under its own prefix."""
    for text_col, prefix in prefixes.items():
        if valence:
            df = score_valence(df, text_col, valence, prefix, rules)
        df = score_lexicon(df, text_col, prefix, lexicon)
    return df


def score_columns(prefixes: Sequence[str], valence: bool = True) -> list[str]:
    """Names of the score columns under the prefixes, in table order."""
    names = (VALENCE_SCORES if valence else ()) + LM_SCORES
    return [f"{p}{n}" for p in prefixes for n in names]
