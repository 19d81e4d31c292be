"""Mixing sources to target weights by pivotal dependent rounding.

A source that should give f times its words takes every document floor(f) times
and one copy more with the fractional probability.  The fractions are rounded by
pivots: two documents exchange probability, at random but without moving the
expectation or the words expected from the two, until one is 0 or 1.  What is
left of a block (one document at most) meets the leftovers of other blocks in a
reduction tree, and the root of each source hands leftovers from large documents
down to small ones, so a source ends within about one small document of its target.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerpress.session import write_through

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEATS = 3
#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: Documents per block of the tree's lowest level, and leftovers per block above it.
LEAF, FAN = 384, 64
#: Documents of each size class (powers of two) that wait for the root, in the mean.
HELD = 48
_UNIT = "source string, doc_id {id}, cls int, block long, words long, p double"


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Per source: source, source_size, weight, target.

    ``sizes`` has source and size.  Targets share all words by weight; one above
    ``MAX_REPEATS`` times its source stops there, and the excess goes to the others
    by weight until none is above.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source is numbered in one task, not the documents.
    position = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by_source = write_through(by_source.withColumn("weight", F.element_at(
        F.array(*map(F.lit, WEIGHTS)), (position % len(WEIGHTS) + 1).cast("int"))), "mix-sources")
    cap, w = MAX_REPEATS * F.col("source_size"), F.col("weight")
    total, level, before = by_source.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1.0
    while level > before:
        stopped = cap <= level * w
        taken, open_weight = by_source.agg(F.sum(F.when(stopped, cap).otherwise(0)),
                                           F.sum(F.when(stopped, 0).otherwise(w))).first()
        before, level = level, (total - taken) / open_weight if open_weight else level
    return by_source.withColumn("target", F.least(cap.cast("double"), F.lit(float(level)) * w))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    ``copies`` is how often the mix takes the row, ``taken`` its words times that.
    Rows of one source that repeat an id are one unit and are taken equally often.
    A null source is a source of its own, a null text has no words, null ids of a
    source are one unit.  Units without words get the whole part of their source's factor.
    An empty table gives no rows.  Reruns agree: draws depend on ids and ``seed`` alone.
    """
    sizes = write_through(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size")), "mix-sizes")
    goal = write_through(targets(sizes), "mix-targets")
    same = lambda a, b, *keys: [a[k].eqNullSafe(b[k]) for k in keys]
    factor = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    # Partial sums first: an id or a source may hold a third of all rows.
    units = sizes.groupBy("source", "doc_id").agg(F.sum("size").alias("words"))
    units = write_through(
        units.join(goal.withColumnRenamed("source", "of"), units["source"].eqNullSafe(F.col("of")))
        .select("source", "doc_id", "words", F.floor(factor).alias("whole"),
                (factor - F.floor(factor)).alias("p"),
                F.floor(F.log2(F.greatest("words", F.lit(1)))).cast("int").alias("cls")), "mix-units")
    rounded = _round(units.where("words > 0 and p > 0"), seed)
    units = units.drop("p", "cls").alias("u").join(
        rounded.alias("r"), same(units, rounded, "source", "doc_id"), "left").select(
        "u.source", "u.doc_id", (F.col("whole") + F.coalesce("r.p", F.lit(0.0))).cast("int").alias("copies"))
    units, goal = units.alias("u"), goal.alias("g")
    s = sizes.alias("s")
    return (s.join(units, (F.col("s.source").eqNullSafe(F.col("u.source")))
                   & (F.col("s.doc_id").eqNullSafe(F.col("u.doc_id"))))
            .join(goal, F.col("s.source").eqNullSafe(F.col("g.source")))
            .select("s.doc_id", "s.source", "s.size", "g.source_size", "g.target", "u.copies",
                    (F.col("s.size") * F.col("u.copies")).alias("taken")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        seed: int = 17) -> DataFrame:
    """The mixed corpus: every row as often as the mix takes it, with the columns of ``docs``."""
    plan = plan_mix(docs, id_col, text_col, source_col, seed).where("copies > 0")
    units = plan.select("source", "doc_id", "copies").distinct().alias("u")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("of")).alias("d")
    return (rows.join(units, F.col("d.of").eqNullSafe(F.col("u.source")) & F.col("d.id").eqNullSafe(F.col("u.doc_id")))
            .select("row", F.explode(F.sequence(F.lit(1), F.col("u.copies")))).select("row.*"))


def _round(units: DataFrame, seed: int) -> DataFrame:
    """Units with p rounded to 0 or 1 through the reduction tree."""
    counts = write_through(units.groupBy("source", "cls").agg(F.count(F.lit(1)).alias("n")), "mix-classes")
    c = counts.alias("c")
    u = units.join(c, units["source"].eqNullSafe(F.col("c.source")) & (units["cls"] == F.col("c.cls")))
    draw = F.xxhash64(F.lit(seed), units["doc_id"])
    blocks = F.ceil(F.col("n") / LEAF)
    held = (F.col("n") <= HELD) | (F.pmod(F.xxhash64(F.lit(seed + 1), units["doc_id"]), F.ceil(F.col("n") / HELD)) == 0)
    u = u.select(units["source"], "doc_id", units["cls"],
                 F.when(held, -1).otherwise(F.pmod(draw, blocks)).alias("block"), "words", "p")
    schema = _UNIT.format(id=dict(u.dtypes)["doc_id"])
    at_most = (counts.agg(F.max(F.ceil(F.col("n") / LEAF))).first()[0] or 0)
    waiting, done, open_rows = u.where("block < 0"), [], u.where("block >= 0")
    level = 0
    while True:
        out = write_through(open_rows.groupBy("source", "cls", "block").applyInPandas(
            _block_pivot(seed, level), schema), f"mix-level{level}")
        settled = F.col("p").isin(0.0, 1.0)
        done.append(out.where(settled))
        open_rows = out.where(~settled).withColumn("block", F.floor(F.col("block") / FAN))
        if at_most <= FAN:
            break
        at_most, level = -(-at_most // FAN), level + 1
    root = waiting.unionByName(open_rows).groupBy("source").applyInPandas(
        _block_pivot(seed, -1), schema)
    for part in done:
        root = root.unionByName(part)
    return root.select("source", "doc_id", "p")


def _block_pivot(seed: int, level: int):
    """A level's work on one block; level -1 is the root of a source."""
    return lambda key, rows: _pivot(rows, _rng(seed, level + 1, *key), last=level < 0)


def _rng(seed: int, *key) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(repr(tuple(
        x if x is None or isinstance(x, str) else int(x) for x in key)).encode())])


def _pivot(rows: pd.DataFrame, rng: np.random.Generator, last: bool = False) -> pd.DataFrame:
    """Round from the largest document to the smallest; one stays open, or none if ``last``.

    The carried document gives words to the next one or takes them; either becomes
    0 or 1.  At the root, where sizes differ, a document is paired with all that follow, as one
    partner, until it is 0 or 1: each of them moves a little.  Expectations stay in both cases.
    """
    rows = rows.sort_values(["words", "doc_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
    a, p = rows["words"].to_numpy(float), rows["p"].to_numpy(float).copy()
    if last:
        return rows.assign(p=_settle(a, p, rng))
    carry, u = 0, rng.random(len(rows) + 1)
    for j in range(1, len(rows)):
        i = carry
        if p[i] in (0.0, 1.0):
            carry = j
            continue
        if p[j] in (0.0, 1.0):
            continue
        ratio = a[j] / a[i]
        up, down = min(1 - p[i], p[j] * ratio), min(p[i], (1 - p[j]) * ratio)
        step = up if u[j] * (up + down) < down else -down
        p[i], p[j] = _snap(p[i] + step), _snap(p[j] - step / ratio)
        if p[i] in (0.0, 1.0):
            carry = j
    return rows.assign(p=p)


def _settle(a: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Every document against all smaller ones that are open, whose shares of a step are the same both ways.

    A step goes up or down as far as the document or the first of its partners allows, so steps may be uneven.
    A document that finds no partner any more is drawn.
    """
    for i in range(len(p)):
        while 0.0 < p[i] < 1.0:
            rest = i + 1 + np.flatnonzero((p[i + 1:] > 0.0) & (p[i + 1:] < 1.0))
            if not len(rest):
                p[i] = float(rng.random() < p[i])
                break
            can_give, can_take = a[rest] * p[rest], a[rest] * (1 - p[rest])
            share = np.minimum(can_give / (1 - p[i]), can_take / p[i])
            words = share.sum() / a[i]
            up = min(1 - p[i], words * (can_give / share).min())
            down = min(p[i], words * (can_take / share).min())
            step = up if rng.random() * (up + down) < down else -down
            p[rest] = _snap(p[rest] - step * a[i] * share / share.sum() / a[rest])
            p[i] = _snap(p[i] + step)
    return p


def _snap(p):
    return np.where(p < 1e-9, 0.0, np.where(p > 1 - 1e-9, 1.0, p))
