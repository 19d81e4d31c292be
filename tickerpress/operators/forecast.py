"""Baselines and regressions with ARMA errors of the daily change, per series.

A series is one calendar long.  A fit iterates over the rows of a series; the unit of a grouped map is
one fit, (series, order), or a run of refits, (series, block of days), so the orders and refits of
a single series are spread over tasks too.  Rows whose target or regressors are missing take no part in a fit; a row that cannot be
forecast, or comes before the fit has enough rows, has a null forecast.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerpress.operators import arma
from tickerpress.operators.panel import AR_LAG

SERIES, DATE, TARGET = "series_id", "obs_date", "diff"

# Exogenous features and orders of the models.
EXOGENOUS = ("title_vader_compound_mean", "title_lm_polarity_mean",
             "text_vader_compound_mean", "text_lm_polarity_mean")
ORDERS_BY_RMSE = tuple(itertools.product((0, 1), (0, 1)))
ORDERS_BY_AIC = tuple(itertools.product((0, 1, 2), (0, 1, 2)))


def _in_splits(splits: Sequence[str]) -> Column:
    return F.col("split").isin(*splits)


def _series(order: bool = True):
    w = Window.partitionBy(SERIES)
    return w.orderBy(DATE) if order else w


def as_predictions(df: DataFrame, model: str | Column, y_hat: Column,
                   splits: Sequence[str] = ("val", "test")) -> DataFrame:
    """Long prediction rows for the given splits."""
    name = F.lit(model) if isinstance(model, str) else model
    return df.where(_in_splits(splits)).select(
        SERIES, DATE, "split", name.alias("model"), F.col(TARGET).alias("y"), y_hat.alias("y_hat"))


# -- scaling and baselines -----------------------------------------------------

def standardise(panel: DataFrame, columns: Sequence[str],
                fit_on: Sequence[str] = ("train",)) -> DataFrame:
    """Centre and scale by the population deviation of the fit rows; no variance divides by 1."""
    w, scaled = _series(False), {}
    for c in columns:
        seen = F.when(_in_splits(fit_on), F.col(c).cast("double"))
        spread = F.stddev_pop(seen).over(w)
        scaled[c] = (F.col(c) - F.avg(seen).over(w)) / F.when(spread > 0, spread).otherwise(1.0)
    return panel.withColumns(scaled)


def zero_change(panel: DataFrame, splits: Sequence[str] = ("val", "test")) -> DataFrame:
    return as_predictions(panel, "zero", F.lit(0.0), splits)


def _majority_call(fit_on: Sequence[str]) -> Column:
    """+1 where rising days are more than half of the fit rows, else -1."""
    rising = F.avg(F.when(_in_splits(fit_on), (F.col(TARGET) > 0).cast("double"))).over(_series(False))
    return F.when(rising > 0.5, 1.0).otherwise(-1.0)


def majority_direction(panel: DataFrame, fit_on: Sequence[str] = ("train",),
                       splits: Sequence[str] = ("val", "test")) -> DataFrame:
    called = panel.withColumn("call", _majority_call(fit_on))
    return as_predictions(called, "majority", F.col("call"), splits)


def persistence(panel: DataFrame, splits: Sequence[str] = ("val", "test")) -> DataFrame:
    return as_predictions(panel, "persistence", F.col(AR_LAG), splits)


def baselines(panel: DataFrame, splits: Sequence[str] = ("val", "test")) -> DataFrame:
    """The three baselines from one pass over the panel."""
    called = panel.withColumn("call", _majority_call(("train",))).where(_in_splits(splits))
    models = F.array(*[F.struct(F.lit(name).alias("model"), value.alias("y_hat")) for name, value in (
        ("zero", F.lit(0.0)), ("majority", F.col("call")), ("persistence", F.col(AR_LAG)))])
    rows = called.select(SERIES, DATE, "split", F.col(TARGET).alias("y"), F.inline(models))
    return rows.select(SERIES, DATE, "split", "model", "y", "y_hat")


# -- regressions with ARMA errors ----------------------------------------------

#: Tasks a core that units of a grouped map are dealt to, so that few units meet by chance.
UNIT_TASKS = 4

FITS = f"{SERIES} string, p int, q int, n long, coef array<double>, rss double"


def term_names(p: int, q: int, exog: Sequence[str] = ()) -> list[str]:
    """Terms in the order of ``coef``: mean, regressors, AR and MA terms."""
    return ["const", *exog, *[f"ar{i}" for i in range(1, p + 1)], *[f"ma{i}" for i in range(1, q + 1)]]


class _Series:
    """One series in order of date: its usable rows as arrays, and where they lie."""

    def __init__(self, rows: pd.DataFrame, exog: Sequence[str]):
        self.rows = rows.sort_values(DATE, kind="stable").reset_index(drop=True)
        self.x = self.rows[list(exog)].to_numpy(dtype=float).reshape(len(rows), len(exog))
        self.y = self.rows[TARGET].to_numpy(dtype=float)
        self.whole = np.flatnonzero(np.isfinite(self.y) & np.isfinite(self.x).all(axis=1))
        self.split = self.rows["split"].to_numpy()

    def upto(self, splits: Sequence[str]):
        """Usable rows of the splits."""
        at = self.whole[np.isin(self.split[self.whole], list(splits))]
        return self.y[at], self.x[at]

    def predictions(self, model: str, splits: Sequence[str], y_hat: np.ndarray) -> pd.DataFrame:
        due = np.isin(self.split, list(splits))
        out = self.rows.loc[due, [SERIES, DATE, "split", TARGET]].rename(columns={TARGET: "y"})
        return out.assign(model=model, y_hat=y_hat[due])[[SERIES, DATE, "split", "model", "y", "y_hat"]]


def _rows(panel: DataFrame, exog: Sequence[str], *more: str | Column) -> DataFrame:
    return panel.select(F.col(SERIES).cast("string").alias(SERIES), DATE, "split",
                        F.col(TARGET).cast("double").alias(TARGET), *[F.col(c).cast("double").alias(c) for c in exog], *more)


def _by_series(rows: DataFrame, exog: Sequence[str], work, schema: str, units: Sequence[str] = ()) -> DataFrame:
    """``work(series, *unit)`` for every series and unit; one group is at most one calendar long.

    Units are dealt to a fixed number of tasks: their rows are few and their fits long, so that
    adaptive execution, which goes by bytes, would put them all into one.
    """
    if units:
        rows = rows.repartition(UNIT_TASKS * rows.sparkSession.sparkContext.defaultParallelism, SERIES, *units)
    return rows.groupBy(SERIES, *units).applyInPandas(lambda key, pdf: work(_Series(pdf, exog), *key[1:]), schema)


def _by_order(panel: DataFrame, exog: Sequence[str], orders: Sequence[tuple[int, int]], work, schema: str) -> DataFrame:
    """``work(series, p, q)`` for every series and order, each a group of its own."""
    every = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in orders])
    return _by_series(_rows(panel, exog, F.inline(every)), exog, work, schema, ("p", "q"))


def _prediction_schema(panel: DataFrame) -> str:
    return (f"{SERIES} string, {DATE} {panel.schema[DATE].dataType.simpleString()}, split string, model string, "
            "y double, y_hat double")


def fit_orders(panel: DataFrame, orders: Sequence[tuple[int, int]], exog: Sequence[str] = (),
               fit_on: Sequence[str] = ("train",)) -> DataFrame:
    """``FITS`` rows, every order fitted on the same rows of each series; too short series have a null fit."""
    skip = max(p for p, _ in orders)

    def work(s: _Series, p: int, q: int) -> pd.DataFrame:
        m = arma.fit(*s.upto(fit_on), int(p), int(q), skip)
        row = (s.rows[SERIES].iloc[0], p, q, m.n if m else 0, list(m.values) if m else None, m.rss if m else None)
        return pd.DataFrame([row], columns=[SERIES, "p", "q", "n", "coef", "rss"])

    return _by_order(panel, exog, orders, work, FITS)


def fit_arma(panel: DataFrame, p: int, q: int, exog: Sequence[str] = (),
             fit_on: Sequence[str] = ("train",)) -> DataFrame:
    """``FITS`` rows of one order, one per series."""
    return fit_orders(panel, [(p, q)], exog, fit_on)


def coefficient_table(fits: DataFrame, terms: Sequence[str], by: Sequence[str] = (SERIES,)) -> DataFrame:
    """``(by, term, coef)`` rows of the fits of one order."""
    names = F.array(*[F.lit(x) for x in terms])
    return fits.where("coef IS NOT NULL").select(*by, F.inline(F.arrays_zip(names.alias("term"), F.col("coef"))))


def rolling_forecast(panel: DataFrame, p: int, q: int, exog: Sequence[str] = (),
                     fit_on: Sequence[str] = ("train",), splits: Sequence[str] = ("val",),
                     model: str | None = None) -> DataFrame:
    """One step ahead with fixed coefficients, actual values entering as they arrive."""
    name = model or f"arma({p},0,{q})" + ("+news" if exog else "")
    return _by_series(_rows(panel, exog), exog, lambda s: s.predictions(name, splits, _rolled(s, p, q, fit_on)),
                      _prediction_schema(panel))


def _rolled(s: _Series, p: int, q: int, fit_on: Sequence[str]) -> np.ndarray:
    out = np.full(len(s.y), np.nan)
    m = arma.fit(*s.upto(fit_on), p, q)
    if m:
        out[s.whole] = m.fitted(s.y[s.whole], s.x[s.whole])
    return out


# -- order grids ---------------------------------------------------------------

def order_table(fits: DataFrame, n_exog: int = 0) -> DataFrame:
    """Log-likelihood, AIC, BIC and HQIC per order, Gaussian, the variance counted as a parameter."""
    n, k = F.col("n"), F.col("p") + F.col("q") + F.lit(2 + n_exog)
    fit = n * (F.log(F.lit(2 * np.pi) * F.col("rss") / n) + 1.0)
    return fits.where("coef IS NOT NULL").select(
        SERIES, "p", "q", "n", F.round(-fit / 2, 2).alias("loglik"), F.round(fit + 2.0 * k, 2).alias("aic"),
        F.round(fit + F.log(n) * k, 2).alias("bic"), F.round(fit + 2.0 * F.log(F.log(n)) * k, 2).alias("hqic"))


def best_order(table: DataFrame, criterion: str = "aic") -> DataFrame:
    """The order with the smallest criterion per series, ties to the smaller order."""
    w = Window.partitionBy(SERIES).orderBy(F.col(criterion).asc_nulls_last(), "p", "q")
    return table.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def horizon_forecast(panel: DataFrame, orders: Sequence[tuple[int, int]], exog: Sequence[str] = (),
                     split: str = "val", fit_on: Sequence[str] = ("train",)) -> DataFrame:
    """Forecasts of a whole split from its eve, later exogenous values known.

    Prediction rows with ``p`` and ``q``.  Predictions feed the autoregression and future shocks are zero.
    """
    skip = max(p for p, _ in orders)

    def work(s: _Series, p: int, q: int) -> pd.DataFrame:
        y, x = s.upto(fit_on)
        due = np.flatnonzero((s.split == split) & np.isfinite(s.x).all(axis=1))
        out, m = np.full(len(s.y), np.nan), arma.fit(y, x, int(p), int(q), skip)
        if m and len(due):
            out[due] = m.path(y, x, s.x[due])
        return s.predictions(f"arma({p},0,{q})", [split], out).assign(p=p, q=q)

    return _by_order(panel, exog, orders, work, _prediction_schema(panel) + ", p int, q int")


def order_by_validation(panel: DataFrame, orders: Sequence[tuple[int, int]] = ORDERS_BY_RMSE,
                        exog: Sequence[str] = ()) -> DataFrame:
    """``(series, p, q, rmse)`` of multi-step validation forecasts, best order per series."""
    error = F.col("y") - F.col("y_hat")
    scores = horizon_forecast(panel, orders, exog).groupBy(SERIES, "p", "q").agg(
        F.sqrt(F.avg(error * error)).alias("rmse"))
    return best_order(scores, "rmse")


def order_by_aic(panel: DataFrame, orders: Sequence[tuple[int, int]] = ORDERS_BY_AIC,
                 exog: Sequence[str] = (), fit_on: Sequence[str] = ("train",)) -> DataFrame:
    """Information criteria of every order, from the training rows only."""
    return order_table(fit_orders(panel, orders, exog, fit_on), len(exog))


def rolling_best_order(panel: DataFrame, exog: Sequence[str] = (),
                       orders: Sequence[tuple[int, int]] = ORDERS_BY_AIC) -> DataFrame:
    """Rolling forecasts of validation and test rows with each series' own AIC order.

    The order is chosen on the training rows.  Validation rows use coefficients
    of the training rows, test rows those of training and validation rows.
    """
    name, out, trained = "arimax" if exog else "arima", None, None
    for fit_on, split in ((("train",), "val"), (("train", "val"), "test")):
        scaled = standardise(panel, exog, fit_on) if exog else panel
        if trained is None:  # the order is invariant to the scale of the regressors
            trained = best_order(order_by_aic(scaled, orders, exog)).select(F.col(SERIES).alias("of"), "p", "q")

        def work(s: _Series, p, q, fit_on=fit_on, split=split) -> pd.DataFrame:
            if p is None or np.isnan(p):
                return s.predictions(name, [split], np.full(len(s.y), np.nan))
            return s.predictions(name, [split], _rolled(s, int(p), int(q), fit_on))

        rows = _rows(scaled, exog)
        rows = rows.join(trained, F.col(SERIES).eqNullSafe(F.col("of")), "left").drop("of")
        part = _by_series(rows, exog, work, _prediction_schema(panel), ("p", "q"))
        out = part if out is None else out.unionByName(part)
    return out


# -- refits on expanding history ----------------------------------------------

#: Days that are refitted one after another in one task.
REFITS = 32


def expanding_refit(panel: DataFrame, p: int = 1, q: int = 0, exog: Sequence[str] = (),
                    splits: Sequence[str] = ("test",), model: str = "expanding") -> DataFrame:
    """One step ahead, all coefficients refitted on all earlier rows at every step.

    The days to forecast are cut into blocks of ``REFITS``; a block is a group of its own and
    gets every row up to its last day.  Inside a block a refit starts from the last one, so it takes a step or two.
    """
    def work(s: _Series, block: int) -> pd.DataFrame:
        out, now = np.full(len(s.y), np.nan), None
        y, x = s.y[s.whole], s.x[s.whole]
        mine = s.rows["own_block"].to_numpy() == block
        for i in np.flatnonzero(mine[s.whole]):
            now = arma.fit(y[:i], x[:i], p, q, start=now)
            if now:
                out[s.whole[i]] = now.fitted(y[:i + 1], x[:i + 1])[-1]
        return s.predictions(model, splits, out)[mine[np.isin(s.split, list(splits))]]

    due = _in_splits(splits)
    number = F.sum(due.cast("int")).over(_series().rowsBetween(Window.unboundedPreceding, 0))
    last = F.max("upto").over(_series(False))
    placed = panel.withColumn("upto", F.floor(F.greatest(number - 1, F.lit(0)) / REFITS)).withColumn("last", last)
    # A row is history of its own and all later blocks.
    rows = _rows(placed, exog, F.when(due, F.col("upto")).otherwise(F.lit(-1)).alias("own_block"),
                 F.explode(F.sequence("upto", "last")).alias("block"))
    return _by_series(rows, exog, work, _prediction_schema(panel), ("block",))
