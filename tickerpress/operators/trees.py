"""Boosted regression trees on the panel: fits, grids, families of predictors, importances."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerpress.operators import boosting
from tickerpress.operators.boosting import Forest, Spec
from tickerpress.operators.forecast import TARGET, as_predictions
from tickerpress.operators.panel import AR_LAG, only_splits

# Parameter grids and final parameters.
SMALL_GRID = {"n_estimators": (50, 100), "learning_rate": (0.01, 0.05), "max_depth": (3, 5)}
WIDE_GRID = {"n_estimators": (50, 100, 200), "learning_rate": (0.01, 0.05), "max_depth": (2, 3, 5)}
FINAL = {"n_estimators": 100, "learning_rate": 0.01, "max_depth": 3}


@dataclass
class Grid:
    """Validation error per parameter set, the best set, and its model of the training rows."""

    scores: list[dict]
    best: dict
    model: Forest


def fit_trees(rows: DataFrame, columns: Sequence[str], n_estimators: int, learning_rate: float, max_depth: int) -> Forest:
    spec = Spec(tuple(range(len(columns))), n_estimators, learning_rate, max_depth)
    return boosting.fit_forests(rows, columns, TARGET, [spec])[0]


def predict(model: Forest, panel: DataFrame, columns: Sequence[str], name: str, splits: Sequence[str]) -> DataFrame:
    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.predict(_matrix(x, len(columns))))

    rows = only_splits(panel, *splits)
    return as_predictions(rows, name, score(_features(columns)), splits)


def _features(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def _matrix(x: pd.Series, width: int) -> np.ndarray:
    return np.array([[np.nan if v is None else v for v in row] for row in x], dtype=float).reshape(len(x), width)


def grid_search(panel: DataFrame, columns: Sequence[str], grid: Mapping[str, Sequence] = SMALL_GRID) -> Grid:
    """Fit on train, compare by validation error: a chronological split, never a random one.

    A model of n trees is the start of one with more, so each learning rate and depth is
    fitted once with the most trees and scored at every tree count.  All fits share one binned copy of the rows.
    """
    return _searches(panel, [columns], grid)[0]


def _searches(panel: DataFrame, sets: Sequence[Sequence[str]], grid: Mapping[str, Sequence]) -> list[Grid]:
    """The grid search of each set of columns, all their fits in one run."""
    names = sorted({c for columns in sets for c in columns})
    points = [(i, r, d) for i in range(len(sets)) for r, d in itertools.product(grid["learning_rate"], grid["max_depth"])]
    most, counts = max(grid["n_estimators"]), list(grid["n_estimators"])
    specs = [Spec(tuple(names.index(c) for c in sets[i]), most, r, d) for i, r, d in points]
    forests = boosting.fit_forests(only_splits(panel, "train"), names, TARGET, specs)
    errors = _staged_errors(only_splits(panel, "val"), names, forests, [s.columns for s in specs], counts)
    scores: list[list[dict]] = [[] for _ in sets]
    for at, (i, rate, depth) in enumerate(points):
        scores[i] += [{"n_estimators": n, "learning_rate": rate, "max_depth": depth, "rmse": errors[at, n], "at": at} for n in counts]
    out = []
    for of in scores:
        best = min(of, key=lambda s: (s["rmse"], s["max_depth"], s["n_estimators"]))
        model = forests[best["at"]].head(best["n_estimators"])
        out.append(Grid([{k: v for k, v in s.items() if k != "at"} for s in of],
                        {k: best[k] for k in ("n_estimators", "learning_rate", "max_depth")}, model))
    return out


def _staged_errors(rows: DataFrame, names: Sequence[str], forests: Sequence[Forest], columns: Sequence[Sequence[int]],
                   counts: Sequence[int]) -> dict[tuple[int, int], float]:
    """(model, trees) -> root mean squared error on the rows; NaN without rows.

    Rows are scored by all models in their task; a sum per model and tree count leaves it.
    """
    def score(batches):
        for batch in batches:
            if not len(batch):
                continue
            x, y, out = _matrix(batch["x"], len(names)), batch["y"].to_numpy(), []
            for i, (forest, of) in enumerate(zip(forests, columns)):
                for n, fitted in enumerate(forest.staged(x[:, list(of)])):
                    if n in counts:
                        out.append((i, n, float(((y - fitted) ** 2).sum()), len(y)))
            yield pd.DataFrame(out, columns=["model", "trees", "s", "n"])

    known = rows.where(F.col(TARGET).isNotNull()).select(F.col(TARGET).cast("double").alias("y"), _features(names).alias("x"))
    sums = known.mapInPandas(score, "model int, trees int, s double, n long").groupBy("model", "trees").agg(
        F.sqrt(F.sum("s") / F.sum("n")).alias("rmse"))
    found = {(r.model, r.trees): r.rmse for r in sums.collect()}
    return {(i, n): found.get((i, n), float("nan")) for i in range(len(forests)) for n in counts}


def families(columns: Sequence[str]) -> dict[str, list[str]]:
    """Predictors by family: price only, news only, both."""
    return {"price": [c for c in columns if c == AR_LAG],
            "news": [c for c in columns if c != AR_LAG],
            "price+news": list(columns)}


def importances(model: Forest, like: DataFrame, columns: Sequence[str], k: int | None = None) -> DataFrame:
    """``(feature, importance)``, largest first; one row per predictor."""
    pairs = sorted(zip(columns, map(float, model.importances())), key=lambda x: (-x[1], x[0]))[:k]
    return like.sparkSession.createDataFrame(pairs, "feature string, importance double")


def family_of(feature: Column) -> Column:
    return (F.when(feature.contains("diff") | feature.contains("level"), "price")
            .when(feature.contains("svd"), "tfidf_svd").otherwise("lexicon"))


def importance_by_family(table: DataFrame) -> DataFrame:
    return (table.groupBy(family_of(F.col("feature")).alias("family"))
            .agg(F.round(F.sum("importance"), 4).alias("importance")).orderBy(F.desc("importance")))


def ablation(panel: DataFrame, columns: Sequence[str],
             grid: Mapping[str, Sequence] = WIDE_GRID) -> tuple[DataFrame, dict[str, dict], Forest]:
    """Predictions of the best trees of each family, their parameters and the full test model.

    Validation rows are predicted by the model of the training rows that the grid chose, test rows by
    one refitted on training and validation rows.
    """
    of = families(columns)
    searches = dict(zip(of, _searches(panel, list(of.values()), grid)))
    names = list(columns)
    specs = [Spec(tuple(names.index(c) for c in of[f]), s.best["n_estimators"], s.best["learning_rate"], s.best["max_depth"])
             for f, s in searches.items()]
    refits = dict(zip(of, boosting.fit_forests(only_splits(panel, "train", "val"), names, TARGET, specs)))
    out = None
    for family, search in searches.items():
        for model, split in ((search.model, "val"), (refits[family], "test")):
            part = predict(model, panel, of[family], f"trees ({family})", [split])
            out = part if out is None else out.unionByName(part)
    return out, {f: s.best for f, s in searches.items()}, refits[list(of)[-1]]
