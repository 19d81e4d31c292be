"""The final evaluation on the test split."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tickerpress.operators import evaluate as ev
from tickerpress.operators import forecast as fc
from tickerpress.operators import panel as pn
from tickerpress.operators import trees as tr
from tickerpress.session import write_through
from tickerpress.sources.tables import write_json

#: Predictors that carry the largest importances, as reported.
TOP = 20


@dataclass
class Evaluation:
    """Long test predictions, the metric table, the trees' largest importances and their sums by family."""

    predictions: DataFrame
    metrics: DataFrame
    importances: DataFrame
    families: DataFrame


def run_evaluation(panel: DataFrame, exog: Sequence[str] = fc.EXOGENOUS,
                   trees: Mapping[str, float] = tr.FINAL,
                   folder: str | None = None) -> Evaluation:
    """Baselines, an expanding regression with ARMA(1, 1) errors on scaled scores, and the final trees.

    Everything is fitted on training and validation rows; the regression is
    refitted as test rows pass.  The majority call is that of the test split itself, as an upper
    bound.  ``folder`` takes the parameters and the metric table as JSON.
    """
    panel = write_through(panel, "panel")
    history = ("train", "val")
    exog = pn.feature_columns(panel.columns, wanted=list(exog))
    predictors = [c for c in pn.model_columns(panel.columns) if c != "news_count"]
    scaled = fc.standardise(panel, exog, history)
    model = tr.fit_trees(pn.only_splits(panel, *history), predictors, **trees)
    predictions = write_through(
        fc.zero_change(panel, ("test",))
        .unionByName(fc.majority_direction(panel, ("test",), ("test",)))
        .unionByName(fc.persistence(panel, ("test",)))
        .unionByName(fc.expanding_refit(scaled, 1, 1, exog, model="arimax"))
        .unionByName(tr.predict(model, panel, predictors, "trees", ["test"])), "test-predictions")
    metrics = ev.metric_table(predictions)
    importances = tr.importances(model, panel, predictors, TOP)
    if folder is not None:
        parameters = [(name, float(value)) for name, value in trees.items()]
        write_json(panel.sparkSession.createDataFrame(parameters, "name string, value double"), f"{folder}/parameters")
        write_json(metrics, f"{folder}/metrics")
    return Evaluation(predictions, metrics, importances, tr.importance_by_family(importances))
