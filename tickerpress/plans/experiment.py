"""The whole model comparison on one panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tickerpress.operators import evaluate as ev
from tickerpress.operators import forecast as fc
from tickerpress.operators import panel as pn
from tickerpress.operators import trees as tr
from tickerpress.session import write_through


@dataclass
class Experiment:
    """Long predictions, the metric table, level forecasts, tree parameters and importances."""

    predictions: DataFrame
    metrics: DataFrame
    levels: DataFrame
    tree_params: dict[str, dict]
    importances: DataFrame


def run_experiment(panel: DataFrame, exog: Sequence[str] = fc.EXOGENOUS,
                   orders: Sequence[tuple[int, int]] = fc.ORDERS_BY_AIC,
                   grid: Mapping[str, Sequence] = tr.WIDE_GRID) -> Experiment:
    """Baselines, lagged regressions with and without news, and trees by feature family.

    The panel, one row per series and day, is written once and read by every
    fit; all models are scored in one aggregate.
    """
    panel = write_through(panel, "panel")
    exog = pn.feature_columns(panel.columns, wanted=list(exog))
    predictors = pn.model_columns(panel.columns)
    trees, params, model = tr.ablation(panel, predictors, grid)
    predictions = (fc.baselines(panel)
                   .unionByName(fc.rolling_best_order(panel, (), orders))
                   .unionByName(fc.rolling_best_order(panel, exog, orders))
                   .unionByName(trees))
    predictions = write_through(predictions, "predictions")
    levels = pn.level_forecast(predictions.join(
        panel.select("series_id", "obs_date", "level", "diff"), ["series_id", "obs_date"]))
    return Experiment(predictions, ev.metric_table(predictions), levels, params,
                      tr.importances(model, panel, predictors, 20))
