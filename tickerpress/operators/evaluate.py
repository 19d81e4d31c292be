"""Regression and direction metrics over long prediction tables.

Predictions are ``(series_id, obs_date, split, model, y, y_hat)``.  Every metric
is an aggregate expression, so all models and splits are scored in one pass
with map-side partials.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def direction_accuracy_all(y: Column, p: Column) -> Column:
    """Percent of days with the right sign, unchanged days counted as a sign of their own."""
    return F.avg((F.signum(y) == F.signum(p)).cast("double")) * 100.0


def direction_accuracy(y: Column, p: Column) -> Column:
    """Percent of days with the right sign, days without a true change left out."""
    return F.avg(F.when(y != 0, (F.signum(y) == F.signum(p)).cast("double"))) * 100.0


def _class_f1(truth: Column, guess: Column) -> Column:
    hits = F.count(F.when(truth & guess, 1))
    claims = F.count(F.when(truth, 1)) + F.count(F.when(guess, 1))
    return F.when(claims > 0, 2.0 * hits / F.when(claims > 0, claims)).otherwise(F.lit(0.0))


def f1_up(y: Column, p: Column) -> Column:
    """F1 of "up" on days with a true change; 0 where undefined."""
    moved = y != 0
    return _class_f1(moved & (y > 0), moved & (p > 0))


def f1_macro(y: Column, p: Column) -> Column:
    """Mean F1 over the classes that occur in truth or prediction."""
    moved = y != 0
    up, guess_up = moved & (y > 0), moved & (p > 0)
    down, guess_down = moved & (y < 0), moved & ~(p > 0)
    seen_up = F.count(F.when(up | guess_up, 1)) > 0
    seen_down = F.count(F.when(down | guess_down, 1)) > 0
    total = (F.when(seen_up, _class_f1(up, guess_up)).otherwise(0.0)
             + F.when(seen_down, _class_f1(down, guess_down)).otherwise(0.0))
    classes = seen_up.cast("int") + seen_down.cast("int")
    return F.when(classes > 0, total / F.when(classes > 0, classes)).otherwise(F.lit(0.0))


def skill(y: Column, p: Column) -> Column:
    """Percent by which the error is below that of predicting no change."""
    base = F.sqrt(F.avg(y * y))
    return F.when(base > 0, (1.0 - rmse(y, p) / F.when(base > 0, base)) * 100.0)


def unless_all_zero(metric: Column, p: Column) -> Column:
    """Null for a model that never predicts a direction."""
    return F.when(F.max(F.abs(p)) > 0, metric)


# Reported digits per metric.
DIGITS = {"rmse": 2, "mae": 2, "da": 1, "f1_up": 3, "f1_macro": 3, "skill": 2}


def metric_table(predictions: DataFrame, by: Sequence[str] = ("model", "split"),
                 digits: dict[str, int] | None = None) -> DataFrame:
    """All metrics per model and split, rounded.

    ``n`` counts all rows, ``n_missing`` those without truth or forecast; errors are those of the other rows.
    """
    digits = digits or DIGITS
    y, p = F.col("y"), F.col("y_hat")
    metrics = {
        "rmse": rmse(y, p), "mae": mae(y, p),
        "da": unless_all_zero(direction_accuracy(y, p), p),
        "f1_up": unless_all_zero(f1_up(y, p), p),
        "f1_macro": unless_all_zero(f1_macro(y, p), p),
        "skill": skill(y, p),
    }
    missing = y.isNull() | p.isNull()
    known = predictions.withColumns({"y": F.when(~missing, y), "y_hat": F.when(~missing, p), "missing_": missing.cast("int")})
    return known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("missing_").alias("n_missing"),
        *[F.round(m, digits[name]).alias(name) for name, m in metrics.items()])


def dispersion(predictions: DataFrame, by: Sequence[str] = ("model", "split")) -> DataFrame:
    """Population deviation of truth and prediction."""
    return predictions.groupBy(*by).agg(F.stddev_pop("y").alias("std_y"),
                                        F.stddev_pop("y_hat").alias("std_y_hat"))
