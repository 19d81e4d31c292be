import datetime as dtm
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tickerpress.operators import explore as ex
from tickerpress.operators import panel as pn

START = dtm.date(2024, 1, 1)


def rates(spark, n, series=("a",), level=lambda s, i: 100.0 + i * i % 7):
    rows = [(s, START + dtm.timedelta(days=i), float(level(s, i))) for s in series for i in range(n)]
    return spark.createDataFrame(rows, "series_id string, obs_date date, level double")


def features(spark, values):
    rows = [(START + dtm.timedelta(days=i), v) for i, v in values.items()]
    return spark.createDataFrame(rows, "obs_date date, score double")


def test_features_come_from_the_row_before(spark):
    feats = features(spark, {i: float(i) for i in range(12) if i != 4})
    panel = pn.build_panel(rates(spark, 12), feats).orderBy("obs_date").collect()
    assert len(panel) == 10
    for r in panel:
        i = (r["obs_date"] - START).days
        assert r["score"] == (0.0 if i - 1 == 4 else i - 1)


def test_difference_lag_and_dropped_rows(spark):
    rows = pn.build_panel(rates(spark, 6, level=lambda s, i: i * i), features(spark, {0: 1.0}))
    got = [(r["diff"], r["diff_lag1"]) for r in rows.orderBy("obs_date").collect()]
    assert got == [(3.0, 1.0), (5.0, 3.0), (7.0, 5.0), (9.0, 7.0)]


@pytest.mark.parametrize("n", [3, 7, 10, 13, 20, 93])
def test_split_is_an_ordered_partition(spark, n):
    rows = pn.split_rows(rates(spark, n, ("a", "b"))).where("series_id = 'b'").orderBy("obs_date")
    labels = [r["split"] for r in rows.collect()]
    train, val = int(n * 0.7), int(n * 0.85)
    assert labels == ["train"] * train + ["val"] * (val - train) + ["test"] * (n - val)


def test_split_bound_is_double_arithmetic(spark):
    n = 93_620
    bound = spark.range(1).select(F.floor(F.lit(n) * F.lit(0.7))).first()[0]
    assert bound == int(n * 0.7)


def test_cutoff_date(spark):
    got = pn.cutoff_date(rates(spark, 10)).first()
    assert got["cutoff"] == START + dtm.timedelta(days=7)


def test_repeated_day_is_refused(spark):
    twice = rates(spark, 3).unionByName(rates(spark, 1))
    with pytest.raises(PySparkException, match="two rows for one day"):
        pn.difference(twice).collect()


def test_column_selection():
    columns = ["series_id", "obs_date", "level", "diff", "diff_lag1", "split", "news_count",
               "title_lm_pos_mean", "text_vader_neg_std", "text_svd_0"]
    assert pn.model_columns(columns) == ["diff_lag1", "title_lm_pos_mean", "text_vader_neg_std", "text_svd_0"]
    assert pn.lexicon_columns(columns) == ["title_lm_pos_mean", "text_vader_neg_std"]
    assert pn.vector_columns(columns) == ["text_svd_0"]
    assert pn.feature_columns(columns, wanted=["text_svd_0", "gone"]) == ["text_svd_0"]
    assert pn.feature_columns(columns, prefixes=["title_"]) == ["title_lm_pos_mean"]


def test_union_splits(spark):
    got = pn.union_splits(("train", rates(spark, 2)), ("val", rates(spark, 1)))
    assert sorted(r["split"] for r in got.collect()) == ["train", "train", "val"]


# -- descriptive statistics ------------------------------------------------------

def small_panel(spark, rows):
    data = [("a", START + dtm.timedelta(days=i), "train", float(y), float(x), 1)
            for i, (y, x) in enumerate(rows)]
    return spark.createDataFrame(
        data, "series_id string, obs_date date, split string, diff double, x double, news_count int")


def test_spearman_shares_tied_ranks(spark):
    pairs = [(1, 1), (2, 1), (2, 3), (4, 2), (5, 5), (3, 5)]
    import pandas as pd
    data = pd.DataFrame(pairs, columns=["y", "x"])
    want = data["y"].rank().corr(data["x"].rank())
    panel = small_panel(spark, pairs).withColumn("flat", F.lit(2.0))
    got = ex.spearman_with_target(panel, ["x", "flat"]).collect()
    assert [r["feature"] for r in got] == ["x"]  # the constant has no correlation
    assert got[0]["rho"] == pytest.approx(want)
    matrix = {(r["a"], r["b"]): r["rho"] for r in ex.spearman_matrix(panel, ["diff", "x", "flat"]).collect()}
    assert matrix["diff", "x"] == matrix["x", "diff"] == pytest.approx(want)
    assert matrix["diff", "diff"] == pytest.approx(1.0) and matrix["flat", "x"] is None
    assert len(matrix) == 9


def test_rolling_mean_waits_for_a_full_window(spark):
    rows = ex.rolling_mean(small_panel(spark, [(i, i) for i in range(5)]), "x", 3).orderBy("obs_date")
    assert [r["rolling_mean"] for r in rows.collect()] == [None, None, 1.0, 2.0, 3.0]


def test_histogram_puts_the_maximum_in_the_last_bin(spark):
    rows = ex.histograms(small_panel(spark, [(0, x) for x in (0, 1, 2, 3, 4)]), ["x"], 4).collect()
    assert {r["bin"]: r["n"] for r in rows} == {0: 1, 1: 1, 2: 1, 3: 2}
    flat = ex.histograms(small_panel(spark, [(0, 7), (0, 7)]), ["x"], 4).collect()
    assert [(r["bin"], r["n"]) for r in flat] == [(0, 2)]


def test_permutation_null_is_repeatable_and_plausible(spark):
    import random
    rng = random.Random(1)
    panel = small_panel(spark, [(rng.random(), rng.random()) for _ in range(100)])
    a, b = (ex.permutation_null(panel, ["x"], 300).first() for _ in range(2))
    assert a == b and a["n_permutations"] == 300
    assert a["threshold"] == pytest.approx(1.96 / math.sqrt(100), abs=0.05)
