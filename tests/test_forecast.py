import datetime as dtm

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerpress.operators import arma
from tickerpress.operators import evaluate as ev
from tickerpress.operators import forecast as fc
from tickerpress.operators import trees as tr
from tickerpress.operators import boosting as bt

START = dtm.date(2000, 1, 1)
N = 400


def simulate(phi=0.5, theta=0.0, beta=0.0, n=N, seed=0, keep=0.0):
    """Regression on x with ARMA(1, 1) errors; ``keep`` is the autocorrelation of x."""
    rng = np.random.default_rng(seed)
    e, fresh = rng.normal(size=n + 1), rng.normal(size=n)
    u, x = np.zeros(n), np.zeros(n)
    for t in range(n):
        u[t] = (phi * u[t - 1] if t else 0.0) + e[t + 1] + theta * e[t]
        x[t] = (keep * x[t - 1] if t else 0.0) + fresh[t]
    return u + beta * x, x


def panel_of(spark, series):
    rows = []
    for name, (y, x) in series.items():
        for i in range(len(y)):
            split = "train" if i < int(len(y) * .7) else "val" if i < int(len(y) * .85) else "test"
            rows.append((name, START + dtm.timedelta(days=i), split, float(y[i]),
                         float(y[i - 1]) if i else None, float(x[i])))
    return spark.createDataFrame(
        rows, "series_id string, obs_date date, split string, diff double, diff_lag1 double, x double")


@pytest.fixture(scope="module")
def data():
    return {"a": simulate(seed=1, beta=0.8), "b": simulate(phi=-0.3, seed=2, beta=0.2)}


@pytest.fixture(scope="module")
def panel(spark, data):
    return panel_of(spark, data).cache()


def test_autoregression_is_least_squares_on_the_lags(panel, data):
    for r in fc.fit_arma(panel, 2, 0).collect():
        y, _ = data[r["series_id"]]
        rows = np.arange(2, int(N * .7))
        z = np.column_stack([np.ones(len(rows)), y[rows - 1], y[rows - 2]])
        want, rss, *_ = np.linalg.lstsq(z, y[rows], rcond=None)
        mean, *phi = r["coef"]
        np.testing.assert_allclose([mean * (1 - sum(phi)), *phi], want, atol=1e-8)
        assert r["rss"] == pytest.approx(rss[0]) and r["n"] == len(rows)


def test_regressions_with_arma_errors_are_recovered(spark):
    cases = {"ar": (0.7, 0.0, 2.0), "arma": (0.5, 0.6, 1.0), "both": (-0.3, -0.4, 0.5)}
    data = panel_of(spark, {k: simulate(phi, theta, b, 4000, 7, 0.8) for k, (phi, theta, b) in cases.items()})
    terms = fc.term_names(1, 1, ["x"])
    for r in fc.fit_arma(data, 1, 1, ["x"]).collect():
        got, (phi, theta, b) = dict(zip(terms, r["coef"])), cases[r["series_id"]]
        assert got["x"] == pytest.approx(b, abs=0.06) and got["ar1"] == pytest.approx(phi, abs=0.06)
        assert got["ma1"] == pytest.approx(theta, abs=0.08)
    errors = fc.rolling_forecast(data, 1, 1, ["x"], splits=("test",)).groupBy("series_id").agg(
        ev.rmse(F.col("y"), F.col("y_hat")).alias("rmse"))
    assert all(r["rmse"] == pytest.approx(1.0, abs=0.06) for r in errors.collect())


def one_step(coef, y, x, p, q):
    """Forecasts by a plain loop."""
    c, b, phi, theta = coef[0], coef[1], coef[2:2 + p], coef[2 + p:]
    u, e, out = y - c - b * x, np.zeros(len(y)), np.full(len(y), np.nan)
    for t in range(p, len(y)):
        step = sum(phi[i] * u[t - 1 - i] for i in range(p)) + sum(
            theta[j] * e[t - 1 - j] for j in range(q) if t - 1 - j >= p)
        out[t], e[t] = c + b * x[t] + step, u[t] - step
    return out, u, e


def test_rolling_and_horizon_forecasts_against_a_loop(panel, data):
    y, x = data["a"]
    at, end = int(N * .7), int(N * .85)
    coef = np.array(fc.fit_orders(panel, [(2, 1)], ["x"]).where("series_id = 'a'").first()["coef"])
    want, u, e = one_step(coef, y, x, 2, 1)
    rolled = fc.rolling_forecast(panel, 2, 1, ["x"]).where("series_id = 'a'").orderBy("obs_date").collect()
    np.testing.assert_allclose([r["y_hat"] for r in rolled], want[at:end], atol=1e-8)
    got = fc.horizon_forecast(panel, [(0, 0), (2, 1)], ["x"]).where("series_id = 'a' AND p = 2").orderBy("obs_date").collect()
    assert len(got) == end - at and {r["split"] for r in got} == {"val"}
    lags, shock = [u[at - 1], u[at - 2]], e[at - 1]
    for t, r in enumerate(got):
        step = coef[2] * lags[0] + coef[3] * lags[1] + coef[4] * shock
        assert r["y_hat"] == pytest.approx(coef[0] + coef[1] * x[at + t] + step, abs=1e-8)
        lags, shock = [step, lags[0]], 0.0


def test_refits_and_orders_of_one_series_are_many_groups(panel, monkeypatch):
    one = panel.where("series_id = 'a'")
    whole = {r["obs_date"]: r["y_hat"] for r in fc.expanding_refit(one, 1, 1, ["x"]).collect()}
    for size in (1, 7, 1000):
        monkeypatch.setattr(fc, "REFITS", size)
        got = fc.expanding_refit(one, 1, 1, ["x"]).collect()
        assert len(got) == len(whole)
        assert all(r["y_hat"] == pytest.approx(whole[r["obs_date"]], abs=1e-5) for r in got)
    seen = []
    monkeypatch.setattr(fc, "_by_series", lambda rows, exog, work, schema, units=(): seen.append((units, rows.select(*units).distinct().count())))
    fc.fit_orders(one, fc.ORDERS_BY_AIC)
    fc.horizon_forecast(one, fc.ORDERS_BY_RMSE)
    monkeypatch.setattr(fc, "REFITS", 20)
    fc.expanding_refit(one)
    assert seen == [(("p", "q"), 9), (("p", "q"), 4), (("block",), 3)]


def test_expanding_refit_against_refits_from_scratch(panel, data):
    out = fc.expanding_refit(panel, 1, 1, ["x"]).where("series_id = 'a'").orderBy("obs_date").collect()
    y, x = data["a"]
    first = int(N * .85)
    assert len(out) == N - first
    for k in (0, 17, N - first - 1):
        m = arma.fit(y[:first + k], x[:first + k, None], 1, 1)
        want = one_step(m.values, y[:first + k + 1], x[:first + k + 1], 1, 1)[0][-1]
        assert out[k]["y_hat"] == pytest.approx(want, abs=1e-4)


def test_short_series_and_gaps_give_null_forecasts(spark):
    short = panel_of(spark, {"s": simulate(n=12)})
    for out in (fc.expanding_refit(short, 3, 3, ["x"]), fc.rolling_forecast(short, 3, 3, ["x"], splits=("test",))):
        assert [r["y_hat"] for r in out.collect()] == [None, None]
    holes = panel_of(spark, {"h": simulate(n=100)}).withColumn("x", F.when(F.dayofmonth("obs_date") != 28, F.col("x")))
    out = fc.rolling_forecast(holes, 1, 0, ["x"], splits=("val", "test")).collect()
    assert len(out) == 30 and sum(r["y_hat"] is None for r in out) == sum(r["obs_date"].day == 28 for r in out)


def test_constant_regressor_does_not_break_the_solve(spark, panel):
    for r in fc.fit_arma(panel.withColumn("x", F.lit(0.0)), 1, 0, ["x"]).collect():
        assert r["coef"][1] == pytest.approx(0.0) and np.isfinite(r["coef"]).all()


def test_orders_are_found(spark):
    data = panel_of(spark, {"m": simulate(phi=0.5, theta=0.6, n=3000, seed=5)})
    best = fc.best_order(fc.order_by_aic(data)).first()
    assert best["p"] >= 1 and best["q"] >= 1
    assert {"aic", "bic", "hqic", "loglik"} <= set(best.asDict())


def test_order_by_validation_gives_one_order_per_series(panel):
    got = fc.order_by_validation(panel, exog=["x"]).collect()
    assert sorted(r["series_id"] for r in got) == ["a", "b"]


def test_rolling_best_order_covers_both_splits(panel):
    got = fc.rolling_best_order(panel, ["x"], [(0, 0), (1, 0)])
    counts = {(r["series_id"], r["split"]): r["count"]
              for r in got.groupBy("series_id", "split").count().collect()}
    assert counts == {(s, k): 60 for s in "ab" for k in ("val", "test")}
    assert got.where("y_hat IS NULL").count() == 0


def test_scaling_uses_fit_rows_and_survives_constants(spark, panel, data):
    got = fc.standardise(panel.withColumn("c", F.lit(3.0)), ["x", "c"]).where("series_id = 'a'")
    x = data["a"][1]
    train = x[:int(N * .7)]
    values = np.array([r["x"] for r in got.orderBy("obs_date").collect()])
    np.testing.assert_allclose(values, (x - train.mean()) / train.std())
    assert {r["c"] for r in got.collect()} == {0.0}


def test_baselines(spark):
    y = [1.0, -1.0] * 50  # 35 of the 70 training days rise
    panel = panel_of(spark, {"a": (np.array(y), np.zeros(100))})
    got = fc.baselines(panel)
    assert {r["y_hat"] for r in got.where("model = 'majority'").collect()} == {-1.0}  # half is no majority
    assert got.where("model = 'zero' AND y_hat <> 0").count() == 0
    assert got.where("model = 'persistence' AND split = 'val'").orderBy("obs_date").first()["y_hat"] == y[69]


# -- metrics -------------------------------------------------------------------

def scores(spark, pairs):
    rows = [("a", START, "val", "m", float(y), float(p)) for y, p in pairs]
    return spark.createDataFrame(
        rows, "series_id string, obs_date date, split string, model string, y double, y_hat double")


def test_zero_change_days(spark):
    df = scores(spark, [(1, 2), (0, 0), (-1, 3), (0, 1)])
    y, p = F.col("y"), F.col("y_hat")
    got = df.agg(ev.direction_accuracy_all(y, p).alias("all"), ev.direction_accuracy(y, p).alias("moved")).first()
    assert (got["all"], got["moved"]) == (50.0, 50.0)
    df = scores(spark, [(1, 2), (0, 0), (-1, -3)])
    got = df.agg(ev.direction_accuracy_all(y, p).alias("all"), ev.direction_accuracy(y, p).alias("moved")).first()
    assert got["all"] == pytest.approx(100.0) and got["moved"] == 100.0


def test_metric_table(spark):
    # Truth up, up, down, down; called up, down, up, down.
    row = ev.metric_table(scores(spark, [(1, 1), (2, -1), (-1, 1), (-2, -2)])).first()
    assert row["n"] == 4 and row["da"] == 50.0
    assert row["f1_up"] == 0.5 and row["f1_macro"] == 0.5
    assert row["rmse"] == round(np.sqrt((0 + 9 + 4 + 0) / 4), 2)
    assert row["mae"] == 1.25
    assert row["skill"] == round((1 - np.sqrt(13 / 4) / np.sqrt(10 / 4)) * 100, 2)


def test_missing_forecasts_are_counted(spark):
    df = scores(spark, [(1, 1), (2, 5)]).withColumn("y_hat", F.when(F.col("y") == 1, F.col("y_hat")))
    row = ev.metric_table(df).first()
    assert (row["n"], row["n_missing"], row["rmse"]) == (2, 1, 0.0)


def test_all_zero_predictions_have_no_direction(spark):
    row = ev.metric_table(scores(spark, [(1, 0), (-1, 0)])).first()
    assert row["da"] is None and row["f1_up"] is None and row["f1_macro"] is None
    assert row["skill"] == 0.0


def test_macro_f1_over_seen_classes_only(spark):
    # Every truth and every call is up: one class, F1 of 1.
    row = ev.metric_table(scores(spark, [(1, 1), (2, 1)])).first()
    assert row["f1_macro"] == 1.0 and row["f1_up"] == 1.0
    # A zero prediction counts as "not up".
    row = ev.metric_table(scores(spark, [(1, 1), (2, 0)])).first()
    assert row["f1_up"] == round(2 / 3, 3) and row["f1_macro"] == round((2 / 3 + 0) / 2, 3)


# -- trees ---------------------------------------------------------------------

def test_trees(spark, panel):
    one = panel.where("series_id = 'a' AND diff_lag1 IS NOT NULL").repartition(2).cache()
    columns = ["diff_lag1", "x"]
    grid = tr.grid_search(one, columns, {"n_estimators": (2, 5), "learning_rate": (0.1,), "max_depth": (2,)})
    assert len(grid.scores) == 2
    # The score of fewer trees is that of a model fitted with fewer trees.
    small = tr.fit_trees(one.where("split = 'train'"), columns, 2, 0.1, 2)
    val = tr.predict(small, one, columns, "t", ["val"])
    rmse = val.agg(ev.rmse(F.col("y"), F.col("y_hat"))).first()[0]
    assert rmse == pytest.approx([s for s in grid.scores if s["n_estimators"] == 2][0]["rmse"])
    again = tr.predict(tr.fit_trees(one.where("split = 'train'"), columns, 2, 0.1, 2), one, columns, "t", ["val"])
    assert sorted(r["y_hat"] for r in again.collect()) == sorted(r["y_hat"] for r in val.collect())
    fit = tr.predict(small, one, columns, "t", ["train"])
    errors = fit.agg(ev.rmse(F.col("y"), F.col("y_hat")).alias("m"), F.stddev_pop("y").alias("s")).first()
    assert errors["m"] < errors["s"]
    table = tr.importances(small, one, columns)
    assert sum(r["importance"] for r in table.collect()) == pytest.approx(1.0)


def test_tree_queries_take_the_whole_grids_and_all_predictors(spark, monkeypatch):
    import datetime as dt

    from workload import models as m
    days = [(dt.date(2024, 1, 1) + dt.timedelta(i), float(i), 1.0, 2.0, 3) for i in range(20)]
    made = spark.createDataFrame(days, "obs_date date, title_lm_pos_mean double, text_svd_0 double, text_svd_1 double, news_count int")
    rates = spark.createDataFrame([("ALL", x[0], 100.0 + i * i % 7) for i, x in enumerate(days)],
                                  "series_id string, obs_date date, level double")
    monkeypatch.setattr(m, "_daily_features", lambda s, d: made)
    monkeypatch.setattr(m.v, "rate", lambda s, d: rates)
    asked = []

    class Stop(Exception):
        pass

    def stop(panel, columns, *args, **kwargs):
        asked.append((sorted(columns), args[0] if args else kwargs))
        raise Stop

    for name in ("fit_trees", "grid_search", "ablation"):
        monkeypatch.setattr(m.tr, name, stop)
    for run in (m.m12, m.m13, m.m14, m.m15, m.m16, m.m17_trees):
        with pytest.raises(Stop):
            run(spark, "unused")
    assert sum(d == "unused" for _, d in m._TREE_PANELS) == 1  # one panel for all of them
    names = ["diff_lag1", "text_svd_0", "text_svd_1", "title_lm_pos_mean"]
    assert asked == [(names, x) for x in (tr.FINAL, tr.SMALL_GRID, tr.WIDE_GRID, tr.FINAL, tr.FINAL, tr.FINAL)]


def test_families(spark):
    assert tr.families(["diff_lag1", "a", "b"]) == {
        "price": ["diff_lag1"], "news": ["a", "b"], "price+news": ["diff_lag1", "a", "b"]}
    table = spark.createDataFrame([("diff_lag1", 0.5), ("text_svd_1", 0.2), ("title_lm_pos_mean", 0.2),
                                   ("text_vader_neg_max", 0.1)], "feature string, importance double")
    assert {r["family"]: r["importance"] for r in tr.importance_by_family(table).collect()} == {
        "price": 0.5, "tfidf_svd": 0.2, "lexicon": 0.3}


def _panel_rows(n, seed=0, missing=0.1):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 4)), 1)
    y = 2 * (x[:, 0] > 0.3) - x[:, 1] * (x[:, 2] > 0) + r.normal(scale=0.3, size=n)
    x[r.random((n, 4)) < missing] = np.nan
    return x, y


def _brute_boost(x, y, n_trees, rate, depth):
    """Boosting row by row and cut by cut, over the same cut points."""
    edges = [np.unique(np.quantile(c[~np.isnan(c)], np.arange(1, bt.BINS) / bt.BINS, method="inverted_cdf")) for c in x.T]
    fitted, gains = np.full(len(y), y.mean()), []

    def score(g):
        return g.sum() ** 2 / (len(g) + 1)

    def split(rows, g, level):
        best = (1e-9, None, None)
        if level < depth:
            for c in range(x.shape[1]):
                for cut in edges[c]:
                    for missing_left in (False, True):
                        left = np.where(np.isnan(x[rows, c]), missing_left, x[rows, c] <= cut)
                        if left.all() or not left.any():
                            continue
                        gain = score(g[rows][left]) + score(g[rows][~left]) - score(g[rows])
                        if gain > best[0] * (1 + 1e-6):
                            best = (gain, left, c)
        if best[1] is None:
            out[rows] = g[rows].sum() / (len(rows) + 1)
            return
        gains.append((best[2], best[0]))
        split(rows[best[1]], g, level + 1)
        split(rows[~best[1]], g, level + 1)

    for _ in range(n_trees):
        out = np.zeros(len(y))
        split(np.arange(len(y)), y - fitted, 0)
        fitted = fitted + rate * out
    return fitted, gains


def _tree_frame(spark, x, y):
    rows = [(float(v), *[None if np.isnan(a) else float(a) for a in r]) for v, r in zip(y, x)]
    return spark.createDataFrame(rows, "y double, a double, b double, c double, d double")


def test_boosting_like_brute_force(spark):
    x, y = _panel_rows(160)
    want, gains = _brute_boost(x, y, 6, 0.3, 3)
    forest = bt.fit_forests(_tree_frame(spark, x, y), list("abcd"), "y", [bt.Spec((0, 1, 2, 3), 6, 0.3, 3)])[0]
    assert forest.predict(x) == pytest.approx(want)
    mean = np.array([np.mean([g for c, g in gains if c == i] or [0]) for i in range(4)])
    assert forest.importances() == pytest.approx(mean / mean.sum())


def test_lockstep_over_blocks_equals_fits_one_by_one(spark, monkeypatch):
    x, y = _panel_rows(300, 1)
    frame = _tree_frame(spark, x, y).repartition(3).cache()
    specs = [bt.Spec((0, 1, 2, 3), 4, 0.3, 3), bt.Spec((1, 3), 3, 0.1, 2), bt.Spec((2,), 5, 0.5, 1)]
    apart = bt.fit_forests(frame, list("abcd"), "y", specs)
    alone = [bt.fit_forests(frame, list("abcd"), "y", [s])[0] for s in specs]
    monkeypatch.setattr(bt, "BLOCK", 64)
    blocks = bt.fit_forests(frame, list("abcd"), "y", specs)
    for s, a, b, c in zip(specs, apart, alone, blocks):
        own = x[:, list(s.columns)]
        assert len(a.trees) == len(c.trees) == s.n_trees
        assert b.predict(own) == pytest.approx(a.predict(own))
        assert c.predict(own) == pytest.approx(a.predict(own))


def test_boosting_without_rows_values_or_splits(spark):
    schema = "y double, a double"
    none = bt.fit_forests(spark.createDataFrame([], schema), ["a"], "y", [bt.Spec((0,), 2, 0.1, 2)])[0]
    assert none.trees == []
    flat = bt.fit_forests(spark.createDataFrame([(1.0, None), (3.0, None), (None, 5.0)], schema), ["a"], "y", [bt.Spec((0,), 2, 0.5, 2)])[0]
    assert flat.predict(np.array([[np.nan], [4.0]])) == pytest.approx([2.0, 2.0])
    assert flat.importances().tolist() == [0.0]


def test_refits_of_one_series_are_spread_over_tasks(spark, panel, monkeypatch):
    monkeypatch.setattr(fc, "REFITS", 6)
    one = panel.where("series_id = 'a'")
    out = fc.expanding_refit(one, 1, 0).withColumn("task", F.spark_partition_id()).collect()
    assert len(out) == 60 and all(r["y_hat"] is not None for r in out)
    assert len({r["task"] for r in out}) >= 5  # of ten blocks; all in one where rows are few and go by bytes
