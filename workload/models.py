"""Descriptive statistics, forecasts and metrics over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerpress.operators import alignment as al
from tickerpress.operators import evaluate as ev
from tickerpress.operators import explore as ex
from tickerpress.operators import forecast as fc
from tickerpress.operators import panel as pn
from tickerpress.operators import trees as tr
from tickerpress.session import scratch_path, write_through
from workload import views as v
from workload.articles import aligned
from workload.features import (FEATURES, PANEL_SQL, SCORED_PANEL_SQL, panel, scored_panel)

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


# -- descriptive statistics ----------------------------------------------------

@query("e1_level_ranges", PANEL_SQL + """
    SELECT series_id, split, CAST(round(min(level)) AS BIGINT) AS level_min,
           CAST(round(max(level)) AS BIGINT) AS level_max,
           CAST(round(avg(level)) AS BIGINT) AS level_mean FROM panel GROUP BY 1, 2""")
def e1(spark, d):
    return ex.level_ranges(panel(spark, d))


@query("e2_rolling_mean", PANEL_SQL + f"""
    SELECT series_id, obs_date, split, CASE WHEN count(news_count) OVER w = 20
           THEN {v.r('avg(news_count) OVER w')} END AS rolling_mean FROM panel
    WINDOW w AS (PARTITION BY series_id, split ORDER BY obs_date
                 ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def e2(spark, d):
    out = ex.rolling_mean(panel(spark, d), "news_count")
    return v.rounded(out.select("series_id", "obs_date", "split", "rolling_mean"))


@query("e3_volume_profile", PANEL_SQL + f"""
    SELECT series_id, split, {v.r('avg(news_count)')} AS mean_articles,
           {v.r('median(news_count)')} AS median_articles, max(news_count) AS max_articles,
           {v.r('avg(CASE WHEN news_count = 0 THEN 1.0 ELSE 0.0 END)')} AS share_without_news
    FROM panel GROUP BY 1, 2""")
def e3(spark, d):
    return v.rounded(ex.volume_profile(panel(spark, d)))


def long_sql(columns, extra: str = "", where: str = "") -> str:
    """CTE ``long(series_id, extra, feature, value)`` of panel columns."""
    parts = [f"SELECT series_id{extra}, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM panel {where}"
             for c in columns]
    return "long AS (" + " UNION ALL ".join(parts) + ")"


@query("e4_describe", SCORED_PANEL_SQL + ", " + long_sql(FEATURES, where="WHERE news_count > 0") + f"""
    SELECT series_id, feature, count(*) AS n, {v.r('avg(value)')} AS mean,
        {v.r('stddev_samp(value)')} AS std, {v.r('min(value)')} AS min,
        {v.r('quantile_cont(value, 0.25)')} AS q25, {v.r('quantile_cont(value, 0.5)')} AS q50,
        {v.r('quantile_cont(value, 0.75)')} AS q75, {v.r('max(value)')} AS max
    FROM long GROUP BY 1, 2""")
def e4(spark, d):
    return v.rounded(ex.describe_features(scored_panel(spark, d), FEATURES))


_RANKS = """
    ranked AS (SELECT series_id, feature,
        rank() OVER (PARTITION BY series_id, feature ORDER BY round(value, 9))
          + (count(*) OVER (PARTITION BY series_id, feature, round(value, 9)) - 1) / CAST(2 AS DOUBLE) AS rx,
        rank() OVER (PARTITION BY series_id, feature ORDER BY round(y, 9))
          + (count(*) OVER (PARTITION BY series_id, feature, round(y, 9)) - 1) / CAST(2 AS DOUBLE) AS ry
        FROM long),
    rho AS (SELECT series_id, feature, corr(rx, ry) AS rho FROM ranked GROUP BY 1, 2
            HAVING min(rx) < max(rx) AND min(ry) < max(ry))"""
_MEANS = [f"{p}_{s}_mean" for p in ("title", "text") for s in (
    "vader_neg", "vader_neu", "vader_pos", "vader_compound", "lm_pos", "lm_neg", "lm_unc",
    "lm_polarity", "lm_unc_ratio", "lm_hit")]


@query("e5_top_correlations", SCORED_PANEL_SQL + ", " + long_sql(
    _MEANS, ", diff AS y", "WHERE split = 'train'") + "," + _RANKS + f"""
    SELECT series_id, feature, {v.r('rho')} AS rho, {v.r('abs(rho)')} AS abs_rho, place FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY series_id
            ORDER BY round(abs(rho), 9) DESC, feature) AS INTEGER) AS place FROM rho)
    WHERE place <= 12""")
def e5(spark, d):
    whole = scored_panel(spark, d)
    columns = [c for c in pn.lexicon_columns(whole.columns) if c.endswith("_mean")]
    return v.rounded(ex.top_correlations(pn.only_splits(whole, "train"), columns))


# The scores that are described first.
_MAIN = ["text_vader_compound_mean", "text_lm_polarity_mean", "title_vader_compound_mean", "text_lm_unc_ratio_mean"]
_MATRIX = ["diff", "diff_lag1", "news_count", *_MAIN]


@query("e6_spearman_matrix", SCORED_PANEL_SQL + ", wide AS (SELECT series_id, " + ", ".join(
    f"rank() OVER (PARTITION BY series_id ORDER BY round({c}, 9)) + (count(*) OVER (PARTITION BY series_id, round({c}, 9))"
    f" - 1) / CAST(2 AS DOUBLE) AS {c}" for c in _MATRIX) + " FROM panel) " + " UNION ALL ".join(
    f"SELECT series_id, '{a}' AS a, '{b}' AS b, {v.r(f'corr({a}, {b})')} AS rho FROM wide GROUP BY 1"
    for a in _MATRIX for b in _MATRIX))
def e6(spark, d):
    return v.rounded(ex.spearman_matrix(scored_panel(spark, d), _MATRIX))


@query("e7_split_summary", PANEL_SQL + f"""
    SELECT series_id, split, count(*) AS n_days, min(obs_date) AS first_date,
           max(obs_date) AS last_date, min(level) AS level_min, max(level) AS level_max,
           {v.r('avg(news_count)')} AS articles_per_day,
           {v.r('avg(CASE WHEN diff > 0 THEN 1.0 ELSE 0.0 END)')} AS share_up
    FROM panel GROUP BY 1, 2""")
def e7(spark, d):
    return v.rounded(ex.split_summary(panel(spark, d)), "articles_per_day", "share_up")


@query("e8_histograms", SCORED_PANEL_SQL + ", exact AS (SELECT series_id, news_count, "
       + ", ".join(f"{v.r(c, 9)} AS {c}" for c in _MAIN) + " FROM panel), "
       + long_sql(_MAIN, where="WHERE news_count > 0").replace("FROM panel", "FROM exact") + """,
    edges AS (SELECT series_id, feature, min(value) AS lo, max(value) AS hi FROM long GROUP BY 1, 2)
    SELECT series_id, feature, CASE WHEN hi > lo THEN CAST(least(floor((value - lo)
           / ((hi - lo) / CAST(40 AS DOUBLE))), 39) AS INTEGER) ELSE 0 END AS bin, count(*) AS n
    FROM long JOIN edges USING (series_id, feature) GROUP BY 1, 2, 3""")
def e8(spark, d):
    return ex.histograms(v.rounded(scored_panel(spark, d), *_MAIN, digits=9), _MAIN)


@query("e9_profile", SCORED_PANEL_SQL + """
    SELECT count(*) AS panel_rows, min(obs_date) AS first_date, max(obs_date) AS last_date,
        (SELECT count(*) FROM aligned) AS articles,
        (SELECT count(DISTINCT obs_date) FROM rate) AS sessions, 87 AS panel_columns,
        80 AS lexicon_features, 0 AS vector_features FROM panel""")
def e9(spark, d):
    whole = scored_panel(spark, d)
    return ex.profile(whole, aligned(spark, d), al.trading_calendar(v.rate(spark, d)),
                      pn.lexicon_columns(whole.columns), pn.vector_columns(whole.columns))


_WIDE_RANKS = ", ".join(
    f"rank() OVER (PARTITION BY series_id ORDER BY round({c}, 9)) + (count(*) OVER (PARTITION BY series_id, "
    f"round({c}, 9)) - 1) / CAST(2 AS DOUBLE) AS {c}" for c in ["diff", *_MEANS])
_BEST = ", ".join(f"CASE WHEN min({c}) < max({c}) THEN abs(corr({c}, ry)) END" for c in _MEANS)


@query("e10_permutation_null", SCORED_PANEL_SQL + f""",
    ordered AS (SELECT series_id, obs_date, {_WIDE_RANKS},
        row_number() OVER (PARTITION BY series_id ORDER BY obs_date) AS place FROM panel WHERE split = 'train'),
    dealt AS (SELECT series_id, permutation, diff AS ry, row_number() OVER (PARTITION BY series_id, permutation
        ORDER BY md5(concat_ws('|', series_id, CAST(obs_date AS VARCHAR), permutation)), obs_date) AS place
        FROM ordered, range(1, 201) p(permutation)),
    best AS (SELECT series_id, permutation, greatest({_BEST}, 0.0) AS best
        FROM dealt JOIN ordered USING (series_id, place) GROUP BY 1, 2)
    SELECT series_id, count(*) AS n_permutations, {v.r('quantile_cont(best, 0.95)')} AS threshold,
           {v.r('avg(best)')} AS mean_best FROM best GROUP BY 1""")
def e10(spark, d):
    train = pn.only_splits(_news_panel(spark, d), "train")
    return v.rounded(ex.permutation_null(train, _MEANS, 200))


# -- forecasts -----------------------------------------------------------------

@query("m1_standardise", PANEL_SQL + f"""
    SELECT series_id, obs_date, split, {v.r('''(n_chars_mean
        - avg(CASE WHEN split = 'train' THEN n_chars_mean END) OVER s)
        / coalesce(nullif(stddev_pop(CASE WHEN split = 'train' THEN n_chars_mean END) OVER s, 0), 1)
        ''')} AS n_chars_mean FROM panel WINDOW s AS (PARTITION BY series_id)""")
def m1(spark, d):
    out = fc.standardise(panel(spark, d), ["n_chars_mean"])
    return v.rounded(out.select("series_id", "obs_date", "split", "n_chars_mean"))


BASELINES_CTE = """, calls AS (SELECT *, CASE WHEN avg(CASE WHEN split = 'train' THEN
        CASE WHEN diff > 0 THEN 1.0 ELSE 0.0 END END) OVER (PARTITION BY series_id) > 0.5
        THEN 1 ELSE -1 END AS call,
        CASE WHEN avg(CASE WHEN split = 'test' THEN CASE WHEN diff > 0 THEN 1.0 ELSE 0.0 END END)
        OVER (PARTITION BY series_id) > 0.5 THEN 1 ELSE -1 END AS peek FROM panel),
    predictions AS (
        SELECT series_id, obs_date, split, 'zero' AS model, diff AS y, CAST(0 AS DOUBLE) AS y_hat
        FROM calls WHERE split <> 'train'
        UNION ALL SELECT series_id, obs_date, split, 'majority', diff, CAST(call AS DOUBLE)
        FROM calls WHERE split <> 'train'
        UNION ALL SELECT series_id, obs_date, split, 'persistence', diff, diff_lag1
        FROM calls WHERE split <> 'train')
"""
_PREDICTION_COLUMNS = (f"SELECT series_id, obs_date, split, model, {v.r('y')} AS y, "
                       f"{v.r('y_hat')} AS y_hat FROM predictions ")


def price_panel(spark, d):
    """Five price series without features."""
    changed = pn.lag_target(pn.difference(v.rate_multi(spark, d)))
    return pn.split_rows(pn.drop_incomplete(changed))


def predictions(spark, d):
    return fc.baselines(price_panel(spark, d))


@query("m2_zero_change", PANEL_SQL + BASELINES_CTE + _PREDICTION_COLUMNS + "WHERE model = 'zero'")
def m2(spark, d):
    return v.rounded(fc.zero_change(price_panel(spark, d)))


@query("m3_majority_train", PANEL_SQL + BASELINES_CTE + _PREDICTION_COLUMNS
       + "WHERE model = 'majority'")
def m3(spark, d):
    return v.rounded(fc.majority_direction(price_panel(spark, d)))


@query("m3_majority_test", PANEL_SQL + BASELINES_CTE + f"""
    SELECT series_id, obs_date, split, 'majority' AS model, {v.r('diff')} AS y,
           CAST(peek AS DOUBLE) AS y_hat FROM calls WHERE split = 'test'""")
def m3_test(spark, d):
    return v.rounded(fc.majority_direction(price_panel(spark, d), ("test",), ("test",)))


@query("m4_persistence", PANEL_SQL + BASELINES_CTE + _PREDICTION_COLUMNS
       + "WHERE model = 'persistence'")
def m4(spark, d):
    return v.rounded(fc.persistence(price_panel(spark, d)))


#: The regressors of the comparison: mean scores of titles and texts.
_EXOG = list(fc.EXOGENOUS)


def _news_panel(spark, d):
    """One series with its scores, written once for the many fits."""
    return write_through(scored_panel(spark, d), "news-panel")


_AR1 = f""", ar AS (SELECT series_id, regr_slope(diff, diff_lag_in) AS b,
        regr_intercept(diff, diff_lag_in) AS a, count(*) AS n FROM (
            SELECT *, lag(diff) OVER (PARTITION BY series_id ORDER BY obs_date) AS diff_lag_in FROM panel)
        WHERE split = 'train' AND diff_lag_in IS NOT NULL GROUP BY 1)
"""


@query("m5_ar1_fit", PANEL_SQL + _AR1 + f"""
    SELECT series_id, n, {v.r('a', 4)} AS intercept, {v.r('b')} AS slope FROM ar""")
def m5_ar1(spark, d):
    mean, slope = F.col("coef")[0], F.col("coef")[1]
    return fc.fit_arma(price_panel(spark, d), 1, 0).select(
        "series_id", "n", F.round(mean * (1 - slope), 4).alias("intercept"), F.round(slope, 6).alias("slope"))


@query("m5_arx_fit")
def m5(spark, d):
    scaled = fc.standardise(_news_panel(spark, d), _EXOG)
    return v.rounded(fc.coefficient_table(fc.fit_arma(scaled, 2, 0, _EXOG), fc.term_names(2, 0, _EXOG)), digits=4)


@query("m6_arma_fit")
def m6(spark, d):
    return v.rounded(fc.coefficient_table(fc.fit_arma(price_panel(spark, d), 1, 1), fc.term_names(1, 1)), digits=4)


@query("m7_order_by_validation")
def m7(spark, d):
    scaled = fc.standardise(_news_panel(spark, d), _EXOG)
    return v.rounded(fc.order_by_validation(scaled, exog=_EXOG), digits=4)


@query("m8_order_by_aic")
def m8(spark, d):
    return fc.order_by_aic(price_panel(spark, d))


_AIC_WHITE = "ln(2 * pi() * rss / n) * n + n"


@query("m8_aic_ar", PANEL_SQL + f"""
    , lg AS (SELECT *, lag(diff) OVER (PARTITION BY series_id ORDER BY obs_date) AS x FROM panel),
    s AS (SELECT series_id, count(*) AS n, regr_syy(diff, x) AS syy, regr_sxx(diff, x) AS sxx,
                 regr_sxy(diff, x) AS sxy FROM lg WHERE split = 'train' AND x IS NOT NULL GROUP BY 1),
    o AS (SELECT series_id, n, 0 AS p, syy AS rss FROM s
          UNION ALL SELECT series_id, n, 1, syy - sxy * sxy / sxx FROM s)
    SELECT series_id, p, n, {v.r(f'{_AIC_WHITE} + 2 * (p + 2)', 2)} AS aic,
           {v.r(f'{_AIC_WHITE} + ln(n) * (p + 2)', 2)} AS bic FROM o""")
def m8_ar(spark, d):
    return fc.order_by_aic(price_panel(spark, d), ((0, 0), (1, 0))).select("series_id", "p", "n", "aic", "bic")


@query("m9_horizon_forecast")
def m9(spark, d):
    scaled = fc.standardise(_news_panel(spark, d), _EXOG)
    return v.rounded(fc.horizon_forecast(scaled, [(1, 0), (1, 1)], _EXOG), digits=4)


@query("m9_horizon_ar1", PANEL_SQL + _AR1 + f""", steps AS (SELECT series_id, obs_date, diff,
        row_number() OVER (PARTITION BY series_id ORDER BY obs_date) AS h FROM panel WHERE split = 'val'),
    eve AS (SELECT series_id, arg_max(diff, obs_date) AS last FROM panel WHERE split = 'train' GROUP BY 1)
    SELECT series_id, 1 AS p, 0 AS q, obs_date, {v.r('diff', 4)} AS y,
           {v.r('a * (1 - pow(b, h)) / (1 - b) + pow(b, h) * last', 4)} AS y_hat
    FROM steps JOIN eve USING (series_id) JOIN ar USING (series_id)""")
def m9_ar1(spark, d):
    out = fc.horizon_forecast(price_panel(spark, d), [(1, 0)])
    return v.rounded(out.select("series_id", "p", "q", "obs_date", "y", "y_hat"), digits=4)


@query("m10_rolling_forecast", PANEL_SQL + _AR1 + f"""
    SELECT series_id, obs_date, split, 'arma(1,0,0)' AS model, {v.r('diff', 4)} AS y,
           {v.r('a + b * x', 4)} AS y_hat
    FROM (SELECT *, lag(diff) OVER (PARTITION BY series_id ORDER BY obs_date) AS x FROM panel)
    JOIN ar USING (series_id) WHERE split = 'val'""")
def m10(spark, d):
    return v.rounded(fc.rolling_forecast(price_panel(spark, d), 1, 0), digits=4)


@query("m10_rolling_best_order")
def m10_best(spark, d):
    return v.rounded(fc.rolling_best_order(_news_panel(spark, d), _EXOG), digits=4)


@query("m11_expanding_ar1", PANEL_SQL + f"""
    , lg AS (SELECT *, lag(diff) OVER (PARTITION BY series_id ORDER BY obs_date) AS x FROM panel),
    fits AS (SELECT series_id, obs_date, split, diff, x, regr_slope(diff, x) OVER w AS b,
             regr_intercept(diff, x) OVER w AS a FROM lg WHERE x IS NOT NULL
             WINDOW w AS (PARTITION BY series_id ORDER BY obs_date
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT series_id, obs_date, split, 'expanding' AS model, {v.r('diff', 3)} AS y,
           {v.r('a + b * x', 3)} AS y_hat FROM fits WHERE split = 'test'""")
def m11(spark, d):
    return v.rounded(fc.expanding_refit(price_panel(spark, d)), digits=3)


@query("m11_expanding_arma_news")
def m11_exog(spark, d):
    scaled = fc.standardise(_news_panel(spark, d), _EXOG, ("train", "val"))
    return v.rounded(fc.expanding_refit(scaled, 1, 1, _EXOG), digits=3)


#: (application, table folder) -> the written panel, which all tree queries of a session share.
_TREE_PANELS: dict[tuple[str, str], DataFrame] = {}


def _tree_panel(spark, d):
    """One series with scores and text vectors, written once for the many fits, and its predictors."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _TREE_PANELS:
        _TREE_PANELS[key] = write_through(pn.build_panel(v.rate(spark, d), _daily_features(spark, d)), "tree-panel")
    data = _TREE_PANELS[key]
    return data, pn.model_columns(data.columns)


@query("m12_boosted_trees")
def m12(spark, d):
    data, names = _tree_panel(spark, d)
    model = tr.fit_trees(pn.only_splits(data, "train"), names, **tr.FINAL)
    return v.rounded(tr.predict(model, data, names, "trees", ["val"]), digits=4)


@query("m13_grid_search")
def m13(spark, d):
    grid = tr.grid_search(*_tree_panel(spark, d), tr.SMALL_GRID)
    return v.rounded(spark.createDataFrame(
        [tuple(s.values()) for s in grid.scores],
        "n_estimators int, learning_rate double, max_depth int, rmse double"), digits=4)


@query("m14_feature_ablation")
def m14(spark, d):
    out, _, _ = tr.ablation(*_tree_panel(spark, d), tr.WIDE_GRID)
    return ev.metric_table(out)


@query("m15_refit_for_test")
def m15(spark, d):
    data, names = _tree_panel(spark, d)
    model = tr.fit_trees(pn.only_splits(data, "train", "val"), names, **tr.FINAL)
    return v.rounded(tr.predict(model, data, names, "trees", ["test"]), digits=4)


@query("m16_importances")
def m16(spark, d):
    data, names = _tree_panel(spark, d)
    model = tr.fit_trees(pn.only_splits(data, "train"), names, **tr.FINAL)
    return v.rounded(tr.importances(model, data, names))


@query("m17_importance_by_family", SCORED_PANEL_SQL + ", " + long_sql(
    [*_MEANS, "diff_lag1"], ", diff AS y", "WHERE split = 'train'") + "," + _RANKS + f"""
    SELECT CASE WHEN feature LIKE '%diff%' THEN 'price' ELSE 'lexicon' END AS family,
           {v.r('sum(round(abs(rho), 6))', 4)} AS importance FROM rho GROUP BY 1""")
def m17(spark, d):
    whole = pn.only_splits(scored_panel(spark, d), "train")
    rho = ex.spearman_with_target(whole, [*_MEANS, pn.AR_LAG])
    return tr.importance_by_family(rho.select(
        "feature", F.round("abs_rho", 6).alias("importance")))


@query("m17_family_of_trees")
def m17_trees(spark, d):
    """Families of the 20 predictors that carry the largest importances of the final trees."""
    data, names = _tree_panel(spark, d)
    model = tr.fit_trees(pn.only_splits(data, "train", "val"), names, **tr.FINAL)
    return tr.importance_by_family(tr.importances(model, data, names, 20))


@query("m18_coefficients", PANEL_SQL + _AR1 + f"""
    SELECT series_id, 'const' AS term, {v.r('a / (1 - b)', 4)} AS coef FROM ar
    UNION ALL SELECT series_id, 'ar1', {v.r('b', 4)} FROM ar""")
def m18(spark, d):
    return v.rounded(fc.coefficient_table(fc.fit_arma(price_panel(spark, d), 1, 0), fc.term_names(1, 0)), digits=4)


# -- evaluation ----------------------------------------------------------------

_GROUP = "FROM predictions GROUP BY 1, 2"
_SIGN = "CASE WHEN sign(y) = sign(y_hat) THEN 1.0 ELSE 0.0 END"
_RMSE = "sqrt(avg((y - y_hat) * (y - y_hat)))"


def _f1_sql(sign: str, guess: str) -> tuple[str, str]:
    tp = f"count(CASE WHEN y {sign} 0 AND {guess} THEN 1 END)"
    all_ = f"(count(CASE WHEN y {sign} 0 THEN 1 END) + count(CASE WHEN y <> 0 AND {guess} THEN 1 END))"
    return f"coalesce(2.0 * {tp} / nullif({all_}, 0), 0)", all_


_F1_UP, _N_UP = _f1_sql(">", "y_hat > 0")
_F1_DOWN, _N_DOWN = _f1_sql("<", "NOT (y_hat > 0)")
_MACRO = (f"coalesce(({_F1_UP} * (CASE WHEN {_N_UP} > 0 THEN 1 ELSE 0 END) + {_F1_DOWN} "
          f"* (CASE WHEN {_N_DOWN} > 0 THEN 1 ELSE 0 END)) / nullif((CASE WHEN {_N_UP} > 0 THEN 1 ELSE 0 "
          f"END) + (CASE WHEN {_N_DOWN} > 0 THEN 1 ELSE 0 END), 0), 0)")
_NOT_ZERO = "CASE WHEN max(abs(y_hat)) > 0 THEN {m} END"
_SKILL = f"(1 - {_RMSE} / sqrt(avg(y * y))) * 100"
_DA = f"avg(CASE WHEN y <> 0 THEN {_SIGN} END) * 100"


def _metric(name: str, sql: str, build, out: str):
    text = PANEL_SQL + BASELINES_CTE + f"SELECT model, split, {v.r(sql)} AS {out} {_GROUP}"

    @query(name, text)
    def run(spark, d):
        made = predictions(spark, d).groupBy("model", "split").agg(
            build(F.col("y"), F.col("y_hat")).alias(out))
        return v.rounded(made)


_metric("k1_rmse", _RMSE, ev.rmse, "rmse")
_metric("k2_mae", "avg(abs(y - y_hat))", ev.mae, "mae")
_metric("k3_direction_all_days", f"avg({_SIGN}) * 100", ev.direction_accuracy_all, "da")
_metric("k4_direction_moved_days", _DA, ev.direction_accuracy, "da")
_metric("k5_f1_up", _F1_UP, ev.f1_up, "f1_up")
_metric("k6_f1_macro", _MACRO, ev.f1_macro, "f1_macro")
_metric("k7_skill", _SKILL, ev.skill, "skill")
_metric("k8_null_direction", _NOT_ZERO.format(m=_DA),
        lambda y, p: ev.unless_all_zero(ev.direction_accuracy(y, p), p), "da")

METRICS_SELECT = f"""count(*) AS n, count(*) FILTER (y IS NULL OR y_hat IS NULL) AS n_missing, {v.r(_RMSE, 2)} AS rmse,
    {v.r('avg(abs(y - y_hat))', 2)} AS mae, {v.r(_NOT_ZERO.format(m=_DA), 1)} AS da,
    {v.r(_NOT_ZERO.format(m=_F1_UP), 3)} AS f1_up, {v.r(_NOT_ZERO.format(m=_MACRO), 3)} AS f1_macro,
    {v.r(_SKILL, 2)} AS skill"""


@query("k9_metric_table", PANEL_SQL + BASELINES_CTE + f"SELECT model, split, {METRICS_SELECT} {_GROUP}")
def k9(spark, d):
    return ev.metric_table(predictions(spark, d))


@query("k10_dispersion", PANEL_SQL + BASELINES_CTE + f"""
    SELECT model, split, {v.r('stddev_pop(y)')} AS std_y, {v.r('stddev_pop(y_hat)')} AS std_y_hat
    {_GROUP}""")
def k10(spark, d):
    return v.rounded(ev.dispersion(predictions(spark, d)))


# -- composite -----------------------------------------------------------------

@query("news_to_forecast_error", SCORED_PANEL_SQL + f"""
    SELECT split, count(*) AS n, {v.r('avg(news_count)')} AS articles_per_day,
        {v.r('avg(text_lm_polarity_mean)')} AS mean_polarity,
        {v.r('avg(text_vader_compound_mean)')} AS mean_compound,
        {v.r('sqrt(avg(diff * diff))', 4)} AS rmse_zero
    FROM panel GROUP BY 1""")
def flagship(spark, d):
    """Aligned daily sentiment beside the price change, split, and the random-walk error."""
    whole = scored_panel(spark, d)
    out = whole.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.avg("news_count").alias("articles_per_day"),
        F.avg("text_lm_polarity_mean").alias("mean_polarity"),
        F.avg("text_vader_compound_mean").alias("mean_compound"),
        F.round(ev.rmse(F.col("diff"), F.lit(0.0)), 4).alias("rmse_zero"))
    return v.rounded(out, "articles_per_day", "mean_polarity", "mean_compound")


def _daily_features(spark, d):
    from tickerpress.plans import features as pf
    rates = v.rate(spark, d)
    articles = pf.prepare_articles(v.news_dirty(spark, d), rates)
    return pf.extract_features(articles, rates, v.LEXICON, v.VALENCE, v.RULES, v.STOP_WORDS)


@query("daily_features")
def daily_features(spark, d):
    """Cleaning, alignment, scores and text vectors down to one row per trading day."""
    return v.rounded(_daily_features(spark, d))


@query("experiment_metrics")
def experiment_metrics(spark, d):
    """Every model of the comparison on a panel of scored news and text vectors, one metric row each."""
    from tickerpress.plans.experiment import run_experiment
    return run_experiment(_tree_panel(spark, d)[0], _EXOG).metrics


def _evaluation(spark, d, trees):
    from tickerpress.plans.evaluation import run_evaluation
    return run_evaluation(_news_panel(spark, d), _EXOG, trees, folder=scratch_path(spark, "evaluation"))


@query("evaluate_test")
def evaluate_test(spark, d):
    """Metrics of the baselines, the expanding regression and the final trees on the test split."""
    return _evaluation(spark, d, tr.FINAL).metrics


@query("evaluate_test_baselines", SCORED_PANEL_SQL + BASELINES_CTE + f""",
    tested AS (SELECT series_id, model, split, y, CASE WHEN model = 'majority' THEN CAST(peek AS DOUBLE) ELSE y_hat END
               AS y_hat FROM predictions JOIN (SELECT series_id, max(peek) AS peek FROM calls GROUP BY 1) USING (series_id)
               WHERE split = 'test')
    SELECT model, split, {METRICS_SELECT} FROM tested GROUP BY 1, 2""")
def evaluate_test_baselines(spark, d):
    quick = {"n_estimators": 2, "learning_rate": 0.1, "max_depth": 2}
    return _evaluation(spark, d, quick).metrics.where("model IN ('zero', 'majority', 'persistence')")
