import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickerpress.functions import lexicons as lx
from tickerpress.functions import text as tx
from tickerpress.operators import daily as da
from tickerpress.operators import scoring as sc


def lm(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    return sc.score_lexicon(df, "t").first()


def test_list_sizes():
    assert (len(lx.POSITIVE), len(lx.NEGATIVE), len(lx.UNCERTAINTY)) == (65, 153, 39)
    assert set(lx.NEGATIVE) & set(lx.UNCERTAINTY) == {"doubt", "uncertain", "uncertainty"}


def test_clean_text_drops_non_ascii_letters(spark):
    df = spark.createDataFrame([("Café 3.5% Up\nNow", ), (None,)], "t string")
    got = [r[0] for r in df.select(tx.clean_ascii(F.col("t"))).collect()]
    assert got == ["caf       up\nnow", ""]
    tokens = df.select(tx.alpha_tokens(F.col("t"))).first()[0]
    assert tokens == ["caf", "up", "now"]


def test_lexicon_scores(spark):
    r = lm(spark, "Growth and GAINS amid doubt: risk-off, maybe")
    assert (r["lm_pos"], r["lm_neg"], r["lm_unc"], r["lm_hit"]) == (2, 2, 2, 1)
    assert r["lm_polarity"] == 0.0 and r["lm_unc_ratio"] == 2 / 8
    empty = lm(spark, None)
    assert (empty["lm_pos"], empty["lm_polarity"], empty["lm_unc_ratio"], empty["lm_hit"]) == (0, 0, 0, 0)


def test_join_form_agrees_with_inline_form(spark):
    df = spark.createDataFrame([(1, "growth risk risk may"), (2, "doubt doubt"), (3, "none")], "id long, t string")
    words = [(w, c) for c in ("positive", "negative", "uncertainty") for w in getattr(sc.Lexicon(), c)]
    table = spark.createDataFrame(words, "term string, category string")
    joined = {(r["id"], r["category"]): r["hits"]
              for r in sc.lexicon_hits_by_join(df, "id", "t", table).collect()}
    assert joined == {(1, "positive"): 1, (1, "negative"): 2, (1, "uncertainty"): 1,
                      (2, "negative"): 2, (2, "uncertainty"): 2}
    assert sc.lexicon_from_table(table).words == sc.Lexicon().words


LEX = {"good": 1.9, "bad": -2.5, "great": 3.1}


def compound(total):
    return round(total / math.sqrt(total * total + 15), 4)


@pytest.mark.parametrize("text,total", [
    ("The food is good", 1.9),
    ("The food is very good", 1.9 + 0.293),
    ("The food is very, good", 1.9 + 0.293),
    ("not good", 1.9 * -0.74),
    ("isn't that good", 1.9 * -0.74),
    ("very much so good", (1.9 + 0.293) + 0.293 * 0.9),
    ("slightly bad", -2.5 + 0.293),
    ("very bad", -2.5 - 0.293),
    ("the GOOD food", 1.9 + 0.733),
    ("GOOD FOOD", 1.9),
    ("good but bad", 1.9 * 0.5 - 2.5 * 1.5),
    ("good !!", 1.9 + 2 * 0.292),
    ("good ??", 1.9 + 2 * 0.18),
    ("bad ????", -2.5 - 0.96),
    ("never so good", (1.9 + 0.293) * 1.5),
    ("least good", 1.9 * -0.74),
    ("at least good", 1.9),
    ("good, great.", 5.0),
    ("", 0.0),
])
def test_compound(spark, text, total):
    df = spark.createDataFrame([(text,)], "t string")
    got = sc.score_valence(df, "t", LEX).first()
    assert got["vader_compound"] == pytest.approx(compound(total), abs=1e-4)


def test_valence_shares(spark):
    df = spark.createDataFrame([("good food bad taste here",), ("",)], "t string")
    good, empty = sc.score_valence(df, "t", LEX).collect()
    total = 2.9 + 3.5 + 3
    assert good["vader_pos"] == round(2.9 / total, 3)
    assert good["vader_neg"] == round(3.5 / total, 3)
    assert good["vader_neu"] == round(3 / total, 3)
    assert (empty["vader_pos"], empty["vader_neg"], empty["vader_neu"]) == (0, 0, 0)


def test_scores_do_not_shuffle(spark):
    df = spark.createDataFrame([(1, "good", "bad")], "id long, title string, body string")
    scored = sc.score_texts(df, {"title": "title_", "body": "text_"}, valence=LEX)
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
    assert scored.columns[3:] == sc.score_columns(["title_", "text_"])


def test_daily_singletons_have_no_spread(spark):
    df = spark.sql("""SELECT * FROM VALUES (DATE '2024-01-01', 1.0D), (DATE '2024-01-02', 1.0D),
                      (DATE '2024-01-02', 3.0D), (NULL, 9.0D) AS v(d, x)""")
    rows = {r["obs_date"].day: r for r in da.aggregate_daily(df, "d", ["x"]).collect()}
    assert set(rows) == {1, 2}
    assert rows[1]["x_std"] == 0.0 and rows[1]["news_count"] == 1
    assert rows[2]["x_std"] == pytest.approx(math.sqrt(2)) and rows[2]["x_mean"] == 2.0


def test_lexicon_words_are_counted_in_arrow(spark, capsys):
    texts = [None, "", "Up UP down--up", "İUP K9 über-down", "12 \n ", "up " * 1000] * 60
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    out = sc.lexicon_counts(df, "text", "p_", sc.Lexicon(["up", "iup"], ["down"], [], {"both": ["up", "down"]}))
    out.explain()
    assert "regexp_extract_all" not in capsys.readouterr().out
    words = {r.id: r.w for r in df.select("id", tx.alpha_tokens(F.col("text")).alias("w")).collect()}
    for r in out.collect():
        n = [len(words[r.id])] + [sum(w in s for w in words[r.id]) for s in (["up", "iup"], ["down"], [], ["up", "down"])]
        assert [r.p_n_tokens, r.p_lm_pos, r.p_lm_neg, r.p_lm_unc, r.p_lm_both] == n


def test_words_that_come_again_are_looked_up_once(monkeypatch):
    asked = []
    monkeypatch.setattr(sc, "_shouted", lambda w: asked.append(w) or False)
    scorer = sc._Valence({"good": 1.0}, sc.ValenceRules())
    assert scorer.all_sums(pa.array([["AB", "cd"] * 500, None, [], ["cd"]])) == [(n, 0.0, 0.0, 0.0, 0) for n in (1000, 0, 0, 1)]
    assert sorted(asked) == ["AB", "cd"]
