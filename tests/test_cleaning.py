import datetime
import json

import pytest
from pyspark.sql import functions as F

from tickerpress.functions import text as tx
from tickerpress.operators import cleaning as cl
from tickerpress.operators import extraction as ex
from tickerpress.plans import harvest

WORDS = " ".join(f"w{i}" for i in range(30))


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id long, t string")


def one(spark, value, build):
    return texts(spark, value).select(build(F.col("t")).alias("x")).first()["x"]


def test_word_count_floor_is_inclusive_and_empty_is_zero(spark):
    df = texts(spark, WORDS, " ".join(WORDS.split()[:29]), "", "  \n", None)
    assert [r["id"] for r in cl.min_words(df, "t").collect()] == [0]
    assert one(spark, "", tx.word_count) == 0
    assert one(spark, " a b c\x1cd ", tx.word_count) == 4


def test_strip_takes_every_kind_of_space(spark):
    assert one(spark, " \t a b \n　", tx.strip_space) == "a b"


def test_prefix_goes_only_at_the_start(spark):
    assert one(spark, "In this article\n\n Hello In this article", tx.strip_prefix) \
        == "Hello In this article"
    assert one(spark, " In this article x", tx.strip_prefix) == "In this article x"


def test_links_and_spaces(spark):
    assert one(spark, " a  https://x.y/z?q b\n\nwww.c.d  e ", tx.remove_links) == "a b e"


def test_exact_copies_are_told_apart_before_the_prefix_goes(spark):
    df = spark.createDataFrame([(3, WORDS), (1, WORDS), (2, "In this article " + WORDS), (4, None),
                                (5, ""), (6, cl.NO_BODY_TEXT), (7, cl.FETCH_ERROR_TEXT)],
                               "ingest_id long, full_text string")
    kept = cl.clean_articles(df, "full_text", "ingest_id").collect()
    assert sorted(r["ingest_id"] for r in kept) == [1, 2]
    assert {r["full_text"] for r in kept} == {WORDS}
    report = [r["n_rows"] for r in cl.cleaning_report(df, "full_text").orderBy("step_no").collect()]
    assert report == [7, 5, 4, 2]


def test_keep_first_with_several_keys_does_not_mix_them_up(spark):
    df = spark.createDataFrame([(1, "a", "bc"), (2, "ab", "c"), (3, "a", "bc")], "id long, x string, y string")
    assert sorted(r["id"] for r in cl.keep_first(df, ["x", "y"], "id").collect()) == [1, 2]


def test_a_text_that_makes_up_half_the_rows(spark):
    df = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 2 == 0, "same")
                                    .otherwise(F.col("id").cast("string")).alias("t"))
    kept = cl.exact_dedupe(df, "t", "id")
    assert kept.count() == 10_001
    assert kept.where("t = 'same'").first()["id"] == 0


def test_types_are_matched_as_substrings(spark):
    df = texts(spark, "Video Clip", "LIVEBLOG", "article", None, "olive oil")
    assert sorted(r["id"] for r in cl.exclude_types(df, "t").collect()) == [2, 3]


def test_date_floor_on_strings_drops_empty(spark):
    df = texts(spark, "2021-09-01T00:00:00+0000", "2021-08-31", "")
    assert [r["id"] for r in cl.date_floor(df, "t").collect()] == [0]


def test_merge_hits_prefers_earlier_search(spark):
    a = spark.createDataFrame([(5, "u1", "a5"), (6, "u2", "a6")], "position int, url string, title string")
    b = spark.createDataFrame([(0, "u1", "b0"), (1, "u3", "b1")], "position int, url string, title string")
    got = {r["url"]: (r["title"], r["source"]) for r in cl.merge_hits([a, b], source="wire").collect()}
    assert got == {"u1": ("a5", "wire"), "u2": ("a6", "wire"), "u3": ("b1", "wire")}


HTML = ('<html><script>var t="</p>"</script><div class="side"><p>no</p></div>'
        '<div class="x ArticleBody-articleBody y"><p> One <b>bold</b> &amp; &lt;two&gt;</p>'
        '<div><div><P class="q">Nested</P></div></div><style>p{}</style><p>open<p>next</div>'
        '<p>after</p></div></html>')


def test_body_of_nested_container(spark):
    df = spark.createDataFrame([(1, HTML), (2, "<div class='ArticleBody-articleBodyX'><p>x</p></div>"),
                                (3, "<div class=ArticleBody-articleBody><p></p><p>a</p></div>")],
                               "id long, html string")
    got = {r["id"]: r["full_text"] for r in ex.extract_body(df, "html").collect()}
    assert got == {1: "One bold & <two> Nested open next", 2: cl.NO_BODY_TEXT, 3: " a"}


def test_character_references_and_missing_pages(spark):
    html = ("<!-- <div> --><script>'<div class=\"ArticleBody-articleBody\"><p>no</p></div>'</script>"
            "<div class=ArticleBody-articleBody><script>'</div>'</script>"
            "<p>caf&eacute; &#8220;x&#x201d; &mdash; &rsquo;&hellip; &amp;amp;</p></div>")
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "id long, html string")
    got = {r["id"]: r["full_text"] for r in ex.extract_body(df, "html").collect()}
    assert got == {1: "café “x” — ’… &amp;", 2: None, 3: cl.NO_BODY_TEXT}


def test_report_with_near_step_reads_texts_that_were_written(spark):
    prose = " ".join(f"word{i}" for i in range(40))
    rows = [prose, prose, "In this article " + prose, prose + " more", None, "", "short", " ".join(f"item{i}" for i in range(40))]
    made = texts(spark, *rows).withColumn("t", F.concat("t", F.expr("substr(uuid(), 1, 0)")))
    report = cl.cleaning_report(made, "t", near_order="id", stop_words=[])
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "uuid" not in plan  # neither the input nor the steps before the last one are computed again
    assert [tuple(r) for r in report.orderBy("step_no").collect()] == [
        (1, "start", 8), (2, "drop_missing", 6), (3, "exact_dedupe", 5), (4, "min_words", 4), (5, "near_duplicates", 2)]


def test_rows_without_a_key_are_not_kept(spark):
    assert sorted(r["id"] for r in cl.keep_first(texts(spark, "a", None, "a", None, "b"), ["t"], "id").collect()) == [0, 4]


def test_a_hand_off_that_stops_leaves_the_one_before(spark, tmp_path, monkeypatch):
    from tickerpress.sources import tables as tb
    folder, schemas = f"file://{tmp_path}/out", ("id int", "level double")

    def tables(n):
        return spark.createDataFrame([(n,)], "id int"), spark.createDataFrame([(float(n),)], "level double")

    def read():
        return tuple(t.first()[0] for t in tb.read_hand_off(spark, folder, *schemas))

    tb.hand_off(*tables(1), folder)
    assert read() == (1, 1.0)
    whole, calls = tb.write_table, []

    def stops(*args, **kwargs):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return whole(*args, **kwargs)

    monkeypatch.setattr(tb, "write_table", stops)
    with pytest.raises(RuntimeError):
        tb.hand_off(*tables(2), folder)
    monkeypatch.setattr(tb, "write_table", whole)
    assert read() == (1, 1.0)
    assert tb.hand_off(*tables(3), folder) and read() == (3, 3.0)


def test_only_rows_with_references_are_unescaped(spark):
    from tickerpress.operators import extraction as xt
    rows = [(1, "<div class='b'><p>a &amp;amp; b</p></div>"), (2, "<div class='b'><p>plain</p><p>two</p></div>"), (3, None), (4, "<p>x</p>")]
    got = xt.extract_body(spark.createDataFrame(rows, "id int, html string"), "html", css_class="b").orderBy("id").collect()
    assert [r["full_text"] for r in got][:3] == ["a &amp; b", "plain two", None]


def test_harvest_cuts_bodies_out_once(spark):
    prose = " ".join(f"w{i}" for i in range(40))
    pages = spark.createDataFrame([
        ("a", f"<!-- <article> --><article><p>{prose} &amp; <b>one</b></p><article><p>two</article>three</article><p>four"),
        ("b", "<div>no article</div>"), ("c", None), ("e", f"<article><p>{prose} &amp; one</p><p>two")], "url string, html string")
    hits = [(i, json.dumps({"results": [{"datePublished": "2022-01-03T10:00:00Z", "cn:type": "article", "cn:title": u, "url": u}]}))
            for i, u in enumerate("abcde")]
    rates = spark.createDataFrame([("ALL", datetime.date(2022, 1, d), 1.0) for d in (3, 4)],
                                  "series_id string, obs_date date, level double")
    out = harvest.harvest_articles([spark.createDataFrame(hits, "page_no long, page string")], pages, rates,
                                   tag="article", css_class=None)
    # What is returned reads the texts that were written: bodies are not cut out of pages again.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "html" not in plan
    assert {(r["url"], r["full_text"]) for r in out.collect()} == {("a", f"{prose} & one twothree"), ("e", f"{prose} & one two")}
