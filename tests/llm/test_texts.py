import time
import zlib

import helpers as h
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tickerpress.llm import html_extraction as html
from tickerpress.llm import sentencepiece_codec as sp
from tickerpress.llm import token_files as tf

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD_TEXTS = ["Hello  world\n x", " a", "", "  ", "\t tab", "é́ ſ ﬁ İ ΑΣ", "<s> hi </s>", "a\xa0b c\x1cd\x85e", "日本\U0001F600",
             "a" + " " * 5 + "b" + " " * 15 + "é" + " " * 31, " ॐ x", "\x00a", "don't 's 'S it's12.5", "a<|endoftext|>b",
             "<|startoftext|> x", "x" * 3000, "\n\n", "é\ńx"]

PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/x">menu one</a></li><li><a>menu two</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site, many of them indeed.</div>
<div id="content"><article><header><h1>Head &amp; tail</h1><p>By me</p></header>
<p>First <b>para</b>graph is\n long enough to count as&nbsp;content here, and it goes on for a while.</p><form><label>Mail</label></form>
<p>Short.<div class="ad-slot">buy now this very nice product today please</div><ul><li>one<li>two</ul>
<p>Second paragraph has many words in it too, so that it counts.<br>A line &#8212; caf&eacute;.</p>
<section id="comments"><p>Reader one: I do not agree with this article at all, really.</p></section></article>
<aside>Side words</aside></div><footer>&copy; x</footer></body></html>"""


def test_main_text_of_a_page():
    assert html.main_text(PAGE) == (
        "Head & tail First paragraph is long enough to count as content here, and it goes on for a while. Short. one two "
        "Second paragraph has many words in it too, so that it counts. A line — café.")


def test_main_text_without_an_article_element():
    words = "some words of the text that go on and on for a while "
    page = ("<body><div><a href=1>one</a> <a href=2>two</a></div><div class=x><p>" + words * 3 + "</p><p>tiny</p><p>"
            + words * 2 + "</p></div><div><a href=3>three</a></div></body>")
    assert html.main_text(page) == (words * 3).strip() + " tiny " + (words * 2).strip()


def test_main_text_split_over_sibling_containers():
    first, last = "a sentence of the first part, " * 40, "a sentence of the end, " * 4
    long, short = f"<p>{first}</p>" * 3, f"<p>{last}</p>"
    want = " ".join([first.strip()] * 3 + [last.strip()])
    nav = "<nav><a href=1>one</a></nav>"
    for page in (f"<body>{nav}<div id=c><div>{long}</div><div>{short}</div></div></body>",
                 f"<body>{nav}<main><article>{long}</article><article>{short}</article></main></body>",
                 f"<body>{nav}<article>{long}</article><article>{short}</article></body>",
                 f"<body><main>{nav}<article>{long}</article><aside>x</aside><article>{short}</article></main></body>",
                 f"<body>{nav}<main><article>{long}</article>{short}</main></body>"):
        assert html.main_text(page) == want


def test_main_text_directly_in_body():
    words = "x" * 300
    assert html.main_text(f"<body><h1>Title</h1><p>{words}</p><p>{words}</p>") == f"Title {words} {words}"
    page = (f"<body><ul><li><a href=1>one</a><li><a href=2>two</a></ul><p>Lead.</p><p>{words}</p><p>{words}</p>"
            "<p>See <a href=3>this long title of a book</a> of it.</p><p>End.</p><p><a href=4>a</a> | <a href=5>b</a></p>")
    assert html.main_text(page) == f"Lead. {words} {words} See this long title of a book of it. End."


def test_head_without_an_end_tag():
    for start in ("<body>", "<body><div>", "<p>", ""):
        assert html.main_text(f"<html><head><title>T</title><meta name=a><script>x</script>{start}some text") == "some text"


def test_class_words_inside_an_article():
    words = "some words of the text that go on and on for a while " * 5
    text = words.strip()
    assert html.main_text(f"<body><article><p>{words}</p><section id='discussion'><p>{words}</p></section>") == f"{text} {text}"
    assert html.main_text(f"<body><article><div class='widget'><h1>Title</h1><p>{words}</p></div></article>") == f"Title {text}"
    form = "<form><label>Mail</label><input></form>"
    assert html.main_text(f"<body><article><div class='widget'><p>{words}</p>{form}<p>{words}</p></div></article>") == f"{text} {text}"
    for block in ("<div class=related><p><a href=1>one</a> <a href=2>two</a></p></div>", "<div class=share><b>Share</b></div>",
                  f"<div class=widget><p>{words}</p><input></div>"):
        assert html.main_text(f"<body><article><p>{words}</p>{block}<p>{words}</p></article>") == f"{text} {text}"


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b</b></div>", "a b"), ("<nav>x</nav>", ""), ("<", "<"),
    ("<article><h1>T</h1><p>x", "T x"), ("<p>1 &lt; 2 &amp;amp; 3", "1 < 2 &amp; 3"), ("<!-- a --><p>b", "b"),
    ("<body><p>a</p><script>b", "a"), ("<p hidden>a</p><p>b</p>", "b")])
def test_main_text_of_fragments(page, text):
    assert html.main_text(page) == text


LONG = "Words of a long paragraph that goes on and on. " * 6


@pytest.mark.parametrize("page, text", [
    ("<p>a</p><![foo bar]]><p>b", "a b"), ("<p>a</p><![if !IE]><p>b</p><![endif]>", "a b"), ("<p>a</p><![", "a <!["),
    (f"<body><form id=page><h1>T</h1><p>{LONG}</p><input name=q><p>{LONG}</p></form></body>", f"T {LONG}{LONG}"),
    (f"<body><div class='no-sidebar'><p>{LONG}</p></div></body>", LONG),
    (f"<body><div class='has-sidebar page'><p>{LONG}</p><div class=sidebar>About us</div></div></body>", LONG),
    (f"<body><div class='post comments-open'><p>{LONG}</p><div class=comments><p>Nice!</p></div></div></body>", LONG),
    (f"<body><form action=login><p>{LONG}</p></form><article><p>Short.</p></article></body>", "Short."),
    (f"<body><div class=ad><p>{LONG}</p></div><article><h1>T</h1></article></body>", "T"),
    (f"<article><header><h1>T</h1><p>{LONG}</p><p>By X</p></header><p>{LONG}</p></article>", f"T {LONG}{LONG}")])
def test_the_text_of_a_block_decides_whether_it_is_set_apart(page, text):
    assert html.main_text(page) == text.strip()


@pytest.mark.parametrize("tag", ["span", "div", "p", "form", "section class=sidebar", "b class=ad", "article"])
def test_deep_pages_take_time_in_proportion(tag):
    def took(n):
        start = time.process_time()
        html.main_text(f"<{tag}>x " * n)
        return time.process_time() - start

    assert took(64_000) < 12 * took(8_000) + 0.5


def test_threshold_and_smoothing():
    assert 2 < html.threshold(np.array([1.0, 2.0, 30.0, 31.0, 1.5])) < 30
    lines, _ = html.page_lines("<p>" + "x" * 100 + "</p><p>y</p><p>" + "z" * 100 + "</p>")
    smooth = html.smoothed_ratios(lines)
    assert len(smooth) == 3 and smooth[1] > 1  # a short line between long ones is lifted


def test_pages_as_a_table(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<p>" + "word " * 50_000 + "</p>")]
    df = h.clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    out = html.extract(df)
    assert out.columns == [c for c in df.columns if c != "html"] + ["text", "n_chars"]
    got = sorted((r["page_id"] or 0, r["url"] or "", r["n_chars"], r["n_chars"] == len(r["text"])) for r in out.collect())
    n = len(html.main_text(PAGE))
    assert got == [(0, "v", 0, True), (1, "u", n, True), (1, "u", n, True), (2, "", 0, True), (3, "w", 249_999, True)]
    assert html.extract(df.limit(0)).count() == 0


# ---- SentencePiece

def test_ids_equal_those_of_the_library():
    library, codec = sentencepiece.SentencePieceProcessor(model_file=PIECES), sp.Codec(PIECES)
    texts = ODD_TEXTS + [h.prose(300, i) for i in range(5)]
    raw, parity = codec.encode(texts)
    assert [np.frombuffer(r, "<u4").tolist() for r in raw] == library.encode(texts)
    assert [codec.decode(np.frombuffer(r, "<u4")) for r in raw] == library.decode(library.encode(texts))
    assert parity == [s not in codec.differ for s in texts] or all(parity)


def test_the_rebuilt_tokenizer_encodes_and_decodes_whole_texts():
    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), sp.rebuild(sp.read_model(PIECES))
    for text in [h.prose(100, 1), "Grüße, 日本 \U0001F600!", "tab\tand\nline"]:
        ids = own.encode(text, add_special_tokens=False).ids
        assert ids == library.encode(text) and own.decode(ids) == text


def test_memory_of_segments_may_be_small(monkeypatch):
    monkeypatch.setattr(sp, "REMEMBERED", 3)
    codec, library = sp.Codec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for i in range(6):
        texts = [h.prose(20, j, 30) for j in range(i, i + 3)]
        assert [np.frombuffer(r, "<u4").tolist() for r in codec.encode(texts)[0]] == library.encode(texts)


def test_unigram_models_are_rebuilt_too():
    pieces = [("<unk>", 0.0, sp.UNKNOWN), ("▁", -2.0, 1), ("▁ab", -1.0, 1), ("a", -3.0, 1), ("b", -3.5, 1), ("▁a", -2.5, 1)]
    own = sp.rebuild(sp.Model(pieces, sp.UNIGRAM, False, b"", True, True))
    assert own.encode("  ab  ba ", add_special_tokens=False).tokens == ["▁ab", "▁", "b", "a"]


def test_encoded_awkward_rows(spark):
    df = h.awkward(spark)
    rows = sp.encode_decode(h.clashing(df), PIECES).collect()
    assert len(rows) == df.count()
    assert all(r["round_trip"] and r["parity"] and r["n_tokens"] == len(r["ids"]) for r in rows)
    assert sorted(r["decoded"] for r in rows) == sorted(r["text"] or "" for r in df.collect())
    assert sp.encode_decode(df.limit(0), PIECES).count() == 0
    marker = sp.encode_decode(h.documents(spark, ["▁x y"]), PIECES).first()
    assert marker["decoded"] == " x y" and not marker["round_trip"]


# ---- token files

def test_word_ids_equal_those_of_whole_texts():
    whole, own = Tokenizer.from_file(WORDS), tf.WordEncoder(WORDS)
    texts = ODD_TEXTS + [h.prose(200, i) + "\n" + h.prose(20, i).title() for i in range(5)]
    assert [np.frombuffer(r, "<u4").tolist() for r in own.encode(texts)] == [
        whole.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 100, 1000])
def test_segments_return_what_they_hold(planes, n):
    r = np.random.default_rng(n)
    counts = [n // 3, 0, n - n // 3]
    ids = r.integers(0, 2**32, n, dtype=np.uint32)
    doc_ids, got_counts, got = tf.unpack(tf.pack([5, None, -7], counts, ids, planes, block=64))
    assert doc_ids == [5, None, -7] and got_counts.tolist() == counts and (got == ids).all()


def test_other_bytes_are_refused():
    with pytest.raises(ValueError):
        tf.unpack(b"nothing")


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_token_files_of_awkward_rows(spark, tmp_path, monkeypatch, planes):
    monkeypatch.setattr(tf, "SEGMENT", 500)
    df = h.awkward(spark)
    segments = tf.write_segments(h.clashing(df), f"file://{tmp_path}/{planes}", WORDS, planes=planes)
    got = tf.read_documents(segments).orderBy("start").collect()
    whole = Tokenizer.from_file(WORDS)
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is not None, x or 0))

    def crc(text):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        return len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())

    assert sorted(((r["doc_id"] or 0), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(
        (r["doc_id"] or 0, *crc(r["text"])) for r in df.collect())
    empty = tf.write_segments(df.limit(0), f"file://{tmp_path}/empty", WORDS)
    assert tf.read_documents(empty).count() == 0
