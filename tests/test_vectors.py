import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerpress.operators import near_duplicates as nd
from tickerpress.operators import svd as sv
from tickerpress.operators import vectors as vc


def corpus(seed=3, n=60, words=40, length=(0, 30)):
    rng = random.Random(seed)
    vocabulary = [f"term{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(*length)))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, t string")


def test_terms_keep_unicode_and_pair_after_stop_words(spark):
    df = frame(spark, [(1, "Économie de l'été: 5 of 10_x the Bank")])
    got = [r["term"] for r in vc.term_stream(df, "id", "t", ["of", "the", "de"]).collect()]
    assert got == ["économie", "été", "10_x", "bank", "économie été", "été 10_x", "10_x bank"]


def brute_tfidf(rows, max_features, min_df):
    docs = {}
    for i, text in rows:
        tokens = text.split()
        docs[i] = Counter(tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])])
    tf, df = Counter(), Counter()
    for counts in docs.values():
        tf.update(counts)
        df.update(counts.keys())
    kept = sorted((t for t in tf if df[t] >= min_df), key=lambda t: (-tf[t], t))[:max_features]
    terms = sorted(kept)
    idf = np.array([math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in terms])
    x = np.array([[docs[i][t] for t in terms] for i, _ in rows], dtype=float) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return terms, idf, x / np.where(norm > 0, norm, 1)


def test_tfidf_and_svd_against_numpy(spark):
    rows = corpus()
    df = frame(spark, rows)
    terms, idf, x = brute_tfidf(rows, 50, 5)
    model, svd = vc.fit_tfidf_svd(df, "t", 50, 6, stop_words=[])
    assert model.terms == terms and model.n_docs == len(rows)
    np.testing.assert_allclose(model.idf, idf)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    np.testing.assert_allclose(svd.singular_values, s[:6], rtol=1e-9)
    placed = svd.project(model.transform(df, "t")).select("id", "svd").orderBy("id").collect()
    got = np.array([r["svd"] for r in placed])
    assert got.shape == (len(rows), 6)
    np.testing.assert_allclose(np.abs(got), np.abs(x @ vt[:6].T), atol=1e-8)
    peak = svd.components[np.abs(svd.components).argmax(axis=0), range(6)]
    assert (peak > 0).all()


def sparse_rows(spark, x, parts):
    rows = [([int(j) for j in np.flatnonzero(r)], [float(r[j]) for j in np.flatnonzero(r)]) for r in x]
    return spark.createDataFrame(rows, "idx array<int>, val array<double>").repartition(parts)


@pytest.mark.parametrize("n,terms,rank,seed", [(400, 300, 12, 1), (900, 500, 25, 2), (30, 200, 20, 3), (5, 40, 12, 4)])
def test_range_finder_against_numpy(spark, monkeypatch, n, terms, rank, seed):
    """Flat spectra, several restarts, more terms than rows, and a rank above the rows."""
    monkeypatch.setattr(sv, "FAN", 2)
    monkeypatch.setattr(sv, "SLICE", 20 * terms)
    monkeypatch.setattr(sv, "PART", 1_000)
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, terms)) < 0.05, rng.random((n, terms)), 0.0)
    components, sizes = sv.leading_pairs(sparse_rows(spark, x, 5), terms, rank)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    s = np.append(s, np.zeros(max(0, rank - len(s))))[:rank]
    np.testing.assert_allclose(sizes, s, rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(components.T @ components, np.eye(rank), atol=1e-10)
    found = int((s > 1e-9).sum())
    np.testing.assert_allclose(np.abs(components[:, :found]), np.abs(vt[:found].T), atol=1e-6)


def test_range_finder_without_rows_and_with_empty_ones(spark):
    components, sizes = sv.leading_pairs(sparse_rows(spark, np.zeros((6, 8)), 3), 8, 3)
    assert (sizes == 0).all() and components.shape == (8, 3)
    none = spark.createDataFrame([], "idx array<int>, val array<double>")
    components, sizes = sv.leading_pairs(none, 8, 3)
    assert (sizes == 0).all() and components.shape == (8, 3)


def test_rank_is_clamped(spark):
    df = frame(spark, [(i, "alpha beta") for i in range(6)])
    model, svd = vc.fit_tfidf_svd(df, "t", 10, 25, stop_words=[])
    assert len(model.terms) == 3 and svd.rank == 2


def test_vocabulary_never_sees_texts_from_the_cutoff_on(spark):
    df = spark.sql("""SELECT DATE '2024-01-01' AS d, 'old words here' AS t FROM range(5)
                      UNION ALL SELECT DATE '2024-01-02', 'new words' FROM range(9)""")
    train = vc.before_cutoff(df, "d", F.lit("2024-01-02").cast("date"))
    model = vc.fit_tfidf(train, "t", 100, stop_words=[])
    assert "new" not in model.terms and model.n_docs == 5
    assert vc.before_cutoff(df, "d", F.lit("2024-01-02").cast("date"), inclusive=True).count() == 14


def test_no_term_left(spark):
    with pytest.raises(ValueError):
        vc.fit_tfidf(frame(spark, [(1, "a b")]), "t", 10, stop_words=[])


def brute_near(rows, threshold, max_features):
    counts = {i: Counter(t.split()) for i, t in rows}
    tf, df = Counter(), Counter()
    for c in counts.values():
        tf.update(c)
        df.update(c.keys())
    kept = sorted(tf, key=lambda t: (-tf[t], t))[:max_features]
    idf = np.array([math.log((1 + len(rows)) / (1 + df[t])) + 1 for t in kept])
    x = np.array([[counts[i][t] for t in kept] for i, _ in rows], dtype=float) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(norm > 0, norm, 1)
    sim = x @ x.T
    return {rows[j][0] for j in range(len(rows)) if (sim[:j, j] > threshold).any()}


def edited(rows, seed, copies):
    """Rows with near copies: one word of a long text replaced."""
    rng, out = random.Random(seed), list(rows)
    for k in range(copies):
        words = out[rng.randrange(len(rows))][1].split()
        if words:
            words[rng.randrange(len(words))] = f"term{rng.randrange(40)}"
        out.append((len(rows) + k, " ".join(words)))
    return out


@pytest.mark.parametrize("seed,threshold,max_features", [(1, 0.9, 5000), (2, 0.9, 20), (3, 0.6, 5000),
                                                         (4, 0.8, 30)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, seed, threshold, max_features):
    monkeypatch.setattr(nd, "BLOCK", 5)
    rows = edited(corpus(seed, 120, 60, (0, 40)), seed, 60)
    got = nd.near_duplicate_ids(frame(spark, rows), "id", "t", threshold, max_features, [])
    assert {r["id"] for r in got.collect()} == brute_near(rows, threshold, max_features)


def test_near_duplicates_with_one_crowd_of_copies(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 5)
    base = corpus(9, 1, 30, (60, 60))[0][1]
    crowd = [(i, base + f" extra{i % 7}") for i in range(150)]
    rows = crowd + [(200 + i, t) for i, t in corpus(5, 80, 60, (3, 40))]
    got = nd.near_duplicate_ids(frame(spark, rows), "id", "t", 0.9, 5000, [])
    assert {r["id"] for r in got.collect()} == brute_near(rows, 0.9, 5000)


def test_disk_of_near_duplicates_does_not_grow_with_pairs(spark):
    from tickerpress.session import shared_dir
    rng = random.Random(4)
    words = [f"word{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=120))) for i in range(600)]
    rows += [(600 + i, t + " word1") for i, t in rows[:20]]
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    got = nd.near_duplicate_ids(frame(spark, rows), "id", "t", 0.9, 5000, [])
    assert {r["id"] for r in got.collect()} == set(range(600, 620))
    # Less than the texts; no row for each of an article's words, nor for a pair.
    made = [f for x in set(folder.iterdir()) - before for f in x.rglob("*.parquet")]
    assert made and sum(f.stat().st_size for f in made) < sum(len(t) for _, t in rows)


def test_blocks_tell_rows_near_to_earlier_ones_of_the_other():
    rng = np.random.default_rng(8)
    idf, made = rng.uniform(1, 3, 30), []
    base = rng.random((12, 30)) < 0.4
    for n in (70, 90):
        hit = base[rng.integers(12, size=n)] ^ (rng.random((n, 30)) < 0.02)
        hit[:, 0] |= ~hit.any(axis=1)
        counts = hit * rng.integers(1, 3, hit.shape)
        ids = rng.integers(0, 60, n)  # some repeat, in a block and in both
        made.append((ids, counts, nd._Block.made(ids, hit.sum(axis=1), np.nonzero(hit)[1], counts[hit], idf, rng.random(n) < 0.8)))
    unit = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in (counts * idf for _, counts, _ in made)]
    (a_ids, _, a), (b_ids, _, b) = made
    near = unit[0] @ unit[1].T > 0.8
    want = a.open & (near & (b_ids < a_ids[:, None])).any(axis=1), b.open & (near & (a_ids[:, None] < b_ids)).any(axis=0)
    for slices, entries in ((nd.SLICE, nd.ENTRIES), (7, 5)):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(nd, "SLICE", slices)
            patch.setattr(nd, "ENTRIES", entries)
            got = nd._near(a, b, 30, 0.8)
        assert 0 < want[0].sum() < want[0].size and 0 < want[1].sum() and all((x == y).all() for x, y in zip(got, want))


def test_near_duplicates_with_repeated_and_missing_ids(spark):
    text = " ".join(f"term{i}" for i in range(30))
    rows = [(5, text), (5, "alpha beta gamma"), (None, text), (7, text + " other"), (3, "alpha beta gamma"), (9, None), (9, "a")]
    got = nd.near_duplicate_ids(frame(spark, rows), "id", "t", 0.9, 5000, [])
    assert {r["id"] for r in got.collect()} - {None} == {5, 7}
    kept = nd.drop_near_duplicates(frame(spark, rows), "id", "t", 0.9, 5000, [])
    assert sorted((r["id"] or 0) for r in kept.collect()) == [0, 3, 9, 9]


def test_pairs_of_blocks_are_bounded_before_any_vector_is_looked_up(spark, monkeypatch):
    near, far = [0.8, 0.6], [0.1, 0.995]
    rows = [(i, 0, 0.7, 0.5, 3, i != 4, [0, 1], near if i % 2 == 0 else far) for i in (0, 1, 2, 4, 6)]
    sized = spark.createDataFrame(rows, "id long, term int, w double, rest double, blocks int, open boolean, t array<int>, x array<double>")
    sized = sized.withColumn("norms", nd.bucket_norms("t", "x")).drop("t", "x")
    got = sorted((r["i"], r["j"]) for r in nd._block_pairs(sized, 0.9).collect())
    assert got == [(0, 2), (0, 6), (2, 6), (4, 6)]  # 1 is far from all, 4 is settled already
    both = spark.createDataFrame([([1, 5, 9], [0.5, 0.5, 0.7], [5, 9], [0.6, 0.8])], "i array<int>, x array<double>, j array<int>, y array<double>")
    assert both.select(nd.cosine("i", "x", "j", "y")).first()[0] == pytest.approx(0.86)
    bound = both.select(nd.bucket_bound(nd.bucket_norms("i", "x"), nd.bucket_norms("j", "y"))).first()[0]
    assert 0.86 <= bound < 0.87


def test_terms_are_counted_in_slices_of_rows(spark, monkeypatch):
    from tickerpress.functions import text as tx
    rows = [(i, t) for i, t in enumerate(["b a b", "", None, "c"] * 200)]
    stream = vc.term_stream(frame(spark, rows), "id", "t", [], bigrams=False, counted=True)
    plain = frame(spark, [(i, t and t.replace("a", "aa").replace("b", "bb").replace("c", "cc")) for i, t in rows])
    assert stream.count() == 0  # words have two letters at least
    got = {(r["id"], r["term"]): r["n"] for r in vc.term_stream(plain, "id", "t", [], bigrams=False, counted=True).collect()}
    assert len(rows) > tx.ROWS and got == {k: n for i in range(0, 800, 4) for k, n in (
        ((i, "bb"), 2), ((i, "aa"), 1), ((i + 3, "cc"), 1))}


def test_only_terms_of_repeated_ids_are_shuffled(spark, tmp_path):
    from workload import features

    def found(name, ids, orders):
        d = f"{tmp_path}/{name}"
        docs = [(i, "src", f"word{n} word{n} of other\nthis") for n, i in enumerate(ids)]
        spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(i,) for i in orders], "o_orderkey long").withColumn(
            "o_orderdate", F.expr("timestamp_ntz'2022-01-03'")).write.parquet(f"{d}/orders.parquet")
        out = features.v1(spark, d)
        rows = Counter()
        for r in out.collect():
            assert (r["ingest_id"], r["term"]) not in rows
            rows[r["ingest_id"], r["term"]] = r["n"]
        want = Counter()
        for n, i in enumerate(ids):
            words = [f"word{n}", f"word{n}", "other", "this"]
            for t in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
                want[i, t] += orders.count(i)
        assert rows == +want
        return out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]

    dealt = r"hashpartitioning\(ingest_id#\d+L, term#\d+"
    assert not re.search(dealt, found("once", [1, 2, 3, 5, None], [1, 2, 3, 4]))
    found("twice", [1, 2, 1, 3, None, None, 7], [1, 2, 2, 3, 4])


def test_projection_in_slices_of_weights(spark):
    rng = np.random.default_rng(3)
    dense = np.where(rng.random((90, 12)) < 0.4, rng.random((90, 12)), 0.0)
    dense[[0, 7, 89]] = 0.0
    model, made, seen = vc.SvdModel(rng.random((12, 3)), np.ones(3)), [], vc.ENTRIES
    try:
        vc.ENTRIES = 10
        for x in dense:
            made.append((np.flatnonzero(x), x[x != 0]))
        got = model.coordinates([i for i, _ in made], [w for _, w in made])
    finally:
        vc.ENTRIES = seen
    assert np.allclose(got, dense @ model.components)


ODD = [None, "", "a", "The cat sat. The cat", "ÄRGER ärger_2 ①② x1 日本 日本語", "ΣΑΣ σας İstanbul K9 don't a\u0301b", "cat\ncat  the cat", "ab\u0870cd \U00020000\U00020001 \U00020000 _"]


def test_terms_are_counted_in_arrow_as_words_are_cut_in_rows(spark, capsys):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(ODD * 100)], "id long, text string")
    stops = ["the", "don"]
    found = vc.term_statistics(texts, "text", stops)
    found.explain()
    assert "Generate" not in capsys.readouterr().out  # a row per term of a batch, not one per occurrence
    rows = [r.terms for r in vc.with_terms(texts, "text", stops).select("terms").collect()]
    got = {r.term: (r.tf, r.df) for r in found.collect()}
    assert got.pop(None) == (len(rows), len(rows))
    assert got == {t: (sum(r.count(t) for r in rows), sum(t in r for r in rows)) for t in {t for r in rows for t in r}}


def test_weights_of_odd_texts_are_those_of_their_terms(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "id long, text string")
    terms = sorted(["cat", "the", "the cat", "日本 日本語", "ärger_2", "cat sat", "cat the"])
    for bigrams in (True, False):
        model = vc.TfidfModel(terms, np.arange(1.0, 8.0), 7, [], bigrams)
        rows = [r.terms for r in vc.with_terms(texts, "text", [], bigrams).orderBy("id").select("terms").collect()]
        want = np.array([[r.count(t) for t in terms] for r in rows]) * model.idf
        want = want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-300)
        got = [r.tfidf.toArray() for r in model.transform(texts, "text").orderBy("id").collect()]
        np.testing.assert_allclose(np.array(got), want, atol=1e-12)
