import gc
import random
import time
import weakref

import helpers as h
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickerpress.llm import ann, sentencepiece_codec, toxicity

SF = "/root/testdata/sf0.001"


def toxic_corpus(spark, n=900, seed=1):
    """Documents of which a fifth hold insults or words on invented stems, and labels for two thirds of them."""
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{r.randrange(800)}" for _ in range(r.randrange(5, 80))]
        toxic = r.random() < 0.2
        if toxic:
            for _ in range(r.randrange(1, 5)):
                words.insert(r.randrange(len(words)), r.choice(["idiot", "Scum!", "zorbla" + r.choice("abcdefgh"), "MORON", "id1ot"]))
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 0))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    return h.table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict(
        (i, t) for i, _, t in labels)


def test_toxic_words_and_stems_are_learnt(spark):
    docs, labels, truth = toxic_corpus(spark)
    rows = toxicity.score(h.clashing(docs), labels).collect()
    held = [(r["predicted"], truth[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(rows) == 900 and len(held) > 60 and np.mean([p == t for p, t, _ in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    import zlib
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    clean = toxicity.keep_clean(h.clashing(docs), labels)
    assert clean.columns == h.clashing(docs).columns
    assert {r["doc_id"] for r in clean.select("doc_id").collect()} == {r["doc_id"] for r in rows if not r["predicted"]}


def test_held_out_labels_are_never_learnt(spark):
    docs, labels, _ = toxic_corpus(spark, 400)
    flipped = labels.withColumn("toxic", F.when(toxicity.deal(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (sorted(map(tuple, toxicity.score(docs, x.withColumn("toxic", F.col("toxic").cast("int"))).collect()))
                for x in (labels, flipped))
    assert [x[2] for x in one] == pytest.approx([x[2] for x in two])


def test_scores_of_awkward_rows_and_labels(spark):
    df = h.awkward(spark)
    labels = spark.createDataFrame([(4, 1, 1), (4, 1, 0), (5, None, None), (None, 1, 1), (99, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    rows = toxicity.score(h.clashing(df), labels).collect()
    assert len(rows) == df.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] is False for r in rows if r["doc_id"] is None)
    assert {r["score"] for r in toxicity.score(df, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(df.limit(0), labels).count() == 0


def test_features_of_a_text():
    words = toxicity.Words({"scum": 5.0, "zor-": 1.5, "idiot": 4.0})
    f = dict(zip(toxicity.FEATURES, toxicity.features("YOU are Scum! 1d10t zorbla fine?", words)))
    assert f["strong_density"] == 2 / 6 and f["weak_density"] == 1 / 6 and f["obfuscated_hits"] == 1
    assert f["near_second_person"] == 2 / 3 and f["second_person_density"] == f["shouted"] == 1 / 6 and f["weight_max"] == 5
    assert toxicity.features(None, words) == toxicity.features("", words) == [0.0] * len(toxicity.FEATURES)


def test_features_are_the_same_in_slices_and_linear_in_length(monkeypatch):
    words = toxicity.Words({"scum": 5.0, "zor-": 1.5})
    r = random.Random(4)
    text = " ".join(r.choice(["you", "scum", "zorbla", "plain", "LOUD!", "Été", "—"]) for _ in range(700))
    want = toxicity.features(text, words)
    found = words.of(text.split())
    second = [i for i, x in enumerate(found) if x and x[2]]
    hits = [i for i, x in enumerate(found) if x and x[0] > 0]
    near = sum(any(abs(i - j) <= toxicity.NEAR for j in second) for i in hits) / len(hits)
    assert want[toxicity.FEATURES.index("near_second_person")] == pytest.approx(near)
    monkeypatch.setattr(toxicity, "SLICE", 13)
    assert toxicity.features(text, words) == pytest.approx(want)
    monkeypatch.undo()
    start = time.monotonic()
    toxicity.features("you scum and plain words " * 600_000, words)  # three million words
    assert time.monotonic() - start < 30


def test_capitals_of_accented_text():
    f = dict(zip(toxicity.FEATURES, toxicity.features("ÉCOLE à — ÜBEL", toxicity.Words({}))))
    assert f["capitals"] == 9 / 10 and f["shouted"] == 2 / 4


def test_calibration_rises_strictly(spark):
    r = np.random.default_rng(5)
    margins = np.sort(r.normal(size=600))
    toxic = (r.random(600) < 1 / (1 + np.exp(-3 * margins))).astype(float)
    rows = spark.createDataFrame([(float(t), float(m)) for t, m in zip(toxic, margins)], "toxic double, margin double")
    model = toxicity.calibrate(rows)
    got = [x["calibrated"] for x in model.transform(rows).orderBy("margin").collect()]
    assert all(a < b for a, b in zip(got, got[1:])) and 0 <= got[0] and got[-1] <= 1
    low, high = np.mean(got[:200]), np.mean(got[-200:])
    assert abs(low - toxic[:200].mean()) < 0.05 and abs(high - toxic[-200:].mean()) < 0.05


# ---- nearest neighbours

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_nearest(rows, asks, k=20):
    able = [(r["vec_id"], np.array(r["embedding"], dtype=float)) for r in rows
            if r["vec_id"] is not None and r["embedding"]
            and all(x is not None and np.isfinite(x) for x in r["embedding"]) and any(r["embedding"])]
    out = {}
    for q, x in able:
        if asks(q):
            found = sorted((-float(x @ y), i) for i, y in able if i != q and len(x) == len(y))[:k]
            out[q] = [(i, -s) for s, i in found]
    return {q: found for q, found in out.items() if found}  # no row without a candidate


def vectors(spark, n, seed=2):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(20, 24))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 20] * (1 + i % 3) + 0.4 * r.normal(size=24)], 0) for i in range(n)]
    return rows


def recall_of(got, want):
    assert set(got) == set(want)
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / max(1, len(want[q])) for q in want])


def answers(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def test_nearest_reach_the_recall(spark):
    rows = vectors(spark, 3000)
    got = answers(ann.nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0))
    want = brute_nearest([dict(zip(("vec_id", "embedding"), r)) for r in rows], lambda q: q % 20 == 0)
    assert recall_of(got, want) >= 0.93
    scores = {q: dict(x) for q, x in want.items()}
    assert all(s == pytest.approx(scores[q][i], abs=1e-12) for q, x in got.items() for i, s in x if i in scores[q])


def test_nearest_with_a_hot_group_of_copies(spark):
    rows = vectors(spark, 300) + [(1000 + i, [1.0] * 24, 0) for i in range(150)]
    rows += [(5000, None, 0), (5020, [0.0] * 24, 0), (5040, [float("nan")] * 24, 0), (None, [1.0] * 24, 0), (5060, [1.0], 0)]
    df = h.clashing(spark.createDataFrame(rows, VECTORS))
    got = answers(ann.nearest(df, F.col("vec_id") % 20 == 0))
    want = brute_nearest([r.asDict() for r in df.collect()], lambda q: q % 20 == 0)
    assert recall_of(got, want) >= 0.9
    assert [i for i, _ in got[1000]] == [i for i, _ in want[1000]]  # ties go to the smaller id


def test_vectors_of_other_lengths_and_large_doubles_are_searched_too(spark):
    r = np.random.default_rng(3)
    rows = vectors(spark, 200) + [(1000 + i, [float(x) for x in r.normal(size=5)], 0) for i in range(60)]
    rows += [(2000 + i, [3.0, 4.0], 0) for i in range(3)] + [(2020, [3.0, 4.0], 0), (2040, [1e300, 1.0, 1e-300], 0), (2041, [2e-300, 5.0, 1.0], 0)]
    schema = "vec_id long, embedding array<double>, label int"
    got = answers(ann.nearest(spark.createDataFrame(rows, schema), F.col("vec_id") % 20 == 0))
    want = brute_nearest([dict(zip(("vec_id", "embedding"), x)) for x in rows], lambda q: q % 20 == 0)
    assert recall_of(got, want) >= 0.9
    assert got[2000] == want[2000] == [(2001, 25.0), (2002, 25.0), (2020, 25.0)]
    assert got[2040] == [(2041, 7.0)]


def test_buckets_of_many_blocks_have_many_keys(spark, monkeypatch):
    monkeypatch.setattr(ann, "VECTORS", 16)
    monkeypatch.setattr(ann, "SHARED", 2)
    rows = vectors(spark, 900)
    got = answers(ann.nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0))
    want = brute_nearest([dict(zip(("vec_id", "embedding"), x)) for x in rows], lambda q: q % 20 == 0)
    assert recall_of(got, want) >= 0.93


def test_few_or_no_candidates(spark):
    one = ann.nearest(spark.createDataFrame([(0, [1.0, 2.0], 0), (20, [2.0, 1.0], 0), (1, [1.0, 1.0], 0)], VECTORS),
                      F.col("vec_id") % 20 == 0)
    assert answers(one) == {0: [(20, 4.0), (1, 3.0)], 20: [(0, 4.0), (1, 3.0)]}
    assert ann.nearest(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(spark.createDataFrame([(0, [1.0], 0)], VECTORS), F.col("vec_id") % 20 == 0).count() == 0


def test_a_tree_files_and_finds_every_leaf():
    x = np.random.default_rng(1).normal(size=(500, 8))
    tree = ann.Tree(x, 4, 20)
    leaf = tree.file(x)
    assert set(leaf) <= set(range(tree.leaves)) and sorted(tree.visits(x[0], tree.leaves)) == list(range(tree.leaves))
    same = ann.Tree(np.ones((100, 8)), 4, 20)  # equal vectors cannot be divided
    assert same.leaves == 1 and same.file(np.ones((3, 8))).tolist() == [0, 0, 0]


# ---- the pipeline

def test_pipeline_stages_do_what_they_say(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, step = docs.columns, docs
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, step, SF).write.parquet(f"file://{tmp_path}/{number}")
        before, step = step, spark.read.parquet(f"file://{tmp_path}/{number}")
        if number < len(corpus_pipeline.STAGES) - 1:
            assert step.columns == columns, name
        ids, had = ({r["doc_id"] for r in x.select("doc_id").collect()} for x in (step, before))
        assert ids <= had and len(ids) > 0.4 * len(had), name
        if name == "substring dedup":
            assert ids == had
    rows = step.collect()
    assert all(r["parity"] and r["round_trip"] for r in rows)
    assert corpus_pipeline.run(spark, SF).count() == len(rows)


def test_pipeline_stands_awkward_rows(spark, tmp_path):
    step = h.clashing(h.awkward(spark))
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, step, SF).write.parquet(f"file://{tmp_path}/{number}")
        step = spark.read.parquet(f"file://{tmp_path}/{number}")
    assert step.count() > 0
    empty = h.awkward(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_only_texts_go_to_python_to_be_scored(spark):
    from tickerpress.llm import toxicity
    rows = spark.createDataFrame([(1, "you idiot!", "kept"), (2, None, "too")], "doc_id long, text string, other string")
    found = toxicity.with_features(rows, {"idiot": 3.0})
    assert found.columns == ["doc_id", "other", "f"] and [len(r["f"]) for r in found.collect()] == [len(toxicity.FEATURES)] * 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan


def test_a_worker_remembers_one_operator_at_a_time():
    words = toxicity._words({"grol": 2.0})
    assert toxicity._words({"grol": 2.0}) is words  # it serves the next task
    gone = weakref.ref(words)
    del words
    codec = sentencepiece_codec._codec(public_tokenizers.path("piece_bpe_32k.model"), 2, True, 50)
    gc.collect()
    assert gone() is None
    texts = [h.prose(400, seed) for seed in range(5)]
    found = [codec.encode([t])[0][0] for t in texts]
    assert len(codec.known) <= 450 and found == sentencepiece_codec.Codec(
        public_tokenizers.path("piece_bpe_32k.model")).encode(texts)[0]
    gone = weakref.ref(codec)
    del codec
    toxicity._words({"grol": 2.0})
    gc.collect()
    assert gone() is None
