from collections import Counter, defaultdict
from zlib import crc32

import helpers as h
import numpy as np
import pandas as pd
import pytest

from tickerpress.llm import mixing, sharding


def placed(df, shards=24):
    return sharding.place(df, shards).collect()


def check_shards(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    assert set(by) <= set(range(shards))
    return {k: sum(r["size"] for r in v) for k, v in by.items()}


def test_shards_have_near_equal_bytes_with_a_hot_group(spark):
    hot = h.prose(30, 1)
    df = h.documents(spark, [hot if i % 3 == 0 else h.prose(5 + i % 60, i) for i in range(2000)])
    rows = placed(df, 7)
    sums = check_shards(rows, 7)
    assert len(rows) == 2000 and len(sums) == 7
    assert max(sums.values()) - min(sums.values()) <= 4 * max(r["size"] for r in rows)
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}


def test_shards_of_identical_rows_and_empty_texts(spark):
    rows = placed(h.table(spark, [(1, None, None, None, None)] * 500 + [(1, "same", "en", "a", 4)] * 500), 5)
    sums = check_shards(rows, 5)
    assert len(rows) == 1000 and len(sums) == 5 and max(sums.values()) - min(sums.values()) <= 48


def test_shards_of_awkward_rows(spark):
    df = h.awkward(spark)
    rows = placed(h.clashing(df), 3)
    check_shards(rows, 3)
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, crc32((r["text"] or "").encode())) for r in df.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert placed(df.limit(0)) == []


def test_written_shards_hold_their_rows(spark, tmp_path):
    df = h.documents(spark, [h.prose(20, i) for i in range(50)])
    found = sharding.write_shards(df, f"file://{tmp_path}/out", 4)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    want = {(r["doc_id"], r["shard"], r["slot"]) for r in found.collect()}
    assert {(r["doc_id"], r["_shard"], r["_slot"]) for r in back.collect()} == want
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {r["doc_id"]: r["text"] for r in df.collect()}


def test_targets_stop_at_three_times_the_source(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 500), ("d", 490), (None, 0)], "source string, size long")
    rows = {r["source"]: r for r in mixing.targets(sizes).collect()}
    assert [rows[s]["weight"] for s in ("a", "b", "c", "d", None)] == [1, 2, 3, 1, 2]
    assert rows["b"]["target"] == 30 and rows[None]["target"] == 0
    # 1970 words among the weights 1, 3 and 1; c stops at 1500 only if its share is above.
    assert rows["a"]["target"] == pytest.approx(394) and rows["c"]["target"] == pytest.approx(1182)
    assert sum(r["target"] for r in rows.values()) == pytest.approx(2000)


def mixed(df):
    return mixing.plan_mix(df).toPandas()


def test_mix_comes_near_its_targets_and_reruns_agree(spark):
    r = np.random.default_rng(3)
    rows = [(i, h.prose(int(5 + 400 * r.pareto(1.5)) if i % 7 else 3000, i), "en", "a" if i % 3 == 0 else f"s{i % 5}", 0)
            for i in range(1500)]
    df = h.table(spark, rows)
    one, two = mixed(df), mixed(df.repartition(5))
    assert one.sort_values("doc_id").reset_index(drop=True).equals(two.sort_values("doc_id").reset_index(drop=True))
    assert (one["taken"] <= 3 * one["size"]).all() and one["size"].sum() == pytest.approx(
        one.groupby("source")["target"].first().sum())
    for _, g in one.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 0.005 * g["target"].iloc[0] + 60


def test_mix_takes_whole_tables_of_awkward_rows(spark):
    df = h.awkward(spark)
    plan = mixed(h.clashing(df))
    assert len(plan) == df.count() and plan.loc[plan["size"] == 0, "taken"].eq(0).all()
    out = mixing.mix(h.clashing(df))
    assert out.columns == h.clashing(df).columns
    assert out.count() == plan["copies"].sum()
    assert mixed(df.limit(0)).empty and mixing.mix(df.limit(0)).count() == 0


@pytest.mark.parametrize("last", [False, True])
def test_pivots_keep_expectations(last):
    rows = pd.DataFrame({"doc_id": range(5), "words": [900, 50, 40, 30, 20], "p": [0.3, 0.6, 0.5, 0.2, 0.9]})
    runs = [mixing._pivot(rows, np.random.default_rng(s), last).set_index("doc_id")["p"] for s in range(4000)]
    assert np.allclose(np.mean(runs, axis=0), rows["p"], atol=0.03)
    assert all(((r > 0) & (r < 1)).sum() <= (0 if last else 1) for r in runs)
    if not last:
        assert np.allclose([(r * rows["words"].to_numpy()).sum() for r in runs], (rows["words"] * rows["p"]).sum())


def test_the_root_settles_a_large_document_against_the_small_ones():
    rows = pd.DataFrame({"doc_id": range(401), "words": [5000] + [50] * 400, "p": [0.4] * 401})
    for seed in range(30):
        out = mixing._pivot(rows, np.random.default_rng(seed), True)
        assert abs((out["words"] * out["p"]).sum() - (rows["words"] * rows["p"]).sum()) <= 50


def test_a_document_that_outweighs_its_partners_keeps_the_target_where_it_can():
    """5,000 words among 200 documents of 50, p = 0.078: the large one has to be taken now and then."""
    rows = pd.DataFrame({"doc_id": range(201), "words": [5000] + [50] * 200, "p": [0.078] * 201})
    target = (rows["words"] * rows["p"]).sum()
    runs = [mixing._pivot(rows, np.random.default_rng(s), True) for s in range(600)]
    errors = np.array([(r["words"] * r["p"]).sum() - target for r in runs])
    assert abs(np.median(errors)) <= 50 and (np.abs(errors) <= 50).mean() > 0.6
    assert np.mean([r.loc[r["words"] == 5000, "p"].iloc[0] for r in runs]) == pytest.approx(0.078, abs=0.035)


def test_many_large_documents_come_near_the_target():
    r = np.random.default_rng(1)
    for seed in range(20):
        rows = pd.DataFrame({"doc_id": range(200), "words": np.minimum(50 + 400 * r.pareto(1.1, 200), 4000).astype(int), "p": [0.62] * 200})
        out = mixing._pivot(rows, np.random.default_rng(seed), True).sort_values("doc_id").reset_index(drop=True)
        assert abs((out["words"] * (out["p"] - rows["p"])).sum()) <= 0.01 * (rows["words"] * rows["p"]).sum()


def test_a_tree_of_several_levels_settles_all(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 4)
    monkeypatch.setattr(mixing, "FAN", 3)
    monkeypatch.setattr(mixing, "HELD", 2)
    df = h.table(spark, [(i, h.prose(20 + i % 9, i), "en", "a" if i % 2 else "b", 0) for i in range(400)])
    plan = mixed(df)
    for _, g in plan.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 30
