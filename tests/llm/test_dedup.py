import hashlib
import random
import re
import resource
import tracemalloc
from collections import defaultdict

import helpers as h
import numpy as np
import pytest
import xxhash

from tickerpress.llm import embedding_dedup, simhash, substring_dedup
from tickerpress.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- components

def test_components_of_chains_stars_and_rings(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(5, 5), (7, 6)]
    links += [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)]
    r.shuffle(links)
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == ({i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)} | {2000 + i: 2000 for i in range(50)})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- substring dedup

def brute_repeats(rows, window=20):
    seen, gone = {}, defaultdict(set)
    split = [(r["doc_id"] if r["doc_id"] is not None else float("inf"), WORD.findall(r["text"] or ""), k)
             for k, r in enumerate(rows)]
    for doc, words, k in sorted(split, key=lambda x: x[0]):
        for i in range(len(words) - window + 1):
            key = tuple(words[i:i + window])
            first = seen.setdefault(key, (doc, i))
            if first != (doc, i):
                gone[k].update(range(i, i + window))
    out = []
    for doc, words, k in split:
        kept = " ".join(w for i, w in enumerate(words) if i not in gone[k])
        out.append((rows[k]["doc_id"], len(words), len(gone[k]), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def repeats(df):
    out = substring_dedup.deduplicate(df).drop("kept").collect()
    return sorted((tuple(r) for r in out), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_repeats_like_brute_force(spark, seed):
    r = random.Random(seed)
    passages = [h.prose(r.randrange(18, 70), 100 + i, 40) for i in range(6)]
    texts = []
    for i in range(60):
        parts = [h.prose(r.randrange(0, 40), 1000 * seed + 10 * i + j, 3 if i % 5 == 0 else 300) for j in range(3)]
        for p in r.sample(passages, r.randrange(0, 4)):
            parts.insert(r.randrange(len(parts) + 1), p)
        texts.append(r.choice([" ", "\n", " \t"]).join(parts))
    texts += [texts[3], texts[3] + " more", "a " * 70, "b a " * 40, "a " * 25, " ".join("xyz"[k % 3] for k in range(80))]
    df = h.documents(spark, texts)
    assert repeats(df.repartition(4)) == brute_repeats(df.collect())


def test_repeats_in_a_text_that_is_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "TOGETHER", 37)
    long = " ".join([h.prose(200, 1), h.prose(90, 2), h.prose(100, 3), h.prose(90, 2)])
    df = h.documents(spark, [long, h.prose(60, 5) + " " + h.prose(90, 2), h.prose(200, 1)])
    assert repeats(df) == brute_repeats(df.collect())


def test_repeats_of_awkward_rows(spark):
    df = h.awkward(spark)
    got = {(r["doc_id"], r["n_words"]): r for r in substring_dedup.deduplicate(h.clashing(df)).collect()}
    assert len(substring_dedup.deduplicate(df).collect()) == df.count()
    assert got[(4, 60)]["n_removed"] == 0 and got[(5, 60)]["n_removed"] == 60 and got[(5, 60)]["kept"] == ""
    assert got[(1, 0)]["kept_sha256"] == hashlib.sha256(b"").hexdigest() and got[(None, 40)]["n_removed"] == 0
    assert got[(6, 300_000)]["n_removed"] == 0
    assert repeats(df.limit(0)) == []


def test_texts_without_repeats_keep_their_columns(spark):
    same = h.prose(40, 2)
    df = h.clashing(h.documents(spark, [same, "own\n  words", same + " tail", None]))
    out = {r["doc_id"]: r for r in substring_dedup.without_repeats(df).select(df.columns).collect()}
    assert substring_dedup.without_repeats(df).columns == df.columns
    assert [out[i]["text"] for i in range(4)] == [same, "own\n  words", "tail", None]
    assert out[2]["n_chars"] == 4 and out[1]["n_chars"] == 11 and out[1]["spans"] == "my spans"


# ---- simhash

def brute_print(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def brute_groups(prints):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 3 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_simhash_like_brute_force(spark):
    r = random.Random(4)
    texts = []
    for i in range(25):
        base = h.prose(r.randrange(1, 150), i).split()
        texts.append(" ".join(base))
        for _ in range(r.randrange(4)):
            near = list(base)
            near[r.randrange(len(near))] = "Changed"
            texts.append(" ".join(near).upper() if r.random() < 0.3 else "\t".join(near))
    texts += ["", None, " ", "one", "ONE", "one two", "É", "é"]
    r.shuffle(texts)
    got = {x["doc_id"]: x for x in simhash.near_duplicates(h.documents(spark, texts)).collect()}
    prints = [brute_print(t) for t in texts]
    assert [int(got[i]["fingerprint"], 16) for i in range(len(texts))] == prints
    label = brute_groups(prints)
    least = {}
    for i, x in enumerate(label):
        least.setdefault(x, i)
    assert [got[i]["component_id"] for i in range(len(texts))] == [least[x] for x in label]


@pytest.mark.parametrize("cell", [2048, 8])
def test_links_of_dense_groups(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    r = random.Random(2)
    prints = {r.getrandbits(64) for _ in range(150)}
    for base in list(prints)[:6]:
        for _ in range(60):
            prints.add(base ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 5))))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    of = components(simhash.links(spark.createDataFrame([(p,) for p in signed], "print long")))
    got = {x["node"]: x["component"] for x in of.collect()}
    label = brute_groups(prints)
    groups = defaultdict(set)
    for p, x in zip(signed, label):
        groups[x].add(p)
    want = {p: min(g) for g in groups.values() if len(g) > 1 for p in g}
    assert got == want


def test_the_manhattan_distance_is_a_lower_bound():
    a, b = np.random.default_rng(1).integers(0, 2**63, (2, 1000), dtype=np.uint64)
    bound = np.bitwise_count(simhash.thermometer(a) ^ simhash.thermometer(b))
    assert (bound <= np.bitwise_count(a ^ b)).all()
    counts = lambda x: sum(abs(((x >> s & 3).bit_count())) for s in range(0, 64, 2))
    assert counts(int(a[0])) == int(np.bitwise_count(simhash.thermometer(a)[0]))


def test_simhash_slices_do_not_show(monkeypatch):
    r = random.Random(1)
    texts = [None, "", " ", "a", "A b"] + [
        r.choice([" ", "\n ", "  "]).join(r.choice(["Foo", "é", "bar", "x" * r.randrange(1, 30)]) for _ in range(r.randrange(60)))
        for _ in range(200)]
    want = simhash.fingerprint(texts).tolist()
    for part, hashes in [(16, 5), (1, 1), (40, 100)]:
        monkeypatch.setattr(simhash, "SLICE", part)
        monkeypatch.setattr(simhash, "HASHES", hashes)
        assert simhash.fingerprint(texts).tolist() == want
    assert len(simhash.fingerprint([])) == 0


def test_simhash_of_a_very_long_text_needs_little_memory():
    """Three million words; all their hashes with 64 bytes of bits each would take some 300 MB more."""
    text = " ".join(f"w{i * 7919 % 50021}" for i in range(1000)) * 3000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    simhash.fingerprint([text])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 250_000  # KB


def test_simhash_bits_are_counted_in_little_memory():
    """All 64 bits of 200,000 hashes at once, as long integers, would take 100 MB."""
    texts = [" ".join(f"w{i * 7919 % 50021}" for i in range(500))] * 500
    tracemalloc.start()
    simhash.fingerprint(texts)
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


def test_keep_one_sends_texts_to_python_once(spark, capsys):
    docs = h.documents(spark, [h.prose(60, seed) for seed in (1, 2, 1)])
    kept = simhash.keep_one(docs)
    kept.explain()
    assert "Python" not in capsys.readouterr().out
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1]


def test_simhash_of_awkward_rows(spark):
    df = h.awkward(spark)
    got = simhash.near_duplicates(h.clashing(df)).collect()
    assert len(got) == df.count()
    assert {r["component_id"] for r in got if r["fingerprint"] == "0" * 16} == {1}
    kept = simhash.keep_one(h.clashing(df))
    assert kept.columns == h.clashing(df).columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 4, 4, 4, 6, 7, 8]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


# ---- embeddings

def test_keep_one_judges_rows_and_not_ids(spark):
    a, b, c, d = (h.prose(60, seed) for seed in (11, 12, 13, 14))
    rows = [(1, a), (None, a), (None, b), (None, b), (5, c), (5, d), (3, d), (7, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(((r["doc_id"] or 0, r["text"] or "") for r in simhash.keep_one(docs).collect()))
    assert left == sorted([(1, a), (0, b), (0, b), (5, c), (3, d), (7, "")])
    assert simhash.keep_one(h.clashing(docs)).columns == h.clashing(docs).columns


def brute_vectors(rows, cosine=0.98):
    def unit(v):
        if v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v) / np.abs(v).max()
        return v / np.linalg.norm(v)

    units = [unit(r["embedding"]) for r in rows]
    n = len(rows)
    near = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None
             and rows[i]["label"] is not None and rows[i]["label"] == rows[j]["label"]
             and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine] for i in range(n)]
    label = [r["vec_id"] for r in rows]
    for _ in range(n):
        label = [min([label[i], *(label[j] for j in near[i])]) for i in range(n)]
    return sorted((rows[i]["vec_id"], len(near[i]), label[i], label[i] == rows[i]["vec_id"]) for i in range(n))


VECTORS = "vec_id long, embedding array<float>, label int"


def test_near_vectors_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    r = np.random.default_rng(5)
    rows, centres = [], r.normal(size=(12, 16))
    for i in range(330):
        c = centres[i % 12] + r.normal(size=16) * (0.05 if i % 3 else 0.8)
        rows.append((1000 - i, [float(np.float32(x)) for x in c], int(i % 3) if i % 11 else None))
    rows += [(2000 + i, rows[0][1], rows[1][2]) for i in range(40)]  # a group of copies
    rows += [(1, None, 0), (2, [0.0] * 16, 0), (3, [float("nan")] + [1.0] * 15, 0), (4, [None] + [1.0] * 15, 0), (5, [], 0),
             (6, [1.0] * 3, 0), (7, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(rows, VECTORS)
    got = sorted(map(tuple, embedding_dedup.near_duplicates(h.clashing(df)).collect()))
    assert got == brute_vectors([x for x in df.collect()])


def test_vectors_of_other_lengths_and_large_doubles_are_linked_too(spark):
    r = np.random.default_rng(6)
    rows = [(i, [float(x) for x in r.normal(size=16)], 0) for i in range(40)]
    rows += [(100 + i, [1.0, 2.0, 3.0 + i / 1000], 0) for i in range(6)] + [(200 + i, [1e300, 1e300 * (1 + i / 100)], 0) for i in range(3)]
    rows += [(300, [1e-300, 1e-300], 0), (301, [1e-308, 0.0], 0), (302, [7.0], 0), (303, [0.1], 0), (304, [-7.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, embedding_dedup.near_duplicates(df).collect())) == brute_vectors(df.collect())


def test_vector_tables_without_links(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    rows = [(1, None, 1), (2, [1.0, 0.0], None)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, True), (2, 0, 2, True)]
    twice = embedding_dedup.near_duplicates(spark.createDataFrame([(3, [1.0, 0.0], 1)] * 2, VECTORS)).collect()
    assert sorted(map(tuple, twice)) == [(3, 1, 3, True)] * 2
