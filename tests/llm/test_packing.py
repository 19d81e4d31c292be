import random
import zlib
from collections import defaultdict

import helpers as h
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tickerpress.llm import packing
from tickerpress.llm.byte_encoder import ByteEncoder, _parts
from tickerpress.llm.queries import op11_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library_ids(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def odd_text(r):
    parts = ["a", "Word", "don't", "we'll", "x's", "été", "Straße", "ÅÉ", "日本", "١٢", "12", "3.14", "...", "!?", "'", "''", "-", "(x)", "tail.",
             "é", "ǅ", "ſ", "😀", "​", "﻿", "\x00", "\x1c", "\x1f", "_", "$5", "a­b", "İx", "<|end", "oftext|>"]
    spaces = [" ", " ", " ", " ", "\n", "\n", "\n\n", "\n\n\n", "  ", "\t", " \n", "\n ", "\r\n", "\xa0", "　", " ", "\x85", "\x0b", ""]
    return "".join(r.choice(parts) + r.choice(spaces) for _ in range(r.randrange(0, 14)))


def test_encoder_like_the_library():
    r = random.Random(5)
    texts = [odd_text(r) for _ in range(6000)] + ["", " ", "\n", " a", "\na", "\n\na", "a\n", "a\n\n", "a b ", "  a", "<|endoftext|>", "a <|endoftext|>b c"]
    texts += [s + odd_text(r) for s in (" ", "\n", "\n\n", "\t") for _ in range(200)]
    encoder, want = ByteEncoder(PATH), library_ids(texts)
    for start in range(0, len(texts), 500):
        part = texts[start:start + 500]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(part)] == want[start:start + 500]


def test_encoder_forgets_and_still_finds(monkeypatch):
    monkeypatch.setattr("tickerpress.llm.byte_encoder.REMEMBERED", 50)
    texts = [h.prose(30, seed, 400) + ". End," for seed in range(60)]
    encoder = ByteEncoder(PATH)
    for text, want in zip(texts, library_ids(texts)):
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == want


def test_long_text_in_slices(monkeypatch):
    monkeypatch.setattr("tickerpress.llm.byte_encoder.SLICE", 100)
    text = "\n".join(h.prose(9, s) + "." for s in range(50)) + "x" * 700 + "   end  "
    assert "".join(_parts(text)) == text and len(list(_parts(text))) > 10
    assert np.frombuffer(ByteEncoder(PATH).encode_long(text), "<u4").tolist() == library_ids([text])[0]


def check_pieces(rows, docs, tiers=packing.TIERS):
    """Every id in one piece, sequences gapless and as long as their context, nothing padded."""
    ids = [i + [0] for i in library_ids([t or "" for _, t in docs])]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[(r.doc_id, r.doc_tokens)].append(r)
        by_sequence[r.sequence_id].append(r)
    for (doc_id, n), pieces in by_doc.items():
        same = [i for (d, _), i in zip(docs, ids) if d == doc_id and len(i) == n]
        cover = [sum(p.start <= k < p.start + p.length for p in pieces) for k in (0, n // 2, n - 1)]
        assert same and cover == [len(same)] * 3 and sum(p.length for p in pieces) == n * len(same)
        for p in pieces:
            assert p.ids_crc32 in {zlib.crc32(np.array(i[p.start:p.start + p.length], "<u4").tobytes()) for i in same}
    assert sum(r.length for r in rows) == sum(map(len, ids))
    for pieces in by_sequence.values():
        pieces.sort(key=lambda p: p.offset)
        assert [p.offset for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
        context = pieces[0].context
        assert {p.context for p in pieces} == {context} and sum(p.length for p in pieces) == context <= tiers[-1]
        assert context & (context - 1) == 0


def test_pieces_of_the_whole_table(spark, tmp_path):
    r = random.Random(2)
    texts = [h.prose(r.choice([0, 1, 5, 30, 90, 200, 700, 3000]), i) for i in range(300)]
    docs = h.documents(spark, texts).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    check_pieces(op11_packing(spark, str(tmp_path)).collect(), list(enumerate(texts)))


def test_awkward_documents(spark):
    df = h.awkward(spark)
    docs = [(r.doc_id, r.text) for r in df.collect()]
    rows = packing.pack(h.clashing(df.withColumnRenamed("doc_id", "key")), PATH, id_col="key", keep_ids=True).collect()
    assert sum(r.length for r in rows) == sum(len(i) + 1 for i in library_ids([t or "" for _, t in docs]))
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    assert sorted({r.doc_id for r in rows if r.doc_id is not None}) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert sum(r.doc_id is None and r.start == 0 for r in rows) == 2
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_pools_keep_what_does_not_fill_a_window(monkeypatch):
    r = random.Random(1)
    packer, rows, sizes = packing.Packer((64, 128, 256), 7), [], []
    for doc in range(400):
        sizes.append(r.choice([1, 3, 40, 100, 200, 255, 256, 700]))
        packer.add(doc, np.full(sizes[-1], doc, "<u4").tobytes())
        if doc % 50 == 49:
            rows += packer.pack(last=False)
            assert packer.held < 256
    rows += packer.pack(last=True)
    covered = defaultdict(list)
    for doc, start, length, _, total, *_ in rows:
        covered[doc] += range(start, start + length)
        assert total == sizes[doc]
    assert all(sorted(covered[d]) == list(range(n)) for d, n in enumerate(sizes))


def test_gaps_are_filled_from_shorter_tiers_before_anything_is_cut():
    pieces = [(0, 0, 900), (1, 0, 100), (2, 0, 24), (3, 0, 500), (4, 0, 12)]
    windows, left = packing.fill_windows(pieces, packing.TIERS)
    assert windows == [(1024, [(0, 0, 900), (1, 0, 100), (2, 0, 24)]), (512, [(3, 0, 500), (4, 0, 12)])] and left == []
    windows, left = packing.fill_windows([(0, 0, 900), (1, 0, 800)], packing.TIERS)
    assert windows == [(1024, [(0, 0, 900), (1, 0, 124)])] and left == [(1, 124, 676)]
    assert [s for s, _ in packing.binary_rest(left)] == [512, 128, 32, 4]


def test_steps_are_of_one_context_and_even_cost():
    r = random.Random(3)
    sequences = []
    for i in range(640):
        cut = r.randrange(1, 1024)
        sequences.append((1024, [(i, 0, cut), (i, cut, 1024 - cut)]))
    sequences += [(64, [(1000 + i, 0, 64)]) for i in range(300)]
    steps = packing.balance(sequences, 1 << 14)
    assert sum(map(len, steps)) == 940 and all(len({c for c, _ in s}) == 1 for s in steps)
    costs = [sum(n * n for _, ps in s for _, _, n in ps) for s in steps if s[0][0] == 1024]
    assert len(costs) == 40 and max(costs) < 1.03 * min(costs)


def test_contexts_have_to_be_powers_of_two(spark):
    with pytest.raises(ValueError):
        packing.pack(h.documents(spark, ["a"]), PATH, tiers=(100, 1024))
