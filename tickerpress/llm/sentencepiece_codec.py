"""SentencePiece encoding and decoding on the tokenizers library.

The model file (a protobuf message) is read field by field; its pieces, scores,
normaliser, white space marker and byte pieces are rebuilt as a `Tokenizer`.  No
piece of a usual model has the marker behind another character, so nothing is
merged across the start of a run of spaces: a text's ids are those of its segments
(spaces and the word after them).  A task encodes each distinct segment
once, in multithreaded batches, and compares it with the SentencePiece library.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from tickerpress.llm.remembered import remembered

MARKER = "▁"
#: Kinds of pieces, and of models, in the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Segments in the younger half of a task's memory; when it is full, the older half goes.
REMEMBERED = 300_000


@dataclass(frozen=True)
class Model:
    """What the model file says: (piece, score, kind) by id, and the settings that matter."""

    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    fold_spaces: bool


def _fields(message: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """Field numbers and values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        wire = key & 7
        if wire == 0:
            value = varint()
        elif wire == 2:
            size = varint()
            value, at = message[at:at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = struct.unpack("<d" if wire == 1 else "<f", message[at:at + size])[0], at + size
        else:
            raise ValueError(f"wire type {wire} in a model file")
        yield key >> 3, value


def read_model(path: str) -> Model:
    with open(path, "rb") as file:
        message = file.read()
    pieces, trainer, normaliser = [], {}, {}
    for number, value in _fields(message):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append((piece[1].decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normaliser = dict(_fields(value))
    if trainer.get(3, UNIGRAM) not in (UNIGRAM, BPE) or trainer.get(24, 0) or any(k == USER for *_, k in pieces):
        raise ValueError("word and character models, markers as suffix and user-defined symbols are not supported")
    return Model(pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normaliser.get(2, b""),
                 bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)))


def rebuild(model: Model) -> Tokenizer:
    """The model as a `Tokenizer`: ``encode(text, add_special_tokens=False)`` and ``decode(ids)``."""
    ids = {piece: i for i, (piece, _, _) in enumerate(model.pieces)}
    unknown = next(i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN)
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unknown, model.byte_fallback)
    else:
        normal = {p: s for p, s, kind in model.pieces if kind == NORMAL}
        merges = [(-s, ids[p], p[:i], p[i:]) for p, s in normal.items() for i in range(1, len(p))
                  if p[:i] in normal and p[i:] in normal]
        core = models.BPE(ids, [(a, b) for _, _, a, b in sorted(merges)], unk_token=model.pieces[unknown][0],
                          fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    tokenizer.normalizer = normalizers.Sequence(
        _text_rules(model) + ([normalizers.Prepend(MARKER)] if model.dummy_prefix else [])
        + [normalizers.Replace(" ", MARKER)])
    steps = [decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence(steps + ([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []))
    return tokenizer


def _text_rules(model: Model) -> list:
    rules = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    return rules + ([normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")] if model.fold_spaces else [])


class Codec:
    """Ids and texts, segment by segment, with the parity of every new segment checked."""

    def __init__(self, path: str, threads: int = 2, verify: bool = True, most: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        model = read_model(path)
        self.prefix = model.dummy_prefix
        self.tokenizer = rebuild(model)
        rules = _text_rules(model)
        self.rules = normalizers.Sequence(rules) if rules else None
        # Segments come with their leading spaces.
        self.tokenizer.normalizer = normalizers.Replace(" ", MARKER)
        apart = all(MARKER not in piece.lstrip(MARKER) for piece, _, _ in model.pieces)
        self.cut = re.compile(" *[^ ]+| +").findall if apart and self.prefix else lambda text: [text]
        # The library can only be asked for what begins with its own prefix.
        self.library = sentencepiece.SentencePieceProcessor(model_file=path) if verify and self.prefix else None
        self.threads = threads
        self.bytes_of = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind in (CONTROL, UNKNOWN)
                         else p.replace(MARKER, " ").encode() for p, _, kind in model.pieces]
        self.most = most
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.differ: set[str] = set()

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Little-endian 32-bit ids of each text, and whether all its segments agree with the library.

        A segment on which the rebuilt tokenizer and the library differ gets the library's ids.
        """
        cut = [self.cut(self._prepared(t)) if t else [] for t in texts]
        self._learn({s for c in cut for s in c})
        find = self.known.__getitem__
        return ([b"".join(map(find, c)) for c in cut],
                [not self.differ or self.differ.isdisjoint(c) for c in cut])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode(errors="replace")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def _prepared(self, text: str) -> str:
        if self.rules:
            text = self.rules.normalize_str(text)
        text = text.replace(MARKER, " ")
        return " " + text if self.prefix and text else text

    def _learn(self, segments: set[str]) -> None:
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        new = segments.difference(self.known)
        self.known.update((s, self.older[s]) for s in new.intersection(self.older))
        new = list(new.difference(self.older))
        for at in range(0, len(new), 8192):
            part = new[at:at + 8192]
            found = [np.array(e.ids, dtype="<u4").tobytes()
                     for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            if self.library is not None:
                theirs = self.library.encode([s[1:] for s in part], num_threads=self.threads)
                for i, ids in enumerate(theirs):
                    # A lone space cannot be put to the library: it has no ids for an empty text.
                    if part[i] != " " and (raw := np.array(ids, dtype="<u4").tobytes()) != found[i]:
                        found[i] = raw
                        self.differ.add(part[i])
            self.known.update(zip(part, found))


def _codec(path: str, threads: int, verify: bool, most: int = REMEMBERED) -> Codec:
    """One per model and worker process, so that what a task has learnt serves the next."""
    return remembered(("sentencepiece", path, threads, verify, most), lambda: Codec(path, threads, verify, most))


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                  verify: bool = True, threads: int = 2, most: int = REMEMBERED) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids, n_tokens, decoded, round_trip, parity.

    ``round_trip`` says whether the decoded text equals the text (not so where the text
    holds the marker itself, which decodes to a space), ``parity`` whether the rebuilt tokenizer and
    the SentencePiece library agree on every segment (true if not verified).  Null texts
    count as empty and have no ids.  Rows are independent and keep ids that repeat or are null.
    ``most`` bounds the segments in the younger half of a worker's memory, of some 200 bytes each.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_path, threads, verify, most)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [t.as_py() or "" for t in part.column("text")]
                raw, parity = codec.encode(texts)
                counts = np.array([len(r) // 4 for r in raw], dtype=np.int64)
                decoded = [codec.decode(np.frombuffer(r, "<u4")) for r in raw]
                ids = pa.ListArray.from_arrays(
                    pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)),
                    pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), ids, pa.array(counts), pa.array(decoded, pa.string()),
                     pa.array([a == b for a, b in zip(texts, decoded)], pa.bool_()), pa.array(parity, pa.bool_())],
                    ["doc_id", "ids", "n_tokens", "decoded", "round_trip", "parity"])

    return rows.mapInArrow(work, f"doc_id {id_type}, ids array<int>, n_tokens long, decoded string, "
                                 "round_trip boolean, parity boolean")
