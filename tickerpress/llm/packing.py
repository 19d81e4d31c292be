"""Hierarchical packing of documents into sequences of several context sizes.

Whole windows of the largest context are cut off a document first.  What remains of it is
routed to the tier of the smallest context that holds it.  Tiers are packed from the largest down: a
window opens with the longest piece left, and its gap is filled with the longest pieces
of shorter tiers that fit, then, if none does, with a part of one that is cut to size.  Sequences are dealt to
step groups of one context size and equally many tokens, so that the attention cost of the
steps of a tier is nearly even.

Every window ends up full.  A task's last pieces, fewer tokens than a window, are cut at the
binary digits of their sum into sequences of 1, 2, 4, ... tokens, so nothing is padded at all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerpress.llm.byte_encoder import SLICE, byte_encoder

#: Context sizes, powers of two.
TIERS = (64, 128, 256, 512, 1024)
#: Tokens packed together, and tokens of a step group.
POOL, STEP = 1 << 21, 1 << 14
#: Room for the sequences and steps of one task in their numbers.
_TASK = 1 << 40
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context int, "
          "step long")
Piece = tuple[int, int, int]  # document, start, length


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id",
         text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents and their places: the columns of ``PIECES``, and ids (binary) if kept.

    A document is its ids and the end id.  Pieces of one sequence have its sequence_id and follow each other by
    offset; the pieces' lengths add up to ``context``, a power of two, and pieces of one step are of
    one context.  Numbers are unique but not gapless.

    Each input split is packed on its own, without a shuffle, ``POOL`` tokens at a time, so
    one task holds no more than a pool and one document.  Null and empty texts are an end id alone; null
    ids stay null, and rows that share an id are documents of their own.  A text of any
    length is encoded in slices.  An empty table gives no pieces.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("context sizes are ascending powers of two")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    end = np.array([end_id], dtype="<u4").tobytes()
    names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * keep_ids
    types = [pa.int64()] * 7 + [pa.int32(), pa.int64()] + [pa.binary()] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = byte_encoder(tokenizer), Packer(tiers, TaskContext.get().partitionId() * _TASK, keep_ids)
        for batch in batches:
            for ids, texts in _slices(batch):
                raws = [encoder.encode_long(texts[0])] if len(texts) == 1 else encoder.encode(texts)
                for doc_id, raw in zip(ids, raws):
                    packer.add(doc_id, raw + end)
                if packer.held >= POOL:
                    yield _batch(packer.pack(last=False), types, names)
        yield _batch(packer.pack(last=True), types, names)

    return rows.mapInArrow(run, PIECES + (", ids binary" if keep_ids else ""))


def _batch(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """A batch's rows in slices of about ``SLICE`` characters; a longer text comes alone."""
    ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
    start, held, size = 0, [], 0
    for row in range(len(ids)):
        text = texts[row].as_py()
        if held and size + len(text) > SLICE:
            yield ids[start:row], held
            start, held, size = row, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield ids[start:], held


class Packer:
    """Holds documents of a task and packs them a pool at a time."""

    def __init__(self, tiers: tuple[int, ...], first_number: int, keep_ids: bool = False):
        self.tiers, self.window, self.keep_ids = tiers, tiers[-1], keep_ids
        self.docs: list[tuple[int | None, bytes]] = []
        self.pieces: list[Piece] = []
        self.whole: list[Piece] = []
        self.held, self.number, self.step = 0, first_number, first_number

    def add(self, doc_id: int | None, raw: bytes) -> None:
        doc, tokens = len(self.docs), len(raw) // 4
        self.docs.append((doc_id, raw))
        cut = tokens - tokens % self.window
        self.whole += [(doc, at, self.window) for at in range(0, cut, self.window)]
        if tokens > cut:
            self.pieces.append((doc, cut, tokens - cut))
        self.held += tokens

    def pack(self, last: bool) -> list[tuple]:
        """Rows of all full windows; pieces of a window that stays open wait for the next pool, unless it is the last."""
        sequences = [(self.window, [p]) for p in self.whole]
        packed, left = fill_windows(self.pieces, self.tiers)
        sequences += packed
        if last:
            sequences += binary_rest(left)
            left = []
        rows: list[tuple] = []
        for group in balance(sequences, STEP):
            for context, pieces in group:
                rows += self._rows(pieces, context)
                self.number += 1
            self.step += 1
        self._keep(left)
        return rows

    def _rows(self, pieces: list[Piece], context: int) -> Iterator[tuple]:
        offset = 0
        for doc, start, length in pieces:
            doc_id, raw = self.docs[doc]
            ids = raw[4 * start:4 * (start + length)]
            yield (doc_id, start, length, zlib.crc32(ids), len(raw) // 4, self.number, offset, context, self.step, *([ids] * self.keep_ids))
            offset += length

    def _keep(self, left: list[Piece]) -> None:
        docs: dict[int, int] = {}
        for doc, _, _ in left:
            docs.setdefault(doc, len(docs))
        self.docs = [self.docs[d] for d in docs]
        self.pieces = [(docs[d], s, n) for d, s, n in left]
        self.whole, self.held = [], sum(n for _, _, n in left)


class _Lengths:
    """Pieces by length, with the lengths at hand as bits of a number."""

    def __init__(self, pieces: list[Piece]):
        self.by: dict[int, list[Piece]] = {}
        self.bits = 0
        for piece in pieces:
            self.put(piece)

    def put(self, piece: Piece) -> None:
        self.by.setdefault(piece[2], []).append(piece)
        self.bits |= 1 << piece[2]

    def take(self, length: int) -> Piece:
        held = self.by[length]
        piece = held.pop()
        if not held:
            self.bits &= ~(1 << length)
        return piece

    def longest(self, most: int) -> int:
        """The longest length up to ``most``, 0 if none."""
        return (self.bits & ((1 << (most + 1)) - 1)).bit_length() - 1 if self.bits & ((1 << (most + 1)) - 1) else 0

    def shortest(self, least: int) -> int:
        above = self.bits >> least
        return least + (above & -above).bit_length() - 1 if above else 0


def fill_windows(pieces: list[Piece], tiers: tuple[int, ...]) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Full windows (context, pieces), and the pieces of the one that could not be filled."""
    lengths, out = _Lengths(pieces), []
    while lengths.bits:
        first = lengths.longest(tiers[-1])
        context = next(t for t in tiers if t >= first)
        window, gap = [lengths.take(first)], context - first
        while gap and lengths.bits:
            fits = lengths.longest(gap)
            if fits:
                window.append(lengths.take(fits))
                gap -= fits
                continue
            doc, start, length = lengths.take(lengths.shortest(gap))
            window.append((doc, start, gap))
            lengths.put((doc, start + gap, length - gap))  # routed again, by what is left of it
            gap = 0
        if gap:
            return out, window
        out.append((context, window))
    return out, []


def binary_rest(pieces: list[Piece]) -> list[tuple[int, list[Piece]]]:
    """Sequences of powers of two tokens, the largest first, that hold the pieces exactly."""
    total, queue, out = sum(n for _, _, n in pieces), list(pieces)[::-1], []
    for bit in reversed(range(total.bit_length())):
        room, sequence = total & (1 << bit), []
        size = room
        while room:
            doc, start, length = queue.pop()
            part = min(length, room)
            sequence.append((doc, start, part))
            if part < length:
                queue.append((doc, start + part, length - part))
            room -= part
        if sequence:
            out.append((size, sequence))
    return out


def balance(sequences: list[tuple[int, list[Piece]]], step_tokens: int) -> list[list[tuple[int, list[Piece]]]]:
    """Deal sequences to steps: one context a step, costly sequences dealt to and fro."""
    by_context: dict[int, list] = {}
    for sequence in sequences:
        by_context.setdefault(sequence[0], []).append(sequence)
    out = []
    for context in sorted(by_context, reverse=True):
        group = sorted(by_context[context], key=lambda s: -sum(n * n for _, _, n in s[1]))
        steps = -(-len(group) * context // step_tokens)
        dealt = [group[i::2 * steps] + group[2 * steps - 1 - i::2 * steps] for i in range(steps)]
        out += [d for d in dealt if d]
    return out
