"""Token ids in binary segments: bit or byte planes, compressed with zstandard, with a chunk index.

A segment holds whole documents in ascending id order.  Its ids are cut into
blocks of a fixed number of ids; a block is transposed so that equally
significant bytes (or bits) lie together, and every plane is one compressed chunk.

    magic "TKP1" | planes per id, bytes per plane unit | header as JSON, length first
    document ids (int64), null flags (uint8), id counts (int64), compressed
    chunk index: offset and length (uint64 pairs), block by block, plane by plane
    chunks

A reader that wants one block reads the index and that block's chunks only.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickerpress.session import write_through

MAGIC = b"TKP1"
#: Ids per block and per segment.  A document longer than a segment makes a longer one.
BLOCK, SEGMENT = 1 << 16, 1 << 20
#: Words in the younger half of a task's memory; when it is full, the older half goes.
REMEMBERED = 600_000
SEGMENTS = "part int, seq int, payload binary"
DOCUMENTS = "part int, doc_id long, at long, n_tokens long, ids_crc32 long"


def pack(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, planes: str = "byte",
         block: int = BLOCK) -> bytes:
    """One segment.  ``planes``: "byte" (4 an id) or "bit" (32 an id)."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    press = zstandard.ZstdCompressor(level=3).compress
    chunks, index, at = [], [], 0
    for start in range(0, len(ids), block):
        for plane in _split(ids[start:start + block], planes):
            chunks.append(press(plane))
            index += [at, len(chunks[-1])]
            at += len(chunks[-1])
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    table = press(np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + known.tobytes()
                  + np.array(counts, dtype="<i8").tobytes())
    head = json.dumps({"documents": len(doc_ids), "ids": len(ids), "block": block, "planes": planes,
                       "table": len(table), "chunks": len(chunks)}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, table,
                     np.array(index, dtype="<u8").tobytes(), *chunks])


def unpack(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, id counts and all ids of a segment."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token segment")
    (length,) = struct.unpack_from("<I", payload, 4)
    head = json.loads(payload[8:8 + length])
    open_, at = zstandard.ZstdDecompressor().decompress, 8 + length
    n = head["documents"]
    table = open_(payload[at:at + head["table"]])
    at += head["table"]
    doc_ids = np.frombuffer(table, "<i8", n).tolist()
    known = np.frombuffer(table, np.uint8, n, 8 * n)
    counts = np.frombuffer(table, "<i8", n, 9 * n)
    index = np.frombuffer(payload, "<u8", 2 * head["chunks"], at).reshape(-1, 2)
    at += 16 * head["chunks"]
    each = 4 if head["planes"] == "byte" else 32
    blocks = []
    for k, start in enumerate(range(0, head["ids"], head["block"])):
        planes = [open_(payload[at + int(o):at + int(o) + int(s)]) for o, s in index[k * each:(k + 1) * each]]
        blocks.append(_join(planes, min(head["block"], head["ids"] - start), head["planes"]))
    ids = np.concatenate(blocks) if blocks else np.empty(0, "<u4")
    return [d if k else None for d, k in zip(doc_ids, known)], counts, ids


def _split(ids: np.ndarray, planes: str) -> list[bytes]:
    as_bytes = ids.view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [np.ascontiguousarray(as_bytes[:, i]).tobytes() for i in range(4)]
    bits = np.unpackbits(as_bytes, axis=1, bitorder="little")
    return [np.packbits(bits[:, i]).tobytes() for i in range(32)]


def _join(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        as_bytes = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
        as_bytes = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(as_bytes).view("<u4").reshape(-1)


#: Latin letters (not the dotted capital I, whose lower case ends with a mark), then ASCII
#: signs but for the apostrophe, which begins endings such as 's.
_LETTERS = re.compile(r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+").fullmatch
_LETTERS_SIGNS = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+)([!-&(-/:-@\[-`{-~]+)").fullmatch


class WordEncoder:
    """Ids of texts, remembered word by word.

    For tokenizers that lower-case, and whose rules never look across a space, a line feed, or
    the seam of letters and signs: the ids of a text are then those of its words in a
    row.  Unknown words are encoded in one call: words of letters alone are told apart by the ids
    that end a word, others are parted by a special token.
    """

    def __init__(self, path: str, separator: str = "<|endoftext|>"):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.separator, self.separator_id = separator, self.tokenizer.token_to_id(separator)
        vocabulary = self.tokenizer.get_vocab()
        #: Ids that end a word, or a run of letters.
        self.ending = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ending[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        """Forgets at most between batches, so a batch finds all its words."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        self.known[""] = b""
        new = self._unknown(words)
        # Letters and the signs after them are never merged, so a word with signs needs no encoding of its own.
        parted = {w: (m[1].lower() if m[1].isascii() else m[1], m[2]) for w in new if (m := _LETTERS_SIGNS(w))}
        self._encode(self._unknown({x for parts in parted.values() for x in parts}.union(new.difference(parted))))
        find = self.known
        find.update([(w, find[a] + find[b]) for w, (a, b) in parted.items()])

    def _unknown(self, words: set[str]) -> set[str]:
        new = words.difference(self.known)
        # Not intersection(): that would walk the whole dictionary.
        old = {w: self.older[w] for w in new if w in self.older}
        self.known.update(old)
        return new.difference(old)

    def _encode(self, new: set[str]) -> None:
        odd = {w for w in new if any(s in w for s in self.special)}
        for w in odd:
            self.known[w] = _little(self.tokenizer.encode(w, add_special_tokens=False).ids)
        plain = [w for w in new - odd if _LETTERS(w)]
        for part, ids in self._joined(plain, " "):
            ends = np.flatnonzero(self.ending[ids]) + 1
            self._remember(part, ids, np.r_[0, ends[:-1]], ends)
        for part, ids in self._joined(list((new - odd).difference(plain)), f" {self.separator} "):
            cuts = np.flatnonzero(ids == self.separator_id)
            self._remember(part, ids, np.r_[0, cuts + 1], np.r_[cuts, len(ids)])

    def _joined(self, words: list[str], between: str) -> Iterator[tuple[list[str], np.ndarray]]:
        for start in range(0, len(words), 4096):
            part = words[start:start + 4096]
            yield part, np.array(self.tokenizer.encode_batch_fast([between.join(part)], add_special_tokens=False)[0].ids, dtype="<u4")

    def _remember(self, words: list[str], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        if len(starts) != len(words):
            raise AssertionError("words cannot be told apart")
        raw = ids.tobytes()
        self.known.update(zip(words, [raw[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist())]))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        words: set[str] = set()
        for s in split:
            words.update(s)
        self.learn(words)
        find = self.known.__getitem__
        return [b"".join(map(find, s)) for s in split]


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    """One per tokenizer and worker process, so that what a task has learnt serves the next."""
    return WordEncoder(path)


def _little(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def write_segments(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id",
                   text_col: str = "text", planes: str = "byte") -> DataFrame:
    """Encode all texts and write segments below ``path`` in ascending id order.

    ``docs`` is range-partitioned by id; each partition writes its segments, which
    carry the partition and a running number.  Spark's committer writes them (as the
    binary column of a Parquet table), so any store works and a lost executor
    leaves no half segment.  Null texts count as empty and still get the end id;
    null ids come first; repeated ids are kept, in the order of their texts' hashes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text")]  # the hash deals out a repeated or missing id
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    end = _little([end_id])

    def segments(batches: Iterator) -> Iterator[pd.DataFrame]:
        encoder, part, seq = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids, counts, held, size = [], [], [], 0

        def out():
            return pd.DataFrame({"part": [part], "seq": [seq], "payload": [
                pack(ids, counts, np.frombuffer(b"".join(held), "<u4"), planes)]})

        for batch in batches:
            for doc_ids, texts in _slices(batch):
                for doc_id, raw in zip(doc_ids, encoder.encode(texts)):
                    ids.append(doc_id)
                    held.append(raw + end)
                    counts.append(len(held[-1]) // 4)
                    size += counts[-1]
                    if size >= SEGMENT:
                        yield out()
                        seq, size = seq + 1, 0
                        ids, counts, held = [], [], []
        if ids:
            yield out()

    def arrow(batches):
        import pyarrow as pa
        for frame in segments(batches):
            yield pa.RecordBatch.from_pandas(frame, schema=pa.schema(
                [("part", pa.int32()), ("seq", pa.int32()), ("payload", pa.binary())]), preserve_index=False)

    ordered.mapInArrow(arrow, SEGMENTS).write.parquet(path)
    return spark.read.schema(SEGMENTS).parquet(path)


def _slices(batch, most: int = 2_000_000) -> Iterator[tuple[list, list[str]]]:
    """A batch's ids and texts in slices of about ``most`` characters."""
    doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
    start = 0
    while start < len(doc_ids):
        part, size = [], 0
        while start + len(part) < len(doc_ids) and size < most:
            part.append(texts[start + len(part)].as_py())
            size += len(part[-1])
        yield doc_ids[start:start + len(part)], part
        start += len(part)


def read_documents(segments: DataFrame) -> DataFrame:
    """Per document of the segments: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                doc_ids, counts, ids = unpack(bytes(row.payload))
                raw, ends = ids.tobytes(), np.cumsum(counts)
                yield pd.DataFrame({
                    "part": row.part, "seq": row.seq, "doc_id": pd.array(doc_ids, dtype="Int64"),
                    "at": ends - counts, "n_tokens": counts,
                    "ids_crc32": [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]})

    found = write_through(segments.mapInPandas(read, "part int, seq int, " + DOCUMENTS.removeprefix("part int, ")),
                          "token-documents")
    # One row per segment of a million ids; running sums inside a partition of the writer, then over its partitions.
    sums = found.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    totals = sums.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("parts_before"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, "part").select(
        "part", "seq", (F.col("before") + F.col("parts_before")).alias("before"))
    return found.join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
