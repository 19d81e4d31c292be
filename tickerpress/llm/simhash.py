"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts (0, 1 or 2) of its 32 two-bit
segments.  The Manhattan distance of two such vectors never exceeds the Hamming
distance of the fingerprints, so links lie within Manhattan distance 3.  The
grid: the 32 dimensions form 6 groups, and since 3 differing counts touch 3
groups at most, two linked vectors share the cell of 3 whole groups in one of 20
ways.  Inside a cell the Manhattan bound is tested first, then the fingerprints.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerpress.functions import text as tx
from tickerpress.llm.components import components
from tickerpress.llm.remembered import forget
from tickerpress.session import write_through

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Groups of dimensions for the grid (6, 6, 5, 5, 5 and 5 segments).
GROUPS = 6
#: A cell with more fingerprints is compared in blocks over several tasks.
CELL = 2048
#: Bytes of a text split at a time, and hashes counted at a time.
SLICE, HASHES = 1 << 20, 200_000
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LOW = np.uint64(0x5555555555555555)


def fingerprint(texts: Iterable[str | None]) -> np.ndarray:
    """64-bit SimHash of each text (uint64).

    A-Z are lower-cased, words are runs without ASCII white space, shingles are 3
    words joined by a space, repeats included; fewer words make one shingle.  A
    bit is set if it is set in over half of the shingles' XXH64.  No words (or a
    null text): zero.  Bits are counted some ``HASHES`` at a time, so a long text
    takes little more memory than its own bytes.
    """
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    owners: list[tuple[int, int]] = []
    # Per flush: text, shingles, set bits; a text of several flushes has several rows.
    counted = [np.empty((0, 66), dtype=np.int64)]

    def flush():
        who, n = np.array(owners).T
        x, starts = np.array(hashes, dtype=np.uint64), np.cumsum(n) - n
        # Bit by bit: all bits of all hashes at once take 64 numbers a hash.
        ones = [np.add.reduceat(x >> np.uint64(bit) & np.uint64(1), starts).astype(np.int64) for bit in range(64)]
        counted.append(_by_first(np.column_stack([who, n, *ones])))
        hashes.clear()
        owners.clear()

    rows = 0
    for text in texts:
        for words in _slices((text or "").encode()):
            line = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            begins = np.r_[0, ends[:-1] + 1]
            n = max(1, len(words) - SHINGLE + 1)
            last = ends[SHINGLE - 1:] if len(words) >= SHINGLE else ends[-1:]
            owners.append((rows, n))
            hashes += [digest(line[a:b], SEED) for a, b in zip(begins[:n].tolist(), last.tolist())]
            if len(hashes) >= HASHES:
                flush()
        rows += 1
    if hashes:
        flush()
    out = np.zeros(rows, dtype=np.uint64)
    total = _by_first(np.concatenate(counted))
    if len(total):
        bits = np.packbits(2 * total[:, 2:] > total[:, 1:2], axis=1, bitorder="little")
        out[total[:, 0]] = bits.view("<u8")[:, 0]
    return out


def _by_first(rows: np.ndarray) -> np.ndarray:
    """Sums of the other columns over runs of equal first columns."""
    if not len(rows):
        return rows
    first = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
    return np.column_stack([rows[first, 0], np.add.reduceat(rows[:, 1:], first, axis=0)])


def _slices(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased, in lists that repeat the last ``SHINGLE - 1`` words of the one before.

    So every run of ``SHINGLE`` words lies in exactly one list; fewer words in all make one list.
    """
    words: list[bytes] = []
    start, yielded = 0, False
    while start < len(raw):
        cut = _SPACE.search(raw, start + SLICE)
        stop = cut.start() if cut else len(raw)
        words += raw[start:stop].translate(_LOWER).split()
        start = stop
        if len(words) >= SHINGLE:
            yield words
            words, yielded = words[1 - SHINGLE:], True
    if words and not yielded:
        yield words


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, print): the fingerprint as a signed long, one row per row of ``docs``; with ``digest`` that of the text, too."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       *([tx.digest(F.col(text_col)).alias("digest")] if digest else []))
    kept = [c for c in rows.columns if c != "text"]
    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept), "print long"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            prints = fingerprint(x.as_py() for x in batch.column("text")).view(np.int64)
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(prints, pa.int64())], [*kept, "print"])

    return rows.mapInArrow(work, schema)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    Fingerprints link at 3 or fewer differing bits; component_id is the smallest
    id reachable through links, the row's own included.  All texts without words
    share fingerprint zero.  Rows that repeat an id are each listed; null ids are
    never the smallest (a component of null ids only has a null id).  An empty
    table gives no rows.  Texts of any length are read whole, in slices.
    """
    return _named(fingerprints(docs, id_col, text_col)).select("doc_id", _hex("print").alias("fingerprint"), "component_id")


def _named(prints: DataFrame) -> DataFrame:
    """The rows with ``doc_id`` and ``print``, and their component_id."""
    rows = write_through(prints, "prints")
    known = write_through(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct-prints")
    of = components(links(known.select("print")))
    known = known.join(of, known["print"] == of["node"], "left").select(
        "print", "least", F.coalesce("component", "print").alias("root"))
    known = write_through(known, "rooted-prints")
    roots = write_through(known.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    named = write_through(known.join(roots, "root").select("print", "component_id"), "named-prints")
    return rows.join(named, "print")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest, all columns.

    Each row is judged by its own id and text: rows that repeat an id stay or go apart if their texts
    differ.  Null ids stay only in a component that has no other.
    """
    # The text of equal ids tells their rows apart; its digest goes with the fingerprint, so that texts go to Python once.
    found = _named(fingerprints(docs, id_col, text_col, digest=True))
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "digest").distinct()
    # Written first: few are broadcast by their known size, and no text is shuffled.
    gone = write_through(gone, "copies")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), tx.digest(F.col(text_col)).alias("own"))
    same = rows["id"].eqNullSafe(gone["doc_id"]) & rows["own"].eqNullSafe(gone["digest"])
    return rows.join(gone, same, "left_anti").select("row.*")


def _hex(column):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def links(prints: DataFrame) -> DataFrame:
    """(a, b) longs whose components are those of all links between distinct ``print`` values.

    Each cell gives a star for every component inside it, never all pairs.
    """
    cells = write_through(prints.mapInPandas(_cells, "cell long, print long"), "cells")
    crowds = write_through(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL)
                           .select(F.col("cell").alias("crowd"), F.ceil(F.col("n") / CELL).alias("parts")), "crowds")
    spread = cells.join(crowds, cells["cell"] == crowds["crowd"], "left")
    part = F.pmod(F.xxhash64("print"), F.col("parts"))
    # A crowded cell meets in pairs of parts; every other cell is the pair (0, 0).
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long")))
                      .otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    spread = (spread.select("cell", "print", F.coalesce(part, F.lit(0)).cast("int").alias("part"), other.alias("other"))
              .select("cell", "print", "part", F.least("part", "other").cast("int").alias("x"),
                      F.greatest("part", "other").cast("int").alias("y")))
    keys = ["cell", "x", "y"]
    return (spread.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_stars, "a long, b long").distinct())


def thermometer(prints: np.ndarray) -> np.ndarray:
    """Segment counts, coded so that the bits in which two codes differ are their Manhattan distance."""
    x = prints.astype(np.uint64)
    return ((x | x >> np.uint64(1)) & _LOW) | ((x & x >> np.uint64(1) & _LOW) << np.uint64(1))


def _group_masks() -> list[np.uint64]:
    per = np.array_split(np.arange(32), GROUPS)
    return [np.uint64(sum(3 << (2 * int(i)) for i in g)) for g in per]


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    masks = _group_masks()
    for batch in batches:
        code = thermometer(batch["print"].to_numpy().view(np.uint64))
        for number, groups in enumerate(combinations(masks, GROUPS - DISTANCE)):
            mask = np.bitwise_or.reduce(np.array(groups))
            # Different cells of one hash would only be compared in vain.
            cell = _mix((code & mask) ^ _mix(np.full(1, number + 1, dtype=np.uint64)))
            yield pd.DataFrame({"cell": cell.view(np.int64), "print": batch["print"]})


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        keys = rows[["cell", "x", "y"]].to_numpy()
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        # The last cell may go on in the next batch; a cell has 2 CELL rows or so at most.
        done = int(cuts[-1]) if len(cuts) else 0
        rest = rows.iloc[done:].reset_index(drop=True)
        yield from _stars_of(rows.iloc[:done], cuts[:-1])
    if rest is not None:
        yield from _stars_of(rest, np.empty(0, dtype=np.int64))


def _stars_of(rows: pd.DataFrame, cuts: np.ndarray) -> Iterator[pd.DataFrame]:
    prints, part = rows["print"].to_numpy(), rows["part"].to_numpy()
    x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
    starts, ends = np.r_[0, cuts], np.r_[cuts, len(rows)]
    many = ends - starts > 1
    a, b = [], []
    for s, e in zip(starts[many].tolist(), ends[many].tolist()):
        own = prints[s:e].view(np.uint64)
        near = np.bitwise_count(_pairwise(thermometer(own))) <= DISTANCE
        if near.sum() == e - s:
            continue
        near &= np.bitwise_count(_pairwise(own)) <= DISTANCE
        if x[s] != y[s]:
            near &= part[s:e][:, None] != part[s:e][None, :]
        star = _components(near)
        linked = star != np.arange(e - s)
        a.append(own.view(np.int64)[linked])
        b.append(own.view(np.int64)[star[linked]])
    if a:
        yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})


def _pairwise(x: np.ndarray) -> np.ndarray:
    return x[:, None] ^ x[None, :]


def _components(near: np.ndarray) -> np.ndarray:
    """The least index that each index reaches over a small adjacency matrix."""
    np.fill_diagonal(near, True)
    label = np.arange(len(near))
    while True:
        least = np.where(near, label[None, :], len(near)).min(axis=1)
        least = least[least]
        if (least == label).all():
            return label
        label = least
