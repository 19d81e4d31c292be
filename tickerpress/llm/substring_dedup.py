"""Removal of repeated word windows, found through recompression symbols.

1. Every window is named by a symbol that its own words determine, so equal
   windows carry equal symbols; neighbouring windows with one symbol are a run
   (some 7 windows).  One shuffle by symbol finds the runs whose symbol occurs again.
2. Runs with equal symbol and equal words are settled together: the earliest stays.
3. Where one symbol has runs of different words (the edges of a repeat, mere chance),
   the earliest run of each wording is compared window by window.
4. The removed windows of a document meet its text, and the words they cover go.

Words are compared by 128 bits: the hash of the symbol's interval and that of the
run, or two hashes of a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerpress.llm.recompression import U, anchors, mix, spans, word_names
from tickerpress.session import write_through

WINDOW = 20
#: Words that a task looks at together; a longer document is cut, windows overlapping.
TOGETHER = 150_000
_RUN = "symbol long, wording long, doc long, tie int, lo int, n int"
#: Ids sort nulls last.
_LAST = 2**63 - 1


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc, tie, spans): the removed windows of each document that has any.

    ``spans`` lists (lo, n): the windows that start at word lo .. lo+n-1.  ``doc`` is the
    id, the largest long for a null; ``tie`` tells rows apart that share an id but not their
    text, and equal windows of such rows are ordered by start, then by ``tie``.  Rows with
    equal id and text are one document.
    """
    texts = _keyed(docs, id_col, text_col)
    runs = texts.mapInArrow(_runs_of(window), _RUN + ", state int")
    # Runs whose symbol the task itself has met twice need no partner: only one of them goes
    # to its symbol's partition, so a passage that all documents share makes no large group.
    target = F.when(F.col("state") < 2, F.col("symbol")).otherwise(F.xxhash64("doc", "tie", "lo"))
    met = write_through(runs.repartition(target).sortWithinPartitions("symbol").mapInArrow(_again, _RUN), "repeat-runs")
    place = F.struct("doc", "lo", "tie")
    wordings = write_through(met.groupBy("symbol", "wording", "n").agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("times")), "repeat-wordings")
    keys = ["symbol", "wording", "n"]
    later = (met.join(wordings.where("times > 1").select(*keys, "first"), keys)
             .where(place > F.col("first")).select("doc", "tie", "lo", "n"))
    several = write_through(wordings.groupBy("symbol").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
                            .select("symbol"), "repeat-symbols")
    unsure = (wordings.join(several, "symbol").select("first.*", "n")
              .groupBy("doc", "tie").agg(F.collect_list(F.struct("lo", "n")).alias("spans")))
    windows = write_through(texts.join(unsure, ["doc", "tie"]).mapInArrow(
        _windows_of(window), "a long, b long, doc long, tie int, lo int"), "repeat-windows")
    least = write_through(windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times"))
                          .where("times > 1").select("a", "b", "first"), "repeat-firsts")
    one = (windows.join(least, ["a", "b"]).where(place > F.col("first"))
           .select("doc", "tie", "lo", F.lit(1).alias("n")))
    return later.unionByName(one).groupBy("doc", "tie").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (the words left, joined by a space), kept_sha256.

    Words are runs without ASCII white space, unchanged.  A word goes if a window over it
    starts earlier too (smaller id, or same document and earlier start); windows are judged on
    the input.  Null and empty texts have no words and an empty ``kept``; texts shorter than a
    window lose nothing; an empty table gives no rows.  For rows that share an id see `find_repeats`.
    """
    removed = write_through(find_repeats(docs, id_col, text_col, window), "repeat-spans")
    texts = _keyed(docs, id_col, text_col).withColumn("doc_id", F.when(F.col("known"), F.col("doc")))
    return texts.join(removed, ["doc", "tie"], "left").mapInArrow(
        _cut(window), "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated words gone from the texts; a text that loses none stays as it is.

    A column ``n_chars`` is counted anew for the texts that change.
    """
    removed = write_through(find_repeats(docs, id_col, text_col, window), "repeat-spans")
    key = _key_columns(id_col, text_col)
    rows = docs.select(F.struct("*").alias("row"), key["doc"].alias("doc"), key["tie"].alias("tie"))
    text, spans_ = F.col("row")[text_col], F.col("spans")
    out = rows.join(removed, ["doc", "tie"], "left").select(
        "row", spans_.isNotNull().alias("changed"),
        F.when(spans_.isNull(), text).otherwise(_cut_text(window)(text, spans_)).alias("cut"))
    columns = {c: F.col("row")[c].alias(c) for c in docs.columns} | {text_col: F.col("cut").alias(text_col)}
    if "n_chars" in docs.columns:
        counted = F.when(F.col("changed"), F.length("cut").cast(docs.schema["n_chars"].dataType))
        columns["n_chars"] = counted.otherwise(F.col("row")["n_chars"]).alias("n_chars")
    return out.select(*[columns[c] for c in docs.columns])


def _key_columns(id_col: str, text_col: str) -> dict:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return {"doc": F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)),
            "tie": F.xxhash64(text).bitwiseAND(0x7FFFFFFF).cast("int")}


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key = _key_columns(id_col, text_col)
    return docs.select(key["doc"].alias("doc"), key["tie"].alias("tie"), F.col(id_col).isNotNull().alias("known"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _pieces(batch: pa.RecordBatch, window: int) -> Iterator[tuple[list, list[bytes]]]:
    """Lists of (row, offset, words) of about ``TOGETHER`` words, with their words laid end to end."""
    held, words = [], []
    texts = batch.column("text")
    for row in range(batch.num_rows):
        all_words = texts[row].as_py().encode().split()
        for offset in range(0, max(1, len(all_words) - window + 1), TOGETHER):
            part = all_words[offset:offset + TOGETHER + window - 1] if len(all_words) > TOGETHER else all_words
            if len(part) < window:
                continue
            held.append((row, offset, len(part)))
            words += part
            if len(words) >= TOGETHER:
                yield held, words
                held, words = [], []
    if held:
        yield held, words


def _runs_of(window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, ties = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
            for held, words in _pieces(batch, window):
                row, offset, counts = map(np.array, zip(*held))
                names = word_names(words)
                head, n, left, right, rnd = anchors(names, counts, window)
                one, two = spans(names)
                symbol = mix(one(left, right) + rnd.astype(U))
                wording = two(head, head + n + window - 1)
                piece = np.searchsorted(np.cumsum(counts), head, "right")
                lo = head - (np.cumsum(counts) - counts)[piece] + offset[piece]
                _, first, inverse, times = np.unique(symbol, return_index=True, return_inverse=True, return_counts=True)
                state = np.where(times[inverse] > 1, 2, 0)
                state[first[times > 1]] = 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(symbol.view(np.int64)), pa.array(wording.view(np.int64)), pa.array(docs[row[piece]]),
                     pa.array(ties[row[piece]]), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)),
                     pa.array(state.astype(np.int32))],
                    ["symbol", "wording", "doc", "tie", "lo", "n", "state"])
    return work


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of their symbols, those whose symbol comes again or is known to."""
    held, before = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        symbol, state = batch.column("symbol").to_numpy(), batch.column("state").to_numpy()
        same = symbol[1:] == symbol[:-1]
        again = np.r_[False, same] | np.r_[same, False] | (state > 0)
        again[0] |= symbol[0] == before
        if held is not None and held.column("symbol")[0].as_py() == symbol[0]:
            yield _plain(held)
        last, held, before = len(symbol) - 1, None, symbol[-1]
        if not again[last]:  # the next batch may begin with its partner
            held = batch.slice(last)
        yield _plain(batch.filter(pa.array(again)))


def _plain(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.select(["symbol", "wording", "doc", "tie", "lo", "n"])


def _windows_of(window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                words = batch.column("text")[row].as_py().encode().split()
                one, two = spans(word_names(words))
                at = _starts(batch.column("spans")[row])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one(at, at + window).view(np.int64)), pa.array(two(at, at + window).view(np.int64)),
                     pa.array(np.full(len(at), batch.column("doc")[row].as_py())),
                     pa.array(np.full(len(at), batch.column("tie")[row].as_py(), dtype=np.int32)),
                     pa.array(at.astype(np.int32))], ["a", "b", "doc", "tie", "lo"])
    return work


def _starts(spans_: pa.Scalar) -> np.ndarray:
    lo, n = _lists(spans_)
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _lists(spans_: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    values = spans_.values
    return (values.field("lo").to_numpy(zero_copy_only=False).astype(np.int64),
            values.field("n").to_numpy(zero_copy_only=False).astype(np.int64))


def _gone(n_words: int, lo: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Which words some window that starts in [lo, lo+n) covers."""
    edge = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, lo + n + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                kept, n_words, n_removed = [], [], []
                for text, spans_ in zip(part.column("text"), part.column("spans")):
                    words = text.as_py().encode().split()
                    n_words.append(len(words))
                    if spans_.is_valid:
                        gone = _gone(len(words), *_lists(spans_), window)
                        words = [w for w, g in zip(words, gone.tolist()) if not g]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                     pa.array(kept, pa.binary()).cast(pa.string()),
                     pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])
    return work


def _cut_text(window: int):
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def cut(texts: pa.Array, spans_: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts, spans_):
            if not text.is_valid or not found.is_valid:
                out.append(text.as_py())
                continue
            words = text.as_py().encode().split()
            gone = _gone(len(words), *_lists(found), window)
            out.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode())
        return pa.array(out, pa.string())

    return cut
