"""Leading singular vectors of a tall matrix whose rows are sparse vectors.

A randomised range finder: a random block of columns is grown into a Krylov basis of
the Gram matrix, each block one pass over the rows, and restarted from its best
directions when it is full.  The last basis meets the rows in a tall-skinny QR.  Memory
is terms x rank on the driver and in every task, never terms x terms.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a block as a multiple of the rank and beyond it (wide blocks need fewer passes), blocks
#: in a full basis and blocks kept at a restart.
WIDE, EXTRA, FULL, KEPT = 3, 10, 6, 2
#: Residual of a pair, as a share of the largest eigenvalue, at which it is settled, and passes at most.
TOLERANCE, PASSES = 1e-10, 120
#: Entries of a dense slice of rows, and of one row of partial sums.
SLICE, PART = 1 << 20, 1 << 16
#: Triangles that one task or the driver folds into one.
FAN = 64


def leading_pairs(rows: DataFrame, n_terms: int, rank: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (terms x rank) and singular values, largest first.

    ``rows`` has the columns ``idx`` and ``val``, arrays of a row's columns and values; it is
    read once per pass, so write it first.  A matrix of lower rank gets zeros as its last
    values; no rows at all give zeros throughout.
    """
    width = min(WIDE * rank + EXTRA, n_terms)
    fresh = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_terms, width)))[0]
    basis = image = np.empty((n_terms, 0))
    for _ in range(PASSES):
        basis, image = np.hstack([basis, fresh]), np.hstack([image, gram_times(rows, fresh)])
        values, turn = _falling(basis.T @ image)
        best, seen = basis @ turn[:, :width], image @ turn[:, :width]
        left = seen - best * values[:width]
        off = np.linalg.norm(left, axis=0)
        if off[:rank].max() <= TOLERANCE * abs(values[0]):
            break
        if basis.shape[1] + width > FULL * width:
            basis, image = (m @ turn[:, :KEPT * width] for m in (basis, image))
        fresh = _new_directions(left[:, off > 0.1 * TOLERANCE * abs(values[0])], basis)
        if not fresh.shape[1]:
            break
    else:
        warnings.warn(f"singular vectors settled to {off[:rank].max() / abs(values[0]):.1e} only", stacklevel=2)
    _, sizes, turn = np.linalg.svd(_square(triangle(rows, best), width))
    return best @ turn[:rank].T, sizes[:rank]


def gram_times(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """The rows' Gram matrix times a block of columns, in one pass.

    A task folds its rows into one partial product; the partials are summed piece by piece
    in a hash aggregate with map-side combine.
    """
    n_terms, width = block.shape
    step = max(1, PART // width)
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n_terms, width))
        for dense in _slices(batches, n_terms):
            total += dense.T @ (dense @ shared.value)
        starts = range(0, n_terms, step)
        yield pd.DataFrame({"first": list(starts), "sums": [total[i:i + step].ravel() for i in starts]})

    parts = rows.select("idx", "val").mapInPandas(partials, "first int, sums array<double>")
    summed = parts.groupBy("first").agg(Summarizer.sum(array_to_vector("sums")).alias("sums"))
    out = np.zeros((n_terms, width))
    for part in summed.collect():  # terms x width numbers
        piece = part["sums"].toArray().reshape(-1, width)
        out[part["first"]:part["first"] + len(piece)] = piece
    shared.destroy()
    return out


def triangle(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """The triangular factor of the rows times ``basis``: a tall-skinny QR.

    Every task folds its rows into one small triangle; triangles meet in a tree.
    """
    n_terms, width = basis.shape
    shared = rows.sparkSession.sparkContext.broadcast(basis)
    schema = "part int, entries array<double>"

    def folded(blocks) -> np.ndarray:
        r = np.empty((0, width))
        for block in blocks:
            r = np.linalg.qr(np.vstack([r, block]), mode="r")
        return r.ravel()

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries = folded(dense @ shared.value for dense in _slices(batches, n_terms))
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "entries": [entries]})

    def merged(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("part")
        return pd.DataFrame({"part": parts["part"].iloc[:1] // FAN,
                             "entries": [folded(e.reshape(-1, width) for e in parts["entries"])]})

    sparse = rows.select("idx", "val")
    parts, left = sparse.mapInPandas(local, schema), sparse.rdd.getNumPartitions()
    while left > FAN:
        parts = parts.groupBy(F.floor(F.col("part") / F.lit(FAN))).applyInPandas(merged, schema)
        left = -(-left // FAN)
    last = folded(np.reshape(p["entries"], (-1, width)) for p in parts.orderBy("part").collect())
    shared.destroy()
    return last.reshape(-1, width)


def _slices(batches: Iterator[pd.DataFrame], n_terms: int) -> Iterator[np.ndarray]:
    """The rows as dense blocks of bounded size."""
    step = max(1, SLICE // n_terms)
    for batch in batches:
        for i in range(0, len(batch), step):
            idx, val = batch["idx"].to_numpy()[i:i + step], batch["val"].to_numpy()[i:i + step]
            dense = np.zeros((len(idx), n_terms))
            dense[np.repeat(np.arange(len(idx)), [len(x) for x in idx]), np.concatenate(idx)] = np.concatenate(val)
            yield dense


def _falling(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, turn = np.linalg.eigh((gram + gram.T) / 2)
    return values[::-1], turn[:, ::-1]


def _new_directions(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal columns for what of the block the basis does not span."""
    if not block.shape[1]:
        return block
    block = block / np.linalg.norm(block, axis=0)
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    left, sizes, _ = np.linalg.svd(block, full_matrices=False)
    left = left[:, sizes > 1e-8]
    return np.linalg.qr(left - basis @ (basis.T @ left))[0]


def _square(r: np.ndarray, width: int) -> np.ndarray:
    return np.vstack([r, np.zeros((width - len(r), width))])
