"""Shared steps of the vector operators: valid rows, distinct vectors, packed blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def is_valid(vector):
    """Not null, not empty, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def lengths(valid: DataFrame, column: str) -> list[int]:
    """The lengths that occur; vectors are compared within a length, so there is one run for each."""
    return sorted(r["n"] for r in valid.select(F.size(column).alias("n")).distinct().collect())


def matrix(column: pa.Array, size: int, dtype=np.float64) -> np.ndarray:
    """A list column without nulls as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, size)


BLOCK = "part int, seq int, grp long, n int, keys binary, weights binary, vectors binary"


def pack(rows: DataFrame, size: int, most: int) -> DataFrame:
    """Blocks of up to ``most`` neighbouring rows of one ``grp``, from ordered partitions.

    ``rows`` has grp, key, weight (longs) and vector (array<double>).  A block holds the keys and weights as
    64-bit integers and the vectors row by row, as 32-bit floats where that loses nothing, else 64-bit ones.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, group, count = TaskContext.get().partitionId(), 0, [], None, 0

        def out():
            keys, weights, vectors = (np.concatenate(x) for x in zip(*held))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([group], pa.int64()),
                 pa.array([len(keys)], pa.int32()), pa.array([keys.tobytes()]), pa.array([weights.tobytes()]),
                 pa.array([packed(vectors)])], ["part", "seq", "grp", "n", "keys", "weights", "vectors"])

        for batch in batches:
            if not batch.num_rows:
                continue
            groups, keys = batch.column("grp").to_numpy(), batch.column("key").to_numpy()
            weights, vectors = batch.column("weight").to_numpy(), matrix(batch.column("vector"), size)
            at = 0
            while at < len(keys):
                if held and (groups[at] != group or count >= most):
                    yield out()
                    seq, held, count = seq + 1, [], 0
                group = int(groups[at])
                to = at + int(np.argmax(np.r_[groups[at:] != group, True]))
                to = min(to, at + most - count)
                held.append((keys[at:to], weights[at:to], vectors[at:to]))
                count, at = count + to - at, to
        if held:
            yield out()

    return rows.select("grp", "key", "weight", "vector").mapInArrow(work, BLOCK)


def packed(vectors: np.ndarray) -> bytes:
    """The rows' bytes behind one that tells their width."""
    with np.errstate(over="ignore", invalid="ignore"):
        narrow = vectors.astype(np.float32)
    return b"\x04" + narrow.tobytes() if np.array_equal(narrow, vectors) else b"\x08" + vectors.tobytes()


def opened(vectors: bytes, n: int) -> np.ndarray:
    """Rows (float64) of ``packed`` vectors."""
    return np.frombuffer(vectors, np.float32 if vectors[0] == 4 else np.float64, offset=1).reshape(n, -1).astype(np.float64)


def unpacked(keys: bytes, weights: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, weights and vectors (float64) of a block."""
    k = np.frombuffer(keys, np.int64)
    return k, np.frombuffer(weights, np.int64), opened(vectors, len(k))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that products of their components neither overflow nor vanish."""
    _, exponent = np.frexp(np.abs(x).max(axis=1, initial=0.0))
    return np.ldexp(x, -exponent[:, None])
