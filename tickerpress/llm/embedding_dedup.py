"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors whose cosine is c lie sqrt(2 - 2c) apart.  Vectors are sorted by label and by
the grid cells (of that width) of their leading principal coordinates; the
sequence is cut into blocks.  Pairs of sequence intervals are joined recursively, from the whole
sequence down to pairs of blocks: a pair whose bounding boxes in the principal
coordinates lie further apart than epsilon is skipped with everything below it.
What remains is compared exactly, on the original vectors, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerpress.llm.components import components
from tickerpress.llm.vectors import is_valid, lengths, matrix, pack, scaled, unpacked
from tickerpress.session import write_through

COSINE = 0.98
#: Vectors that give the principal axes, taken by hash.  Any axes give right results.
SAMPLE = 4096
#: Principal coordinates that order the sequence, and those that bound its intervals.
ORDERED, BOUNDED = 6, 12
#: Vectors in a block, intervals in an interval of the next level.
BLOCK, FAN = 512, 4


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept.

    Rows are compared if their labels are equal and not null.  ``n_links`` counts the other rows at ``cosine`` or
    more, ``component_id`` is the smallest id reachable through links, the own included; ``kept``
    says whether that is the own id.  A vector that is null, empty or zero or holds a null or non-finite
    component links with nothing, nor does a row without label.  Vectors of different lengths have no cosine; each
    length is a join of its own.  Components are doubles throughout.
    Equal vectors of a label are compared once and counted as often as they occur; rows that
    repeat an id are rows like others.  An empty table gives no rows.
    """
    vector = F.col("vector")
    own = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"),
                      F.col(label_col).cast("long").alias("label"))
    able = is_valid(vector) & F.col("label").isNotNull()
    # Two hashes name a vector of a label; equal vectors meet before anything is compared.
    name = F.when(able, F.struct(F.xxhash64("label", "vector").alias("x"), F.xxhash64("vector", F.lit(7), "label").alias("y")))
    narrow = write_through(own.withColumn("name", name).select("vec_id", "name.*"), "vector-names")
    distinct = write_through(own.where(able).withColumn("name", name).groupBy("name").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("grp"),
        F.first("vector").alias("vector")).withColumn("key", F.monotonically_increasing_id()), "distinct-vectors")
    counts = rows.sparkSession.createDataFrame([], "key long, links long")
    links = rows.sparkSession.createDataFrame([], "a long, b long")
    for size in lengths(distinct, "vector"):
        more = join(distinct.where(F.size("vector") == size), size, cosine)
        counts, links = counts.unionByName(more[0]), links.unionByName(more[1])
    known = distinct.select("name.*", "key", "least", "weight").join(counts, "key", "left")
    of = components(links)
    known = known.join(of, known["key"] == of["node"], "left").withColumn("root", F.coalesce("component", "key"))
    known = write_through(known.select("x", "y", "least", "root",
                                       (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "linked-vectors")
    roots = write_through(known.groupBy("root").agg(F.min("least").alias("component_id")), "vector-roots")
    known = write_through(known.join(roots, "root").select("x", "y", "n_links", "component_id"), "named-vectors")
    out = narrow.join(known, ["x", "y"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.cast("long").alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def join(distinct: DataFrame, size: int, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(key, links) for every vector with links, weighted, and (a, b) whose components are those of all links.

    ``distinct`` has grp, key, weight, vector; vectors of different ``grp`` are not compared.
    """
    spark = distinct.sparkSession
    epsilon = float(np.sqrt(2 - 2 * cosine)) + 1e-9
    axes = _axes(distinct, size)
    ordered = min(ORDERED, len(axes))
    placed = distinct.withColumn("at", _coordinates(axes, size)("vector"))
    cells = [F.floor(F.col("at")[i] / epsilon).alias(f"c{i}") for i in range(ordered)]
    order = ["grp", *[f"c{i}" for i in range(ordered)], "key"]
    sequence = placed.select("grp", *cells, "key", "weight", "vector")
    blocks = write_through(pack(sequence.repartitionByRange(*order).sortWithinPartitions(*order), size, BLOCK), "blocks")
    boxes = blocks.mapInPandas(_boxes(axes, size), "part int, seq int, grp long, " + ", ".join(
        f"lo{i} double, hi{i} double" for i in range(len(axes))))
    # Blocks are numbered along the sequence: one count per partition reaches the driver.
    parts = blocks.groupBy("part").count().toPandas().sort_values("part")
    parts["before"] = parts["count"].cumsum() - parts["count"]
    first = spark.createDataFrame(parts[["part", "before"]].astype("int64"), "part long, before long")
    numbered = blocks.join(F.broadcast(first), "part").withColumn("node", F.col("before") + F.col("seq"))
    blocks = write_through(numbered.drop("before"), "numbered-blocks")
    boxes = (boxes.join(F.broadcast(first), "part").withColumn("node", F.col("before") + F.col("seq"))
             .withColumns({"grp_lo": F.col("grp"), "grp_hi": F.col("grp")}).drop("part", "seq", "before", "grp"))
    pairs = _interval_pairs(boxes, int(parts["count"].sum()), len(axes), epsilon)
    side = lambda s: blocks.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("keys", "weights", "vectors")])
    found = write_through(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(
        _compare(cosine), "key long, links long, other long"), "vector-links")
    counts = found.where("links > 0").groupBy("key").agg(F.sum("links").alias("links"))
    return counts, found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b"))


def _interval_pairs(boxes: DataFrame, n: int, dims: int, epsilon: float) -> DataFrame:
    """(a, b), a <= b: the pairs of blocks that may hold links."""
    levels, nodes = [write_through(boxes, "boxes-0")], n
    while nodes > FAN:
        edges = [F.min(f"lo{i}").alias(f"lo{i}") for i in range(dims)] + [F.max(f"hi{i}").alias(f"hi{i}") for i in range(dims)]
        levels.append(write_through(levels[-1].groupBy(F.floor(F.col("node") / FAN).alias("node")).agg(
            F.min("grp_lo").alias("grp_lo"), F.max("grp_hi").alias("grp_hi"), *edges), f"boxes-{len(levels)}"))
        nodes = -(-nodes // FAN)
    spark = boxes.sparkSession
    pairs = spark.range(nodes).select(F.col("id").alias("a"), F.explode(F.sequence("id", F.lit(nodes - 1))).alias("b")) \
        if nodes else spark.createDataFrame([], "a long, b long")
    for depth in range(len(levels) - 1, -1, -1):
        if depth < len(levels) - 1:
            pairs = pairs.select(F.explode(_children("a")).alias("a"), "b").select(
                "a", F.explode(_children("b")).alias("b")).where("a <= b")
        x, y = levels[depth].alias("x"), levels[depth].alias("y")
        apart = sum(F.pow(F.greatest(F.lit(0.0), F.col(f"x.lo{i}") - F.col(f"y.hi{i}"),
                                     F.col(f"y.lo{i}") - F.col(f"x.hi{i}")), 2) for i in range(dims))
        pairs = write_through(
            pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node"))
            .where((F.col("x.grp_lo") <= F.col("y.grp_hi")) & (F.col("y.grp_lo") <= F.col("x.grp_hi"))
                   & (apart <= epsilon * epsilon)).select("a", "b"), f"pairs-{depth}")
    return pairs


def _children(node: str):
    return F.sequence(F.col(node) * FAN, F.col(node) * FAN + FAN - 1)


def _axes(distinct: DataFrame, size: int) -> np.ndarray:
    """Leading principal axes of the unit vectors, from a bounded sample."""
    sample = distinct.orderBy(F.xxhash64("key")).limit(SAMPLE).select("vector").toArrow().column("vector").combine_chunks()
    if not len(sample):
        return np.eye(max(size, 1))[:BOUNDED]
    unit = _unit(matrix(sample, size))
    _, axes = np.linalg.eigh(np.cov(unit.T, bias=True).reshape(size, size))
    return np.ascontiguousarray(axes[:, ::-1].T[:BOUNDED])


def _unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _coordinates(axes: np.ndarray, size: int):
    @F.pandas_udf("array<double>")
    def at(vector: pd.Series) -> pd.Series:
        if not len(vector):
            return pd.Series([], dtype=object)
        return pd.Series(list(_unit(np.stack(vector.to_numpy())) @ axes.T))

    return at


def _boxes(axes: np.ndarray, size: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                at = _unit(unpacked(row.keys, row.weights, row.vectors)[2]) @ axes.T
                out.append({"part": row.part, "seq": row.seq, "grp": row.grp}
                           | {f"lo{i}": v for i, v in enumerate(at.min(axis=0) - 1e-9)}
                           | {f"hi{i}": v for i, v in enumerate(at.max(axis=0) + 1e-9)})
            yield pd.DataFrame(out, columns=["part", "seq", "grp", *[f"{s}{i}" for i in range(len(axes)) for s in ("lo", "hi")]])
    return work


def _compare(cosine: float):
    """Weighted link counts of both blocks' vectors, and a star for every component between them."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name, i=i: batch.column(name)[i].as_py()
                ka, wa, xa = unpacked(get("keys_a"), get("weights_a"), get("vectors_a"))
                kb, wb, xb = unpacked(get("keys_b"), get("weights_b"), get("vectors_b"))
                xa, xb = scaled(xa), scaled(xb)
                near = (xa @ xb.T) / np.outer(np.linalg.norm(xa, axis=1), np.linalg.norm(xb, axis=1)) >= cosine
                same = get("a") == get("b")
                if same:
                    np.fill_diagonal(near, False)
                if not near.any():
                    continue
                keys, links = [ka], [near @ wb]
                if not same:
                    keys, links = [ka, kb], [near @ wb, wa @ near]
                keys, links = np.concatenate(keys), np.concatenate(links)
                yield _out(keys[links > 0], links[links > 0], None)
                a, b = _star(near, same)
                both = ka if same else np.concatenate([ka, kb])
                yield _out(both[a], np.zeros(len(a), np.int64), both[b])
    return work


def _out(keys, links, other) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys), pa.array(links), pa.nulls(len(keys), pa.int64()) if other is None else pa.array(other)],
        ["key", "links", "other"])


def _star(near: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what ``near`` joins, at most one per vector."""
    if not same:
        n, m = near.shape
        both = np.zeros((n + m, n + m), dtype=bool)
        both[:n, n:], both[n:, :n] = near, near.T
        near = both
    near = near | np.eye(len(near), dtype=bool)
    label = np.arange(len(near))
    while True:
        least = np.where(near, label[None, :], len(near)).min(axis=1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    linked = np.flatnonzero(label != np.arange(len(label)))
    return linked, label[linked]
