"""Nearest neighbours by inner product through a hierarchical k-means tree.

A sample gives the tree; every vector is filed in the leaf it descends to.  A query
visits leaves best bin first: a priority queue holds the nodes seen so far, by the inner
product with their centres; its own leaf is visited in any case.  How many leaves to visit is calibrated: visits widen until
queries whose neighbours were found by brute force have reached the wanted recall.
Leaves lie in buckets, and packed blocks of queries meet packed blocks of vectors
bucket by bucket, a few blocks to a join key, so a vector is sent once per block of queries, not per query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerpress.llm.vectors import is_valid, lengths, matrix, opened, pack, unpacked
from tickerpress.session import write_through

#: Distinct vectors the tree is fitted on, children of a node, sample vectors of a leaf.
SAMPLE, CHILDREN, LEAF = 20_000, 8, 40
#: Leaves in a bucket, rows in a packed block of vectors or queries, and blocks of a bucket that share a join key.
BUCKET, VECTORS, QUERIES, SHARED = 64, 4096, 256, 4
#: Queries that calibrate, and the recall their visits are widened to.
CALIBRATION, RECALL = 256, 0.96
#: Blocks of queries whose best rows a task merges before it passes them on.
MERGED = 256


class Tree:
    """Inner nodes are lists of (centre matrix, children); a child is a node number or ~leaf."""

    def __init__(self, sample: np.ndarray, children: int = CHILDREN, leaf: int = LEAF, seed: int = 5):
        self.centres: list[np.ndarray] = []
        self.below: list[list[int]] = []
        self.leaves = 0
        # A power of two that keeps products with the centres finite.
        self.scale = 2.0 ** -int(np.frexp(np.abs(sample).max(initial=1e-300))[1])
        self.root = self._grow(sample * self.scale, children, leaf, np.random.default_rng(seed))

    def _grow(self, x: np.ndarray, children: int, leaf: int, rng) -> int:
        centre, own = _kmeans(x, min(children, -(-len(x) // leaf)), rng) if len(x) > leaf else (None, None)
        if centre is None or len(centre) < 2:
            self.leaves += 1
            return ~(self.leaves - 1)
        node = len(self.centres)
        self.centres.append(centre)
        self.below.append([])
        self.below[node] = [self._grow(x[own == j], children, leaf, rng) for j in range(len(centre))]
        return node

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf each row descends to, by the nearest centre at every node."""
        out, x = np.empty(len(x), dtype=np.int64), x * self.scale
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
            elif len(rows):
                c = self.centres[node]
                own = (x[rows] @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
                todo += [(child, rows[own == j]) for j, child in enumerate(self.below[node])]
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves of the best-bin-first order."""
        heap, out, query = [(0.0, self.root)], [], query * self.scale
        while heap and len(out) < most:
            _, node = heapq.heappop(heap)
            if node < 0:
                out.append(~node)
                continue
            for value, child in zip((self.centres[node] @ query).tolist(), self.below[node]):
                heapq.heappush(heap, (-value, child))
        return out


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centre = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = (x @ centre.T - 0.5 * (centre * centre).sum(axis=1)).argmax(axis=1)
        centre = np.stack([x[own == j].mean(axis=0) if (own == j).any() else centre[j] for j in range(len(centre))])
    own = (x @ centre.T - 0.5 * (centre * centre).sum(axis=1)).argmax(axis=1)
    used, own = np.unique(own, return_inverse=True)
    return centre[used], own


def nearest(rows: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row for which ``is_query`` holds.

    Candidates are all rows but the query's own, nearest is the largest inner product in double
    precision on the original vectors, ties go to the smaller id.  Vectors that are null, empty or zero or
    hold a null or non-finite component, and null ids, take no part.  Vectors of different lengths have no inner
    product; each length has a tree and a search of its own.  Equal
    vectors are searched once; only their k + 1 smallest ids can be in an answer, so no group of copies is
    gathered.  A repeated id with different vectors gives an answer for each.  Fewer candidates than
    k give fewer rows; an empty table none.  `is_query` is a column over ``id_col``.
    """
    vector = F.col("vector")
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"),
                      F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("vec_id").isNotNull())
    own = own.where(is_valid(vector)).withColumns({"x": F.xxhash64("vector"), "y": F.xxhash64("vector", F.lit(7))})
    out = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for size in lengths(own, "vector"):
        out = out.unionByName(_nearest(own.where(F.size("vector") == size), size, k, recall))
    return out


def _nearest(own: DataFrame, size: int, k: int, recall: float) -> DataFrame:
    """``nearest`` among vectors of one length: vec_id, vector, asks, and two hashes x, y of the vector."""
    distinct = write_through(own.groupBy("x", "y").agg(
        F.max("asks").alias("asks"), F.first("vector").alias("vector"), F.min("vec_id").alias("weight"))
        .withColumn("key", F.monotonically_increasing_id()), "ann-vectors")
    # Row numbers are limited before the shuffle: a vector that many rows share stays small.
    first = own.select("x", "y", "vec_id").withColumn(
        "nth", F.row_number().over(Window.partitionBy("x", "y").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    ids = write_through(first.join(distinct.select("x", "y", "key"), ["x", "y"]).select("key", "vec_id"), "ann-ids")
    sample = distinct.orderBy(F.xxhash64("key")).limit(SAMPLE).select("vector").toArrow().column("vector").combine_chunks()
    tree = Tree(matrix(sample, size))
    filed = distinct.withColumn("leaf", _leaf_of(tree)("vector"))
    blocks = write_through(pack(_in_order(filed.withColumn("grp", F.floor(F.col("leaf") / BUCKET)), "leaf", "key"), size, VECTORS)
                           .select("part", "seq", "grp", "keys", "weights", "vectors"), "ann-blocks")
    asking = filed.where("asks").withColumn("grp", F.lit(0).cast("long"))
    trial = asking.orderBy(F.xxhash64("key", F.lit(1))).limit(CALIBRATION)
    visits = _calibrate(_queries(trial, size, tree, tree.leaves), blocks, ids, tree, k, recall)
    found = _search(_queries(asking, size, tree, visits), blocks, tree, k)
    # The k + 1 best rows of each distinct query; then each row that asks drops itself.
    listed = write_through(_rows(write_through(_top(found, k + 1), "ann-found"), ids, k + 1)
                           .select("query", "vec_id", "score"), "ann-listed")
    asks = write_through(own.where("asks").join(distinct.select("x", "y", F.col("key").alias("query")), ["x", "y"])
                         .select("query", F.col("vec_id").alias("query_id"), F.monotonically_increasing_id().alias("row")),
                         "ann-asking")
    # A query's rows are k + 1 at most, so the answers of a shared vector are dealt out by row.
    answers = asks.join(listed, "query").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _in_order(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)


def _leaf_of(tree: Tree):
    @F.pandas_udf("long")
    def leaf(vector: pd.Series) -> pd.Series:
        if not len(vector):
            return pd.Series([], dtype="int64")
        return pd.Series(tree.file(np.stack(vector.to_numpy())))

    return leaf


def _queries(asking: DataFrame, size: int, tree: Tree, visits: int) -> DataFrame:
    """Per block of queries and bucket that one of them visits: qkeys, qvectors, and a bit per query and leaf."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name, i=i: batch.column(name)[i].as_py()
                keys, _, x = unpacked(get("keys"), get("weights"), get("vectors"))
                seen = np.zeros((len(keys), -(-tree.leaves // BUCKET) * BUCKET), dtype=bool)
                seen[np.arange(len(keys)), tree.file(x)] = True  # copies of the query lie in its own leaf
                for row, query in enumerate(x):
                    seen[row, tree.visits(query, visits)] = True
                seen = seen.reshape(len(keys), -1, BUCKET)
                for bucket in np.flatnonzero(seen.any(axis=(0, 2))).tolist():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([bucket], pa.int64()), pa.array([get("keys")]), pa.array([get("vectors")]),
                         pa.array([np.packbits(seen[:, bucket], axis=1).tobytes()])], ["grp", "qkeys", "qvectors", "seen"])

    packed = pack(_in_order(asking.withColumn("weight", F.lit(0).cast("long")), "leaf", "key"), size, QUERIES)
    return packed.repartition("part", "seq").mapInArrow(work, "grp long, qkeys binary, qvectors binary, seen binary")


def _search(queries: DataFrame, blocks: DataFrame, tree: Tree, k: int) -> DataFrame:
    """(query, key, weight, leaf, score): the best k + 1 of each query among the blocks a task has of those it visits."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name, i=i: batch.column(name)[i].as_py()
                keys, ids, x = unpacked(get("keys"), get("weights"), get("vectors"))
                asking = np.frombuffer(get("qkeys"), np.int64)
                q = opened(get("qvectors"), len(asking))
                seen = np.unpackbits(np.frombuffer(get("seen"), np.uint8)).reshape(len(asking), -1)[:, :BUCKET] == 1
                leaf = tree.file(x)
                score = np.full((len(asking), len(keys)), -np.inf)
                for one in np.unique(leaf):
                    who, what = np.flatnonzero(seen[:, one % BUCKET]), np.flatnonzero(leaf == one)
                    if len(who):
                        score[np.ix_(who, what)] = q[who] @ x[what].T
                most = min(k + 1, len(keys))
                floor = -np.partition(-score, most - 1, axis=1)[:, most - 1]
                # What ties with the last one, but for rounding, stays in.
                floor = np.where(np.isfinite(floor), floor - 1e-12 * np.abs(floor), -np.inf)
                row, col = np.nonzero((score >= floor[:, None]) & (score > -np.inf))
                if len(row):
                    exact = (q[row] * x[col]).sum(axis=1)  # one order of summing for every pair
                    found = asking[row], keys[col], ids[col], leaf[col], exact
                    before = held.get(get("qkeys"))
                    held[get("qkeys")] = _best(found if before is None else [
                        np.concatenate(pair) for pair in zip(before, found)], k + 1)
                if len(held) >= MERGED:
                    yield from map(_found, held.values())
                    held = {}
        yield from map(_found, held.values())

    # A bucket has as many keys as its blocks need, so tasks grow in number with the table.
    keys = blocks.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / SHARED).alias("n"))
    dealt = blocks.join(keys, "grp").withColumn("key_no", F.pmod(F.xxhash64("part", "seq"), F.col("n"))).drop("part", "seq", "n")
    sent = queries.join(keys, "grp").withColumn("key_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).drop("n")
    return sent.join(dealt, ["grp", "key_no"]).mapInArrow(work, "query long, key long, weight long, leaf long, score double")


def _best(found, most: int) -> tuple:
    """Of (query, key, id, leaf, score) arrays, the best rows of each query."""
    query, _, ids, _, score = found
    order = np.lexsort((ids, -score, query))
    first = np.r_[True, query[order][1:] != query[order][:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    kept = order[np.arange(len(order)) - start < most]
    return tuple(x[kept] for x in found)


def _found(found: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query", "key", "weight", "leaf", "score"])


def _top(found: DataFrame, most: int, then: str = "weight") -> DataFrame:
    """The best rows of each query; ``weight`` is the smallest id of a vector."""
    return found.withColumn("nth", F.row_number().over(
        Window.partitionBy("query").orderBy(F.desc("score"), then))).where(F.col("nth") <= most).drop("nth")


def _rows(best: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """From vectors to rows: the best ``most`` rows of each query."""
    return _top(best.join(ids, "key"), most, "vec_id")


def _calibrate(trial: DataFrame, blocks: DataFrame, ids: DataFrame, tree: Tree, k: int, recall: float) -> int:
    """The number of leaves to visit: widened until the trial queries reach ``recall`` of their nearest rows."""
    found = write_through(_top(_search(trial, blocks, tree, k), k + 1), "ann-trial")
    truth = _rows(found, ids, k + 1).select("query", "key", "leaf").toPandas()  # k + 1 rows a trial query
    vectors = {}
    for row in trial.select("qkeys", "qvectors").distinct().toPandas().itertuples():
        keys = np.frombuffer(row.qkeys, np.int64)
        vectors.update(zip(keys.tolist(), opened(row.qvectors, len(keys))))
    turn = []
    for query, rows in truth[truth["key"] != truth["query"]].groupby("query"):
        at = {leaf: i for i, leaf in enumerate(tree.visits(vectors[query], tree.leaves))}
        turn += [at[leaf] for leaf in rows["leaf"]]
    turn, visits = np.array(turn), 1
    while visits < tree.leaves and len(turn) and (turn < visits).mean() < recall:
        visits = min(tree.leaves, visits + max(1, visits // 8))
    return visits
