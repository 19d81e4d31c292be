"""Boosted regression trees on binned columns, many models in lockstep.

Second-order boosting for squared error (Chen & Guestrin 2016): the gain of a split is
GL^2/(NL+1) + GR^2/(NR+1) - G^2/(N+1) over residual sums G and counts N, a leaf is G/(N+1), and rows without
a value go to the side where they help more.  Columns are cut at quantiles of the fit rows.

The rows are binned once, a byte a value, in blocks of ``BLOCK`` rows.  While they fill more than one
block, all models grow together, level by level: tasks sum histograms over their blocks, an
exchange adds them per (model, node), and only the chosen splits, whose number depends on the models'
parameters alone, come back.  A task finds the residuals of a block from the trees so far,
remembering them between levels, so a lost executor costs a recomputation.  Rows that fill
one block need no exchange between levels: a task per model grows its trees over that block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerpress.session import write_through

#: Rows of a block (a byte each per column), and bins of a column beside the one for missing values.
BLOCK, BINS = 1 << 16, 64
#: Added to the count of a node, in gains and in leaves.
SHRINK = 1.0


@dataclass
class Spec:
    """A model to fit: its columns, by number, and parameters."""

    columns: tuple[int, ...]
    n_trees: int
    rate: float
    depth: int


@dataclass
class Tree:
    """Nodes in heap order; ``column`` is -1 at a leaf, ``cut`` the last bin that goes left."""

    column: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> "Tree":
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n), np.zeros(n))

    def leaves(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node each row of binned values ends in after ``depth`` levels."""
        node = np.zeros(len(bins), np.int32)
        for _ in range(depth):
            node = self.descend(bins, node)
        return node

    def descend(self, bins: np.ndarray, node: np.ndarray) -> np.ndarray:
        column = self.column[node]
        value = bins[np.arange(len(bins)), np.maximum(column, 0)]
        left = np.where(value == BINS, self.missing_left[node], value <= self.cut[node])
        return np.where(column < 0, node, 2 * node + 2 - left).astype(np.int32)


@dataclass
class Forest:
    """A fitted model on the columns ``names``; ``edges`` are their cut points."""

    names: list[str]
    edges: list[np.ndarray]
    base: float
    rate: float
    depth: int
    trees: list[Tree] = field(default_factory=list)

    def head(self, n_trees: int) -> "Forest":
        return Forest(self.names, self.edges, self.base, self.rate, self.depth, self.trees[:n_trees])

    def staged(self, values: np.ndarray) -> Iterator[np.ndarray]:
        """Predictions after 0, 1, 2, ... trees for raw values, a column per name."""
        bins = to_bins(values, self.edges)
        out = np.full(len(values), self.base)
        yield out
        for tree in self.trees:
            out = out + self.rate * tree.value[tree.leaves(bins, self.depth)]
            yield out

    def predict(self, values: np.ndarray) -> np.ndarray:
        *_, last = self.staged(values)
        return last

    def importances(self) -> np.ndarray:
        """Mean gain of the splits on each column, summing to 1 (all 0 without a split)."""
        total, used = np.zeros(len(self.names)), np.zeros(len(self.names))
        for tree in self.trees:
            inner = tree.column >= 0
            np.add.at(total, tree.column[inner], tree.gain[inner])
            np.add.at(used, tree.column[inner], 1)
        mean = total / np.maximum(used, 1)
        return mean / mean.sum() if mean.sum() else mean


def to_bins(values: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Number of edges below each value; missing values in a bin of their own."""
    out = np.empty(values.shape, np.uint8)
    for i, cuts in enumerate(edges):
        out[:, i] = np.where(np.isnan(values[:, i]), BINS, np.searchsorted(cuts, values[:, i], side="left"))
    return out


def fit_forests(rows: DataFrame, names: Sequence[str], target: str, specs: Sequence[Spec]) -> list[Forest]:
    """Fit all ``specs`` on the same rows.  Rows without target take no part; without rows forests have no trees."""
    if not specs:
        return []
    spark, names = rows.sparkSession, list(names)
    usable = rows.where(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double"))).select(
        F.col(target).cast("double").alias("y"), F.array(*[_number(c) for c in names]).alias("x"))
    n, mean, edges = _edges(usable, len(names))
    forests = [Forest([names[c] for c in s.columns], [edges[c] for c in s.columns], mean, s.rate, s.depth) for s in specs]
    if not n:
        return forests
    blocks = _write_blocks(usable, edges, -(-n // BLOCK))
    if n <= BLOCK:
        trees = _grow_apart(spark, blocks, specs, mean)
    else:
        trees = _grow_in_lockstep(blocks, specs, mean)
    for forest, grown in zip(forests, trees):
        forest.trees = grown
    return forests


def _number(column: str):
    value = F.col(column).cast("double")
    return F.when(F.isnan(value), F.lit(None)).otherwise(value)


def _edges(usable: DataFrame, n_columns: int) -> tuple[int, float, list[np.ndarray]]:
    """Rows, their mean target, and at most ``BINS`` - 1 quantiles of each column."""
    shares = [i / BINS for i in range(1, BINS)]
    cuts = [F.percentile_approx(F.col("x")[i], shares, 10_000).alias(f"e{i}") for i in range(n_columns)]
    row = usable.agg(F.count(F.lit(1)), F.avg("y"), *cuts).first()
    return row[0], row[1], [np.unique(np.array(e if e is not None else [], dtype=float)) for e in row[2:]]


def _write_blocks(usable: DataFrame, edges: list[np.ndarray], n_blocks: int) -> DataFrame:
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def block():
            both = pd.concat(held)
            # Missing values arrive as None or NaN, by the batch.
            x = np.array([[np.nan if v is None else v for v in r] for r in both["x"]], dtype=float).reshape(len(both), len(edges))
            return pd.DataFrame({"block": [uuid.uuid4().hex], "n": [len(both)], "bins": [to_bins(x, edges).tobytes()],
                                 "y": [both["y"].to_numpy(dtype=float).tobytes()]})

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += len(batch)
            if size >= BLOCK:
                yield block()
                held, size = [], 0
        if held:
            yield block()

    spread = usable.coalesce(1) if n_blocks == 1 else usable.repartition(n_blocks)
    return write_through(spread.mapInPandas(pack, "block string, n long, bins binary, y binary"), "tree-blocks")


def _open(row, n_columns: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row.bins, np.uint8).reshape(int(row.n), n_columns), np.frombuffer(row.y)


# -- one level ----------------------------------------------------------------

def histogram(bins: np.ndarray, residual: np.ndarray, node: np.ndarray, first: int, n_nodes: int) -> np.ndarray:
    """Residual sums and counts: (node, column, bin, 2) for the nodes from ``first`` on."""
    rows = np.flatnonzero(node >= first)
    n_columns, width = bins.shape[1], BINS + 1
    place = ((node[rows] - first)[:, None] * n_columns + np.arange(n_columns)) * width + bins[rows]
    size, flat = n_nodes * n_columns * width, place.ravel()
    sums = np.bincount(flat, np.repeat(residual[rows], n_columns), size)
    return np.stack([sums, np.bincount(flat, minlength=size)], axis=-1).reshape(n_nodes, n_columns, width, 2)


def choose(hist: np.ndarray) -> dict[str, np.ndarray]:
    """The best split of each node; ``column`` is -1 where none gains."""
    total = hist[:, 0].sum(axis=1)  # every column sees all rows
    missing, known = hist[:, :, BINS], hist[:, :, :BINS].cumsum(axis=2)
    left = np.stack([known, known + missing[:, :, None]])  # missing goes right, then left
    right = total[None, :, None, None, :] - left
    gain = _score(left) + _score(right) - _score(total)[None, :, None, None]
    gain[(left[..., 1] < 0.5) | (right[..., 1] < 0.5)] = -np.inf
    flat = gain.transpose(1, 2, 3, 0).reshape(len(hist), -1)  # ties: first column, lowest cut, missing right
    best = flat.astype(np.float32).argmax(axis=1)  # equal but for the order of the sums is a tie
    column, rest = np.divmod(best, 2 * BINS)
    cut, side = np.divmod(rest, 2)
    nodes = np.arange(len(hist))
    splits = flat[nodes, best] > 1e-9
    lefts, rights = left[side, nodes, column, cut], right[side, nodes, column, cut]
    return {"column": np.where(splits, column, -1), "cut": cut, "missing_left": side == 1, "gain": np.where(splits, flat[nodes, best], 0.0),
            "left": _leaf(lefts), "right": _leaf(rights), "here": _leaf(total)}


def _score(sums: np.ndarray) -> np.ndarray:
    return sums[..., 0] ** 2 / (sums[..., 1] + SHRINK)


def _leaf(sums: np.ndarray) -> np.ndarray:
    return sums[..., 0] / (sums[..., 1] + SHRINK)


def _apply(tree: Tree, first: int, found: dict[str, np.ndarray]) -> None:
    """Write a level's splits into the tree, and the values its children would have as leaves."""
    nodes = first + np.arange(len(found["column"]))
    if first == 0:
        tree.value[0] = found["here"][0]
    splits = found["column"] >= 0
    for name in ("column", "cut", "missing_left", "gain"):
        getattr(tree, name)[nodes] = found[name]
    tree.value[2 * nodes[splits] + 1] = found["left"][splits]
    tree.value[2 * nodes[splits] + 2] = found["right"][splits]


# -- rows of one block: a task per model -------------------------------------

def grow(bins: np.ndarray, y: np.ndarray, spec: Spec, base: float) -> list[Tree]:
    trees, fitted = [], np.full(len(y), base)
    for _ in range(spec.n_trees):
        tree, node = Tree.empty(spec.depth), np.zeros(len(y), np.int32)
        residual = y - fitted
        for level in range(spec.depth):
            first = 2 ** level - 1
            _apply(tree, first, choose(histogram(bins, residual, node, first, 2 ** level)))
            node = tree.descend(bins, node)
        fitted = fitted + spec.rate * tree.value[node]
        trees.append(tree)
    return trees


def _grow_apart(spark: SparkSession, blocks: DataFrame, specs: Sequence[Spec], base: float) -> list[list[Tree]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                spec = specs[row.spec]
                bins, y = _open(row, len(np.frombuffer(row.bins, np.uint8)) // int(row.n))
                trees = grow(np.ascontiguousarray(bins[:, list(spec.columns)]), y, spec, base)
                yield _rows_of([(row.spec, t, tree) for t, tree in enumerate(trees)])

    # The costliest models first, one to a task; the block is one row, whose size is checked above.
    order = sorted(range(len(specs)), key=lambda i: -specs[i].n_trees * specs[i].depth * len(specs[i].columns))
    jobs = spark.createDataFrame([(i, place) for place, i in enumerate(order)], "spec int, place int")
    paired = jobs.repartitionByRange(len(order), "place").withColumn("fit", F.lit(0)).join(
        F.broadcast(blocks.withColumn("fit", F.lit(0))), "fit")
    return _trees_of(paired.mapInPandas(run, _TREES).toPandas(), len(specs))


_TREES = "spec int, tree int, columns binary, cuts binary, missing binary, vals binary, gains binary"


def _rows_of(trees: list[tuple[int, int, Tree]]) -> pd.DataFrame:
    return pd.DataFrame([(s, t, x.column.tobytes(), x.cut.tobytes(), x.missing_left.tobytes(), x.value.tobytes(), x.gain.tobytes())
                         for s, t, x in trees], columns=[c.split()[0] for c in _TREES.split(", ")])


def _trees_of(rows: pd.DataFrame, n_specs: int) -> list[list[Tree]]:
    out: list[list[Tree]] = [[] for _ in range(n_specs)]
    for r in rows.sort_values(["spec", "tree"]).itertuples():
        out[r.spec].append(Tree(np.frombuffer(r.columns, np.int32), np.frombuffer(r.cuts, np.int32), np.frombuffer(r.missing, bool),
                                np.frombuffer(r.vals), np.frombuffer(r.gains)))
    return out


# -- rows of many blocks: all models, level by level ---------------------------

#: (run, block, model) -> number of trees already added, and the predictions with them.
_FITTED: dict[tuple, tuple[int, np.ndarray]] = {}


def _fitted(key: tuple, bins: np.ndarray, spec: Spec, base: float, trees: list[Tree]) -> np.ndarray:
    """Predictions of the whole trees for a block, from those this worker remembers, if any."""
    known, out = _FITTED.get(key, (0, np.full(len(bins), base)))
    for tree in trees[known:]:
        out = out + spec.rate * tree.value[tree.leaves(bins, spec.depth)]
    if len(_FITTED) > 256:
        _FITTED.clear()
    _FITTED[key] = (len(trees), out)
    return out


def _grow_in_lockstep(blocks: DataFrame, specs: Sequence[Spec], base: float) -> list[list[Tree]]:
    run_id, trees = uuid.uuid4().hex, [[] for _ in specs]
    for t in range(max(s.n_trees for s in specs)):
        active = [i for i, s in enumerate(specs) if t < s.n_trees]
        for i in active:
            trees[i].append(Tree.empty(specs[i].depth))
        for level in range(max(specs[i].depth for i in active)):
            growing = [i for i in active if level < specs[i].depth]
            for i, found in _level(blocks, specs, trees, growing, level, base, run_id).items():
                _apply(trees[i][-1], 2 ** level - 1, found)
    return trees


def _level(blocks: DataFrame, specs: Sequence[Spec], trees: list[list[Tree]], growing: list[int], level: int, base: float,
           run_id: str) -> dict[int, dict[str, np.ndarray]]:
    """One histogram aggregate over all blocks for the nodes of one level of all growing models."""
    first, n_nodes = 2 ** level - 1, 2 ** level

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.itertuples():
                every, y = _open(row, len(row.bins) // int(row.n))
                for i in growing:
                    bins = np.ascontiguousarray(every[:, list(specs[i].columns)])
                    fitted = _fitted((run_id, row.block, i), bins, specs[i], base, trees[i][:-1])
                    node = trees[i][-1].leaves(bins, level)
                    hist = histogram(bins, y - fitted, node, first, n_nodes)
                    total[i] = total[i] + hist if i in total else hist
        for i, hist in total.items():
            yield pd.DataFrame({"spec": i, "node": np.arange(n_nodes), "hist": [h.tobytes() for h in hist]})

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        i = int(pdf["spec"].iloc[0])
        hist = sum(np.frombuffer(h).reshape(1, len(specs[i].columns), BINS + 1, 2) for h in pdf["hist"])
        found = choose(hist)
        return pd.DataFrame({"spec": [i], "node": [int(pdf["node"].iloc[0])], **{k: v[:1] for k, v in found.items()}})

    schema = ("spec int, node int, column int, cut int, missing_left boolean, gain double, left double, right double, here double")
    partial = blocks.mapInPandas(sums, "spec int, node int, hist binary")
    found = partial.groupBy("spec", "node").applyInPandas(best, schema).toPandas()
    return {int(i): {c: g[c].to_numpy() for c in g.columns[2:]} for i, g in found.sort_values(["spec", "node"]).groupby("spec")}
