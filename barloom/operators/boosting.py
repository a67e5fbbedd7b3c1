"""Histogram gradient boosting, leaf by leaf.

Columns are cut into at most BINS bins and rows are packed into blocks of BLOCK rows: bins, target, whether the row is held, and its score so far.
A job sums, over all blocks, the histograms (gradient, curvature, rows) of some nodes of the growing tree; those are a fixed number of values whatever
the data, and the driver picks splits from them. The next leaf to split is always the one with the largest gain. So as not to run one job for
each split, a job covers the children of all leaves that may be split before the tree has its number of leaves; what isn't chosen is
dropped, so the tree is the one that single steps would give. Only the smaller child is summed, the other is the rest of its parent.

Every REWRITE rounds the blocks are written anew with the scores of the trees so far, so a job evaluates few trees and lineage stays short.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.scan import written

BINS, BLOCK, REWRITE = 255, 1 << 15, 25
FEW = 16  # tasks whose sums are collected as they are
LEAST_CURVATURE = 1e-3
BLOCKS = "bins binary, y binary, held binary, score binary"


@dataclass(frozen=True)
class Spec:
    """kind: log (two classes) or squared."""

    kind: str = "log"
    rounds: int = 600
    rate: float = 0.05
    leaves: int = 31
    least_rows: int = 100
    patience: int = 10
    tolerance: float = 1e-7
    early_stop: bool = True


@dataclass
class Tree:
    """Nodes by number, the root first: a leaf has left -1; rows whose bin is at most `cut` go left."""

    feature: list[int] = field(default_factory=lambda: [0])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, len(self.left), len(self.left) + 1
        for part, blank in ((self.feature, 0), (self.cut, 0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            part += [blank, blank]
        return self.left[node], self.right[node]

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        feature, cut, left, right = (np.array(v) for v in (self.feature, self.cut, self.left, self.right))
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(rows := rows[left[node[rows]] >= 0]):
            at = node[rows]
            node[rows] = np.where(bins[rows, feature[at]] <= cut[at], left[at], right[at])
        return node

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf(bins)]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], axis=1).astype(np.uint8) if len(x) else np.zeros((0, len(edges)), np.uint8)


def slopes(kind: str, score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the loss at each row."""
    if kind == "squared":
        return score - y, np.ones(len(y))
    p = 1 / (1 + np.exp(-score))
    return p - y, p * (1 - p)


def losses(kind: str, score: np.ndarray, y: np.ndarray) -> np.ndarray:
    return 0.5 * (score - y) ** 2 if kind == "squared" else np.logaddexp(0, score) - y * score


def histograms(bins: np.ndarray, slot: np.ndarray, g: np.ndarray, h: np.ndarray, n_slots: int) -> np.ndarray:
    """Slots by columns by bins by (gradient, curvature, rows); rows in slot -1 count nowhere."""
    used = slot >= 0
    bins, slot, g, h = bins[used], slot[used], g[used], h[used]
    out = np.zeros((n_slots, bins.shape[1], BINS + 1, 3))
    for k in range(bins.shape[1]):
        at, size = slot * (BINS + 1) + bins[:, k], n_slots * (BINS + 1)
        for c, w in enumerate((g, h, None)):
            out[:, k, :, c] = np.bincount(at, w, size).reshape(n_slots, BINS + 1)
    return out


def best_split(hist: np.ndarray, least_rows: int) -> tuple[float, int, int] | None:
    """(gain, column, bin) of the split with the largest positive gain, of equal ones the first; None where there is none."""
    below = np.cumsum(hist, axis=1)[:, :-1]
    whole = hist[0].sum(axis=0)
    above = whole - below
    fine = (np.minimum(below[..., 2], above[..., 2]) >= least_rows) & (np.minimum(below[..., 1], above[..., 1]) >= LEAST_CURVATURE)
    if not fine.any():
        return None
    square = lambda s: s[..., 0] ** 2 / np.where(s[..., 1] > 0, s[..., 1], 1.0)
    gain = np.where(fine, square(below) + square(above) - square(whole), -np.inf)
    k, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return (float(gain[k, b]), int(k), int(b)) if gain[k, b] > 0 else None


def grow(spec: Spec, root: np.ndarray, children) -> Tree:
    """The tree that always splits the leaf with the largest gain. root: the histogram of all rows; children(tree, nodes) -> histograms of these nodes."""
    trial, hist = Tree(), {0: root}
    splits = {0: best_split(root, spec.least_rows)}
    while True:
        # best-first as far as histograms are known
        leaves, order, missing = [0], [], []
        while len(leaves) < spec.leaves:
            able = [n for n in leaves if splits[n]]
            if not able:
                break
            best = max(able, key=lambda n: (splits[n][0], -n))
            if trial.left[best] < 0:
                missing = sorted((n for n in able if trial.left[n] < 0), key=lambda n: -splits[n][0])[: spec.leaves - len(leaves)]
                break
            leaves.remove(best)
            leaves += [trial.left[best], trial.right[best]]
            order.append(best)
        if not missing:
            return _chosen(spec, trial, order, hist)
        small = {}
        for n in missing:
            _, k, b = splits[n]
            left, right = trial.split(n, k, b)
            below = hist[n][k, : b + 1, 2].sum()
            small[n] = left if 2 * below <= hist[n][k, :, 2].sum() else right
        got = children(trial, list(small.values()))
        for n, made in zip(missing, got, strict=True):
            a = small[n]
            b = trial.left[n] + trial.right[n] - a
            hist[a], hist[b] = made, hist[n] - made
            for c in (a, b):
                splits[c] = best_split(hist[c], spec.least_rows)


def _chosen(spec: Spec, trial: Tree, order: list[int], hist: dict[int, np.ndarray]) -> Tree:
    """The trial's splits in `order` alone, with the values of its leaves."""
    out, at = Tree(), {0: 0}
    for n in order:
        left, right = out.split(at[n], trial.feature[n], trial.cut[n])
        at |= {trial.left[n]: left, trial.right[n]: right}
    for n, k in at.items():
        if out.left[k] < 0:
            g, h, _ = hist[n][0].sum(axis=0)
            out.value[k] = -spec.rate * g / h if h > 0 else 0.0
    return out


def stops(spec: Spec, held: list[float]) -> bool:
    """Whether none of the last `patience` losses is below the one before them by more than the tolerance."""
    return spec.early_stop and len(held) > spec.patience and min(held[-spec.patience :]) >= held[-spec.patience - 1] - spec.tolerance


class _Rows:
    """The blocks and the trees that their scores don't have yet."""

    def __init__(self, spec: Spec, table: DataFrame, n_columns: int):
        self.spec, self.n, self.since = spec, n_columns, []
        self._use(table)

    def _use(self, table: DataFrame) -> None:
        self.table = table.persist()
        self.tasks = table._jdf.queryExecution().toRdd().getNumPartitions()

    def _jobs(self, work) -> np.ndarray:
        """The sum over all blocks of the array that work(bins, y, held, score) gives."""
        trees, n = list(self.since), self.n

        def run(it):
            from pyspark import TaskContext

            total = None
            for d in it:
                for row in d.itertuples(index=False):
                    bins = np.frombuffer(row.bins, np.uint8).reshape(-1, n)
                    score = np.frombuffer(row.score) + sum((t.predict(bins) for t in trees), np.zeros(len(bins)))
                    part = work(bins, np.frombuffer(row.y), np.frombuffer(row.held, bool), score)
                    total = part if total is None else total + part
            if total is not None:
                yield pd.DataFrame({"part": [TaskContext.get().partitionId() % FEW], "total": [total.tobytes()]})

        rows = self.table.mapInPandas(run, "part int, total binary")
        if self.tasks > FEW:
            add = lambda key, d: pd.DataFrame({"part": [key[0]], "total": [np.sum([np.frombuffer(v) for v in d["total"]], axis=0).tobytes()]})
            rows = rows.groupBy("part").applyInPandas(add, "part int, total binary")
        return np.sum([np.frombuffer(r["total"]) for r in rows.collect()], axis=0)

    def root(self) -> tuple[np.ndarray, float, float]:
        """The histogram of all rows but the held ones, and the latter's loss and number."""
        kind, n = self.spec.kind, self.n

        def work(bins, y, held, score):
            g, h = slopes(kind, score, y)
            hist = histograms(bins, np.where(held, -1, 0), g, h, 1)
            return np.r_[hist.ravel(), losses(kind, score[held], y[held]).sum(), held.sum()]

        got = self._jobs(work)
        return got[:-2].reshape(n, BINS + 1, 3), float(got[-2]), float(got[-1])

    def children(self, tree: Tree, nodes: list[int]) -> np.ndarray:
        kind, slots = self.spec.kind, np.full(len(tree.left), -1)
        slots[nodes] = np.arange(len(nodes))

        def work(bins, y, held, score):
            g, h = slopes(kind, score, y)
            return histograms(bins, np.where(held, -1, slots[tree.leaf(bins)]), g, h, len(nodes)).ravel()

        return self._jobs(work).reshape(len(nodes), self.n, BINS + 1, 3)

    def add(self, tree: Tree) -> None:
        self.since.append(tree)
        if len(self.since) < REWRITE:
            return
        trees, n = list(self.since), self.n

        def scored(it):
            for d in it:
                new = []
                for row in d.itertuples(index=False):
                    bins = np.frombuffer(row.bins, np.uint8).reshape(-1, n)
                    new.append((np.frombuffer(row.score) + sum((t.predict(bins) for t in trees), np.zeros(len(bins)))).tobytes())
                yield d.assign(score=new)

        old, self.since = self.table, []
        self._use(written(old.mapInPandas(scored, BLOCKS), "boosted"))
        old.unpersist()

    def close(self) -> None:
        self.table.unpersist()


class Boosting(Estimator):
    """Trains a Spec on columns x (a vector), y and held."""

    def __init__(self, spec: Spec):
        super().__init__()
        self.spec = spec

    def with_settings(self, settings: dict) -> Boosting:
        return Boosting(replace(self.spec, **settings))

    def _fit(self, dataset: DataFrame) -> BoostingModel:
        spec = self.spec
        rows = dataset.select(vector_to_array(F.col("x")).alias("x"), F.col("y").cast("double").alias("y"), "held")
        facts = rows.agg(F.avg(F.when(~F.col("held"), F.col("y"))).alias("mean"), F.first(F.size("x")).alias("d"), F.count("*").alias("n")).first()
        base = facts["mean"] or 0.0
        if spec.kind == "log":
            p = min(1 - 1e-15, max(1e-15, base))
            base = float(np.log(p / (1 - p)))
        columns = rows.select(*[F.col("x")[k].alias(f"c{k}") for k in range(facts["d"])])
        edges = [np.unique(q) for q in columns.approxQuantile(columns.columns, [k / BINS for k in range(1, BINS)], 1e-4)]

        def blocks(it):
            held_back: list[pd.DataFrame] = []

            def block(d: pd.DataFrame) -> pd.DataFrame:
                bins = binned(np.stack(d["x"].to_numpy()).astype(float), edges)
                y = d["y"].to_numpy(float)
                return pd.DataFrame({"bins": [bins.tobytes()], "y": [y.tobytes()], "held": [d["held"].to_numpy(bool).tobytes()], "score": [np.full(len(y), base).tobytes()]})

            for d in it:
                d = pd.concat([*held_back, d], ignore_index=True)
                whole = len(d) // BLOCK * BLOCK
                for at in range(0, whole, BLOCK):
                    yield block(d.iloc[at : at + BLOCK])
                held_back = [d.iloc[whole:]]
            if held_back and len(held_back[0]):
                yield block(held_back[0])

        tasks = rows._jdf.queryExecution().toRdd().getNumPartitions()
        full = rows.coalesce(max(1, min(tasks, -(-facts["n"] // BLOCK))))  # a task for each block at most: jobs are many and short
        data = _Rows(spec, written(full.mapInPandas(blocks, BLOCKS), "blocks"), facts["d"])
        trees, held = [], []
        try:
            for _ in range(spec.rounds):
                root, loss, n = data.root()
                held.append(loss / n if n else np.inf)
                if n and stops(spec, held):
                    break
                trees.append(grow(spec, root, data.children))
                data.add(trees[-1])
        finally:
            data.close()
        return BoostingModel(edges, base, trees, spec.kind)


class BoostingModel(Model):
    """Adds p: the second class's probability, or the predicted value."""

    def __init__(self, edges: list[np.ndarray], base: float, trees: list[Tree], kind: str):
        super().__init__()
        self.edges, self.base, self.trees, self.kind = edges, base, trees, kind

    def _transform(self, dataset: DataFrame) -> DataFrame:
        edges, base, trees, kind = self.edges, self.base, self.trees, self.kind

        def score(x: pd.Series) -> pd.Series:
            bins = binned(np.stack(x.to_numpy()).astype(float), edges)
            raw = base + sum((t.predict(bins) for t in trees), np.zeros(len(bins)))
            return pd.Series(raw if kind == "squared" else 1 / (1 + np.exp(-raw)))

        return dataset.withColumn("p", F.pandas_udf(score, "double")(vector_to_array(F.col("x"))))
