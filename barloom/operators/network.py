"""Feed-forward networks trained on rows that stay where they are.

Rows are dealt by a digest of their keys to the batches of an epoch and written by batch. One step of the optimiser is one job over one
batch: each task runs its rows in chunks of CHUNK through the network, sums loss, gradients and the moments that batch normalisation
needs, and gives one row; those are summed in two steps. The weights, some ten thousand numbers whatever the data, are all that the driver
holds. A batch of at most CHUNK rows is one chunk. There are at most MOST_STEPS batches in an epoch, so with more rows a batch is larger and made
of several chunks, each normalised by its own mean and spread as on one machine of many.

The last tenth of each series' rows is for validation: every epoch the area under the curve (over 200 thresholds) or the loss there
decides when the learning rate is halved and when to stop; the weights of the best epoch stay.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.exprs import KEYS
from barloom.sources.shared import fresh_path

CHUNK, MOST_STEPS = 1024, 32
THRESHOLDS = 200
BN_KEEP, BN_EPS = 0.99, 1e-3


@dataclass(frozen=True)
class Spec:
    """What distinguishes the models. kind: sigmoid, softmax or linear; monitor: auc or loss."""

    kind: str = "sigmoid"
    n_out: int = 1
    hidden: tuple[int, ...] = (128, 64, 32)
    dropout: tuple[float, ...] = (0.2, 0.2, 0.1)
    layer_norm: bool = False
    weight_decay: float = 0.0
    class_weights: bool = True
    monitor: str = "auc"
    patience: int = 5
    epochs: int = 50
    rate: float = 1e-3
    least_rate: float = 1e-5
    seed: int = 42


MODELS = {
    "tf_mlp_baseline": Spec(),
    "tf_mlp_bn_wd": Spec(layer_norm=True, weight_decay=1e-4, patience=6, epochs=60),
    "tf_mlp_multiclass": Spec(class_weights=False, monitor="loss", patience=6),
    "tf_mlp_regressor": Spec(kind="linear", class_weights=False, monitor="loss", patience=6),
}

Arrays = dict[str, np.ndarray]


def start(spec: Spec, n_in: int) -> tuple[Arrays, Arrays]:
    """Trained arrays (uniform kernels by Glorot's rule), and the running moments of each normalised layer."""
    rng, sizes = np.random.default_rng(spec.seed), (n_in, *spec.hidden)
    uniform = lambda a, b: rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b))
    w: Arrays = {"in_scale": np.ones(n_in), "in_shift": np.zeros(n_in)} if spec.layer_norm else {}
    moments: Arrays = {}
    for k, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False)):
        w |= {f"kernel{k}": uniform(a, b), f"scale{k}": np.ones(b), f"shift{k}": np.zeros(b)}
        moments |= {f"mean{k}": np.zeros(b), f"var{k}": np.ones(b)}
    return w | {"kernel_out": uniform(sizes[-1], spec.n_out), "bias_out": np.zeros(spec.n_out)}, moments


def _standard(x: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    centred = x - x.mean(axis=axis, keepdims=True)
    inverse = 1 / np.sqrt((centred**2).mean(axis=axis, keepdims=True) + BN_EPS)
    return centred * inverse, inverse


def _output(spec: Spec, z: np.ndarray) -> np.ndarray:
    if spec.kind == "linear":
        return z
    if spec.kind == "sigmoid":
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def predicted(spec: Spec, w: Arrays, moments: Arrays, x: np.ndarray) -> np.ndarray:
    """Rows by outputs, with the running moments and without dropout."""
    if spec.layer_norm:
        x = _standard(x, 1)[0] * w["in_scale"] + w["in_shift"]
    for k in range(len(spec.hidden)):
        z = (x @ w[f"kernel{k}"] - moments[f"mean{k}"]) / np.sqrt(moments[f"var{k}"] + BN_EPS)
        x = np.maximum(z * w[f"scale{k}"] + w[f"shift{k}"], 0)
    return _output(spec, x @ w["kernel_out"] + w["bias_out"])


def losses(spec: Spec, p: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row: squared error, or minus the log of its class's probability."""
    if spec.kind == "linear":
        return (p[:, 0] - y) ** 2
    own = np.where(y == 1, p[:, 0], 1 - p[:, 0]) if spec.kind == "sigmoid" else p[np.arange(len(y)), y.astype(int)]
    return -np.log(np.clip(own, 1e-7, 1.0))


def gradients(spec: Spec, w: Arrays, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> tuple[float, Arrays, Arrays]:
    """The weighted loss of one chunk, its gradient, and the chunk's moments."""
    kept, moments, grad = [], {}, {}
    if spec.layer_norm:
        x0 = _standard(x, 1)[0]
        x = x0 * w["in_scale"] + w["in_shift"]
    for k, drop in enumerate(spec.dropout):
        z = x @ w[f"kernel{k}"]
        moments |= {f"mean{k}": z.mean(axis=0), f"var{k}": z.var(axis=0)}
        unit, inverse = _standard(z, 0)
        a = unit * w[f"scale{k}"] + w[f"shift{k}"]
        mask = (rng.random(a.shape) >= drop) / (1 - drop) * (a > 0)
        kept.append((x, unit, inverse, mask))
        x = a * mask
    p = _output(spec, x @ w["kernel_out"] + w["bias_out"])
    wanted = y[:, None] if spec.kind != "softmax" else np.eye(spec.n_out)[y.astype(int)]
    d = (p - wanted) * weight[:, None] * (2.0 if spec.kind == "linear" else 1.0)
    grad |= {"kernel_out": x.T @ d, "bias_out": d.sum(axis=0)}
    d = d @ w["kernel_out"].T
    for k in reversed(range(len(kept))):
        x, unit, inverse, mask = kept[k]
        d = d * mask
        grad |= {f"scale{k}": (d * unit).sum(axis=0), f"shift{k}": d.sum(axis=0)}
        d = d * w[f"scale{k}"]
        d = inverse * (d - d.mean(axis=0) - unit * (d * unit).mean(axis=0))
        grad[f"kernel{k}"] = x.T @ d
        d = d @ w[f"kernel{k}"].T
    if spec.layer_norm:
        grad |= {"in_scale": (d * x0).sum(axis=0), "in_shift": d.sum(axis=0)}
    return float((losses(spec, p, y) * weight).sum()), grad, moments


def packed(a: Arrays) -> np.ndarray:
    return np.concatenate([a[k].ravel() for k in sorted(a)])


def unpacked(flat: np.ndarray, like: Arrays) -> Arrays:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


@dataclass
class Adam:
    """The usual moments; decay shrinks all weights by rate * decay before each step."""

    rate: float
    decay: float = 0.0
    steps: int = 0
    first: np.ndarray | float = 0.0
    second: np.ndarray | float = 0.0

    def step(self, flat: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.steps += 1
        self.first = 0.9 * self.first + 0.1 * g
        self.second = 0.999 * self.second + 0.001 * g * g
        size = self.rate * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        return flat * (1 - self.rate * self.decay) - size * self.first / (np.sqrt(self.second) + 1e-7)


def area(ones: np.ndarray, zeros: np.ndarray) -> float:
    """The area under the curve from the numbers of ones and zeros in each of THRESHOLDS steps of the score; 0 without both."""
    tp, fp = np.cumsum(ones[::-1]), np.cumsum(zeros[::-1])
    if not tp[-1] or not fp[-1]:
        return 0.0
    return float(np.trapezoid(np.r_[0, tp / tp[-1]], np.r_[0, fp / fp[-1]]))


class Watch:
    """What an epoch's score on the held rows decides: the best epoch, the learning rate, and the end."""

    def __init__(self, spec: Spec):
        self.spec, self.best, self.waited, self.plateau, self.flat, self.weights = spec, -np.inf, 0, -np.inf, 0, None

    def after(self, score: float, optimiser: Adam, weights) -> bool:
        """score: more is better. True where training ends."""
        if score > self.plateau + 1e-4:
            self.plateau, self.flat = score, 0
        else:
            self.flat += 1
            if self.flat >= 3:
                optimiser.rate, self.flat = max(optimiser.rate / 2, self.spec.least_rate), 0
        if score > self.best:
            self.best, self.waited, self.weights = score, 0, weights
        else:
            self.waited += 1
        return self.waited >= self.spec.patience


def _summed(parts: DataFrame, columns: dict[str, int]) -> dict[str, np.ndarray]:
    """The sums of array columns over all tasks' rows (part, one binary of doubles for each column), in two steps."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [0], **{c: [np.sum([np.frombuffer(v) for v in rows[c]], axis=0).tobytes()] for c in columns}})

    schema = "part int, " + ", ".join(f"{c} binary" for c in columns)
    rows = parts.groupBy(F.col("part") % 16).applyInPandas(lambda key, d: add(d), schema).collect()
    return {c: np.sum([np.frombuffer(r[c]) for r in rows], axis=0) if rows else np.zeros(n) for c, n in columns.items()}


def _matrix(d: pd.DataFrame) -> np.ndarray:
    return np.stack(d["x"].to_numpy()).astype(float) if len(d) else np.zeros((0, 0))


class Network(Estimator):
    """Trains a Spec on columns x (a vector), y (or label, for classes) and the keys."""

    def __init__(self, spec: Spec, label: str = "y"):
        super().__init__()
        self.spec, self.label = spec, label

    def with_settings(self, settings: dict) -> Network:
        return Network(replace(self.spec, **settings), self.label)

    def _fit(self, dataset: DataFrame) -> NetworkModel:
        spec, spark = self.spec, dataset.sparkSession
        w = Window.partitionBy("series_id")
        place = F.row_number().over(w.orderBy("bar_idx")) > F.ceil(F.count("*").over(w) * 0.9)
        rows = dataset.select(*KEYS, vector_to_array(F.col("x")).alias("x"), F.col(self.label).cast("double").alias("y"), place.alias("held"))
        facts = dataset.agg(F.count("*").alias("n"), F.avg(self.label).alias("mean"), F.first(F.size(vector_to_array(F.col("x")))).alias("d")).first()
        weights = (1.0, 1.0)
        if spec.class_weights and 0 < facts["mean"] < 1:
            limit = lambda v: min(4.0, max(0.25, v))
            weights = limit(0.5 / max(1e-6, 1 - facts["mean"])), limit(0.5 / max(1e-6, facts["mean"]))
        steps = int(max(1, min(MOST_STEPS, -(-facts["n"] * 0.9 // CHUNK))))
        dealt = rows.withColumn("batch", F.when(F.col("held"), -1).otherwise(F.pmod(F.xxhash64(*KEYS), F.lit(steps))).cast("int"))
        path = fresh_path(spark, "batches")
        dealt.select("x", "y", "batch").write.partitionBy("batch").parquet(path)
        table = spark.read.schema("x array<double>, y double, batch int").parquet(path)
        arrays, moments = start(spec, facts["d"])
        optimiser, watch = Adam(spec.rate, spec.weight_decay), Watch(spec)
        for epoch in range(spec.epochs):
            for k in np.random.default_rng([spec.seed, epoch]).permutation(steps).tolist():
                got = self._step(table.where(F.col("batch") == k), arrays, moments, weights, epoch)
                n, chunks = got["size"]
                if n:
                    arrays = unpacked(optimiser.step(packed(arrays), got["grad"] / n), arrays)
                    fresh = unpacked(got["moments"] / chunks, moments)
                    moments = {m: BN_KEEP * moments[m] + (1 - BN_KEEP) * fresh[m] for m in moments}
            if watch.after(self._score(table.where("batch = -1"), arrays, moments), optimiser, (arrays, moments)):
                break
        arrays, moments = watch.weights or (arrays, moments)
        return NetworkModel(spec, arrays, moments)

    def _step(self, batch: DataFrame, arrays: Arrays, moments: Arrays, weights: tuple[float, float], epoch: int) -> dict[str, np.ndarray]:
        spec = self.spec

        def run(it):
            from pyspark import TaskContext

            part, grad, moment, size, held = TaskContext.get().partitionId(), 0.0, 0.0, np.zeros(2), []
            rng = np.random.default_rng([spec.seed, epoch, part])

            def chunk(d: pd.DataFrame) -> None:
                nonlocal grad, moment, size
                y = d["y"].to_numpy(float)
                weight = np.where(y == 1, weights[1], weights[0]) if spec.class_weights else np.ones(len(y))
                _, g, m = gradients(spec, arrays, _matrix(d), y, weight, rng)
                grad, moment, size = grad + packed(g), moment + packed(m), size + (len(d), 1)

            for d in it:
                d = pd.concat([*held, d], ignore_index=True)
                whole = len(d) // CHUNK * CHUNK
                for at in range(0, whole, CHUNK):
                    chunk(d.iloc[at : at + CHUNK])
                held = [d.iloc[whole:]]
            if held and len(held[0]):
                chunk(held[0])
            if size[0]:
                yield pd.DataFrame({"part": [part], "grad": [grad.tobytes()], "moments": [moment.tobytes()], "size": [size.tobytes()]})

        parts = batch.select("x", "y").mapInPandas(run, "part int, grad binary, moments binary, size binary")
        return _summed(parts, {"grad": packed(arrays).size, "moments": packed(moments).size, "size": 2})

    def _score(self, held: DataFrame, arrays: Arrays, moments: Arrays) -> float:
        """The area under the curve, or minus the mean loss, of the held rows."""
        spec = self.spec

        def run(it):
            from pyspark import TaskContext

            ones, zeros, loss = np.zeros(THRESHOLDS), np.zeros(THRESHOLDS), np.zeros(2)
            for d in it:
                if len(d):
                    p, y = predicted(spec, arrays, moments, _matrix(d)), d["y"].to_numpy(float)
                    loss += losses(spec, p, y).sum(), len(d)
                    bins = np.clip((p[:, 0] * THRESHOLDS).astype(int), 0, THRESHOLDS - 1) if spec.monitor == "auc" else np.zeros(len(y), int)
                    ones, zeros = ones + np.bincount(bins[y == 1], minlength=THRESHOLDS), zeros + np.bincount(bins[y != 1], minlength=THRESHOLDS)
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "ones": [ones.tobytes()], "zeros": [zeros.tobytes()], "loss": [loss.tobytes()]})

        got = _summed(held.select("x", "y").mapInPandas(run, "part int, ones binary, zeros binary, loss binary"), {"ones": THRESHOLDS, "zeros": THRESHOLDS, "loss": 2})
        return area(got["ones"], got["zeros"]) if spec.monitor == "auc" else -got["loss"][0] / max(1.0, got["loss"][1])


@dataclass
class _Fitted:
    spec: Spec
    arrays: Arrays = field(default_factory=dict)
    moments: Arrays = field(default_factory=dict)


class NetworkModel(Model):
    """Adds p: the second class's probability, an array of all classes', or the predicted value."""

    def __init__(self, spec: Spec, arrays: Arrays, moments: Arrays):
        super().__init__()
        self.fitted = _Fitted(spec, arrays, moments)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        f = self.fitted
        many = f.spec.kind == "softmax"

        def score(x: pd.Series) -> pd.Series:
            p = predicted(f.spec, f.arrays, f.moments, np.stack(x.to_numpy()).astype(float))
            return pd.Series(list(p)) if many else pd.Series(p[:, 0])

        scored = F.pandas_udf(score, "array<double>" if many else "double")
        return dataset.withColumn("p", scored(vector_to_array(F.col("x"))))
