"""Quality classifier: random Fourier features of document statistics, ridge by normal equations, isotonic calibration.

Each text becomes some thirty statistics (length, letters, symbols, repetition, and the worst block of fifty words).
Random Fourier features of the standardised statistics approximate a Gaussian kernel. Every partition sums its share of
the normal equations, the sums are added up in a tree, and the driver solves one system of fixed size. Raw scores
of labelled rows that the fit has not seen, counted in 2,048 bins, are then calibrated by isotonic regression.

Defined cases: null and empty texts have zero statistics and are scored like any other; a very long text is read whole, as its
statistics are shares and logarithms, and the worst block of fifty words; rows are scored one by one, so
repeated rows score alike and null ids are kept; without labels every score is 0.5; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import held_out, materialize, pick, with_columns

SYMBOLS = frozenset("#*$%&|<>@^~_={}[]\\/+")
_PUNCT = ".,;:!?"
BLOCK = 50
N_STATS = 27
ADDED_IN = (4096, 64, 8)


def statistics(text: str | None) -> list[float]:
    """The N_STATS statistics of one text; all 0 without a word."""
    ws = text.split() if text else []
    n = len(ws)
    if not n:
        return [0.0] * N_STATS
    chars = len(text)
    lengths = np.fromiter(map(len, ws), np.float64, n)
    word_chars = float(lengths.sum())
    counts = Counter(ws)
    caps = np.fromiter((w.isupper() and len(w) > 1 for w in ws), bool, n)
    symbol = np.fromiter((w[-1] in SYMBOLS or w[0] in SYMBOLS for w in ws), bool, n)
    bang = np.fromiter((w[-1] == "!" for w in ws), bool, n)
    stop = np.fromiter((w[-1] in ".?!" for w in ws), bool, n)
    codes = pd.factorize(np.array(ws, dtype=object))[0]
    same = np.r_[False, codes[1:] == codes[:-1]]
    cuts = np.arange(0, n, BLOCK)
    size = np.diff(np.r_[cuts, n]).clip(min=min(n, BLOCK / 2))
    worst = [float((np.add.reduceat(f.astype(float), cuts) / size).max()) for f in (caps, symbol, bang, same)]
    tri = codes[:-2].astype(np.int64) * (n * n) % (1 << 61) + codes[1:-1] * n + codes[2:] if n > 2 else codes[:0]
    repeat = 1 - len(np.unique(tri)) / len(tri) if len(tri) else 0.0
    lines = [x for x in text.split("\n") if x.strip()]
    ascii_text = text.isascii()
    symbols = sum(text.count(c) for c in SYMBOLS)
    punct = [text.count(c) for c in _PUNCT]
    digits = sum(text.count(c) for c in "0123456789")
    top = counts.most_common(1)[0][1]
    return [
        math.log1p(chars), math.log1p(n), word_chars / n, float(lengths.std()), math.log1p(float(lengths.max())),
        float(caps.mean()), float(symbol.mean()), float(bang.mean()), float(same.mean()), *worst,
        len(counts) / n, len(counts) / math.sqrt(n), top / n, repeat, 1 - len(set(lines)) / max(1, len(lines)), math.log1p(len(lines)), math.log1p(n / max(1, len(lines))),
        symbols / chars, sum(punct) / chars, punct[4] / chars, digits / chars, float(stop.mean()), 1 - word_chars / chars, float(ascii_text),
    ]


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    return with_columns(docs, list(keep), "text", "stats array<float>", lambda texts: [[statistics(t) for t in texts]])


@dataclass
class Fourier:
    """x -> (1, z, sqrt(2/d) cos(w z + phase)) of the standardised statistics z, cut at 5 deviations."""

    mean: np.ndarray
    std: np.ndarray
    w: np.ndarray
    phase: np.ndarray

    @classmethod
    def of(cls, mean: np.ndarray, std: np.ndarray, d: int, gamma: float, seed: int) -> "Fourier":
        rng = np.random.default_rng(seed)
        return cls(mean, np.where(std > 1e-9, std, 1.0), rng.normal(0, math.sqrt(2 * gamma), (len(mean), d)), rng.uniform(0, 2 * math.pi, d))

    def __call__(self, stats: list) -> np.ndarray:
        x = np.stack([np.asarray(s, float) for s in stats]) if len(stats) else np.zeros((0, len(self.mean)))
        z = ((x - self.mean) / self.std).clip(-5, 5)
        return np.hstack([np.ones((len(z), 1)), z, math.sqrt(2 / len(self.phase)) * np.cos(z @ self.w + self.phase)])


def pool(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Isotonic regression of values (in order) by pooling adjacent violators."""
    stack: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        stack.append([v, w, 1])
        while len(stack) > 1 and stack[-2][0] >= stack[-1][0]:
            v2, w2, k2 = stack.pop()
            v1, w1, k1 = stack.pop()
            stack.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, k1 + k2])
    return np.repeat([s[0] for s in stack], [int(s[2]) for s in stack])


@dataclass
class QualityModel:
    fourier: Fourier | None
    beta: np.ndarray | None
    knots: np.ndarray  # raw scores
    heights: np.ndarray  # calibrated there

    def raw(self, stats: list) -> np.ndarray:
        return self.fourier(stats) @ self.beta

    def scores(self, stats: list) -> np.ndarray:
        """Between knots the calibrated score is interpolated; a small share of the raw score keeps the order within a step."""
        if self.fourier is None or not len(stats):
            return np.full(len(stats), 0.5)
        raw = self.raw(stats)
        return (0.998 * np.interp(raw, self.knots, self.heights) + 0.002 / (1 + np.exp(-4 * (raw - 0.5).clip(-10, 10)))).clip(0, 1)


def train(known: DataFrame, d: int = 320, gamma: float = 0.02, ridge: float = 1e-3, seed: int = 7, bins: int = 2048) -> QualityModel:
    """known: (doc_id, stats, label) of the rows that may be learnt from. One quarter of them only calibrates."""
    known = known.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(4)))
    moments = known.select(F.posexplode("stats").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).toPandas().sort_values("k")
    if moments.empty:
        return QualityModel(None, None, np.array([0.0]), np.array([0.5]))
    fourier = Fourier.of(moments["m"].to_numpy(), moments["s"].to_numpy(), d, gamma, seed)
    width = 1 + len(moments) + d

    def summed(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        a, b, n = np.zeros((width, width)), np.zeros(width), 0
        for pdf in it:
            for k in range(0, len(pdf), 4096):
                part = pdf.iloc[k : k + 4096]
                x = fourier(part["stats"].tolist())
                a += x.T @ x
                b += x.T @ part["label"].to_numpy(float)
                n += len(part)
        if n:
            yield pd.DataFrame({"slot": [TaskContext.get().partitionId()], "n": [n], "ab": [np.vstack([a, b]).tobytes()]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in pdf["ab"])
        return pd.DataFrame({"slot": pdf["slot"][:1], "n": [pdf["n"].sum()], "ab": [total.tobytes()]})

    schema = "slot int, n long, ab binary"
    sums = known.where("fold > 0").mapInPandas(summed, schema)
    for slots in ADDED_IN:  # a tree: no task adds more than a few dozen matrices, at up to 250,000 partitions
        sums = sums.withColumn("slot", F.col("slot") % slots).groupBy("slot").applyInPandas(added, schema)
    sums = sums.collect()
    if not sums:
        return QualityModel(None, None, np.array([0.0]), np.array([0.5]))
    n, ab = sum(r["n"] for r in sums), sum(np.frombuffer(r["ab"]) for r in sorted(sums, key=lambda r: r["slot"])).reshape(width + 1, width)
    penalty = ridge * n * np.r_[0.0, np.ones(width - 1)] + 1e-9
    beta = np.linalg.solve(ab[:-1] + np.diag(penalty), ab[-1])
    model = QualityModel(fourier, beta, np.array([0.0]), np.array([0.5]))

    def rawly(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"raw": model.raw(pdf["stats"].tolist()), "label": pdf["label"]})

    at = F.floor((F.least(F.greatest(F.col("raw"), F.lit(-0.5)), F.lit(1.499)) + 0.5) / 2 * bins)
    binned = known.where("fold = 0").mapInPandas(rawly, "raw double, label int").groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("label").alias("y"), F.avg("raw").alias("raw")).toPandas().sort_values("bin")
    if len(binned):
        # one row of each label, far out on either side, keeps a perfect split from scores of exactly 0 or 1
        y, w = np.r_[0.0, binned["y"], 1.0], np.r_[0.5, binned["n"], 0.5]
        model.knots = np.r_[-0.5, binned["raw"], 1.5]
        model.heights = pool(y, w)
    return model


def quality(docs: DataFrame, labels: DataFrame, limit: float = 0.3, **how) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of limit on): one row for each document.

    Texts are read once; their statistics are written to the shared folder and used for the fit and for the scores.
    """
    stats = materialize(with_statistics(docs, "doc_id"), "quality-stats")
    known = pick(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    model = train(stats.join(known, "doc_id"), **how)

    got = with_columns(stats, ["doc_id"], "stats", "score double", lambda rows: [model.scores(rows)], rows=4096)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
