"""Toxicity: a classifier whose scores stay put when identity terms are swapped (counterfactual regularisation).

Features are the words of a text and their four- and five-letter beginnings, present or absent. The ones that labels
single out are chosen by a likelihood-ratio test; a logistic model on them is fitted with an extra penalty, the mean
squared change of a labelled text's logit when an identity term in it is swapped for another group's, or left out.

Training uses at most `cap` labelled rows, one for each id and of each group of near copies, and what it sends to the driver is
at most cap times max_features positions of 4 bytes; scoring covers every row and whole texts.
Defined cases: null and empty texts have no feature and get the base score; a very long text has each of its features once, so
its score has the same range, and it is cut into words in one piece; rows are scored one by one, so repeated rows
and ties get equal scores and null ids are kept; an empty table, or no label, gives scores of a model without features;
further columns, whatever they are called, are ignored or passed on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import back, free_names, held_out, hash_words, materialize, pick, shingle_sets, with_columns

#: Groups of terms that may stand for one another without changing whether a sentence is toxic.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "transgender"),
    ("woman", "man", "girl", "boy"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "bisexual", "straight"),
    ("immigrants", "foreigners", "refugees", "locals"),
    ("old", "young"),
    ("disabled", "deaf", "blind"),
    # German
    ("frauen", "männer", "mädchen", "jungen"), ("frau", "mann"), ("schwarze", "weiße", "asiaten", "latinos"),
    ("muslim", "christ", "jude", "hindu", "buddhist", "atheist"), ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwul", "lesbisch", "bisexuell", "heterosexuell"), ("einwanderer", "ausländer", "flüchtlinge", "einheimische"), ("behindert", "gehörlos", "blind"),
    # French
    ("femmes", "hommes", "filles", "garçons"), ("femme", "homme", "fille", "garçon"), ("noirs", "blancs", "asiatiques", "latinos"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"), ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("gay", "lesbienne", "bisexuel", "hétérosexuel"), ("immigrés", "étrangers", "réfugiés", "habitants"), ("handicapé", "sourd", "aveugle"),
    # Spanish
    ("mujeres", "hombres", "chicas", "chicos"), ("mujer", "hombre", "chica", "chico"), ("negros", "blancos", "asiáticos", "latinos"),
    ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo"), ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("gay", "lesbiana", "bisexual", "heterosexual"), ("inmigrantes", "extranjeros", "refugiados", "lugareños"), ("discapacitado", "sordo", "ciego"),
)
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5)


def vocabulary(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the tokens, and for each distinct token its three feature hashes."""
    codes, uniq = pd.factorize(np.array(tokens, dtype=object))
    own = [hash_words(list(uniq))]
    own += [hash_words([f"{n}\x00{w[:n]}" for w in uniq]) for n in PREFIXES]
    return codes, np.stack(own, axis=1).view(np.int64)


def blocks(texts: list[str | None], chars: int = 300_000) -> Iterator[tuple[int, list[list[str]]]]:
    """Runs of texts with about so many characters: the first position and each text's words."""
    i = 0
    while i < len(texts):
        j, n, found = i, 0, []
        while j < len(texts) and (j == i or n < chars):
            n += len(texts[j] or "")
            found.append(WORD.findall((texts[j] or "").lower()))
            j += 1
        yield i, found
        i = j


def present(found: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs of a block, as two arrays."""
    tokens = [w for ws in found for w in ws]
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes, hashes = vocabulary(tokens)
    rows = np.repeat(np.arange(len(found)), [len(ws) for ws in found])
    pairs = np.unique(rows.astype(np.int64) * (codes.max() + 1) + codes)
    rows, codes = np.divmod(pairs, codes.max() + 1)
    feats = hashes[codes].ravel()
    rows = np.repeat(rows, hashes.shape[1])
    order = np.lexsort((feats, rows))
    rows, feats = rows[order], feats[order]
    keep = np.r_[True, (rows[1:] != rows[:-1]) | (feats[1:] != feats[:-1])]
    return rows[keep], feats[keep]


@dataclass
class ToxicityModel:
    bias: float
    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # sorted
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def logits(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        if not len(self.features):
            return out
        for first, found in blocks(texts):
            rows, feats = present(found)
            at = np.searchsorted(self.features, feats).clip(max=len(self.features) - 1)
            hit = self.features[at] == feats
            np.add.at(out, first + rows[hit], self.weights[at[hit]])
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(texts).clip(-60, 60)))


def training_rows(docs: DataFrame, labels: DataFrame, cap: int) -> DataFrame:
    """(doc_id, text, label) of at most cap labelled rows: one for each id, and one of those that begin with equal shingles.

    Beyond cap, the ids with the smallest hashes are taken. Documents are read once, for the rows with such an id, and thinned to
    one an id before they are shuffled; these are written, so that nothing later reads documents again. At most cap ids are broadcast.
    """
    known = pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    if known.count() > cap:
        known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(cap)
    known = materialize(known, "toxicity-labels")

    def keyed(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            key = np.zeros(len(pdf), np.int64)
            for k, s in shingle_sets(pdf["text"].tolist()):
                key[k] = s[0].astype(np.int64) if len(s) else 0
            yield pdf.assign(key=key)

    own = pick(docs, "doc_id", "text").where("text is not null").join(F.broadcast(known), "doc_id")
    own = own.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m")).select("doc_id", "label", "m.text")
    written = materialize(own.mapInPandas(keyed, "doc_id long, label int, text string, key long"), "toxicity-rows")
    chosen = written.groupBy("key").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return written.join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", "text", "label")


def _counts(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        label = pdf["label"].to_numpy()
        for first, found in blocks(pdf["text"].tolist()):
            rows, feats = present(found)
            uniq, at = np.unique(feats, return_inverse=True)
            pos = np.bincount(at, weights=label[first + rows], minlength=len(uniq)).astype(np.int64)
            yield pd.DataFrame({"feature": uniq, "pos": pos, "n": np.bincount(at, minlength=len(uniq))})


def swaps(ws: list[str], groups=IDENTITY_TERMS) -> list[list[str]]:
    """The words with each identity term in them swapped: once for each other term of its group, and once left out."""
    found, present_terms = [], set(ws)
    for group in groups:
        for term in present_terms.intersection(group):
            found.append([w for w in ws if w != term])
            found += [[other if w == term else w for w in ws] for other in group if other != term]
    return found


def design(texts: list[str | None], chosen: np.ndarray, groups=IDENTITY_TERMS) -> tuple[list[list[int]], list[list[list[int]]]]:
    """For each text the positions of its chosen features, and the same for its counterfactuals that differ."""

    def positions(found: list[list[str]]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in found]
        rows, feats = present(found)
        at = np.searchsorted(chosen, feats).clip(max=max(len(chosen) - 1, 0))
        hit = chosen[at] == feats if len(chosen) else np.zeros(len(feats), bool)
        for r, a in zip(rows[hit].tolist(), at[hit].tolist(), strict=True):
            out[r].append(a)
        return out

    own: list[list[int]] = []
    other: list[list[list[int]]] = []
    for _, found in blocks(texts):
        for ws, x in zip(found, positions(found), strict=True):
            own.append(x)
            swapped = swaps(ws, groups)
            other.append([y for y in positions(swapped) if y != x] if swapped else [])
    return own, other


def fit_weights(x: list[list[int]], y: np.ndarray, cf: list[list[list[int]]], d: int, l2: float = 0.05, penalty: float = 20.0, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic loss summed over rows + l2/2 |w|^2 + penalty * n * mean over swaps of (w.x - w.x')^2, by accelerated descent."""
    n = len(y)
    if not n:
        return -3.0, np.zeros(d)
    rows = np.repeat(np.arange(n), [len(v) for v in x])
    cols = np.array([c for v in x for c in v], np.int64)
    diff: dict[tuple, int] = {}
    for v, others in zip(x, cf, strict=True):
        for o in others:
            gone, came = sorted(set(v) - set(o)), sorted(set(o) - set(v))
            if gone or came:
                k = (tuple(gone), tuple(came))
                diff[k] = diff.get(k, 0) + 1
    total = sum(diff.values())
    pairs = [(list(g), list(c), m * penalty * n / total) for (g, c), m in diff.items()]
    # A bound of the curvature along each coordinate block gives the step; features are scaled by their counts.
    scale = 1 / np.sqrt(np.bincount(cols, minlength=d) / 4 + l2)
    if pairs:
        heavy = np.zeros(d)
        for g, c, m in pairs:
            heavy[g + c] += 2 * m * len(g + c)
        scale = 1 / np.sqrt(np.bincount(cols, minlength=d) / 4 + l2 + heavy)
    scale0 = 1 / np.sqrt(n / 4 + 1e-9)
    most = 1 + max((len(v) for v in x), default=0)

    def grad(b: float, w: np.ndarray) -> tuple[float, np.ndarray]:
        z = b + np.bincount(rows, weights=w[cols], minlength=n)
        r = 1 / (1 + np.exp(-z.clip(-60, 60))) - y
        g = np.bincount(cols, weights=r[rows], minlength=d) + l2 * w
        for gone, came, m in pairs:
            delta = w[gone].sum() - w[came].sum()
            g[gone] += 2 * m * delta
            g[came] -= 2 * m * delta
        return float(r.sum()), g

    base = float(np.clip(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)), -6, 6))
    b, w, vb, vw, t = base, np.zeros(d), base, np.zeros(d), 1.0
    step = 1.0 / min(most, 8)
    for _ in range(steps):
        gb, gw = grad(vb, vw)
        nb, nw = vb - step * scale0**2 * gb, vw - step * scale**2 * gw
        if (gb * (nb - b) + gw @ (nw - w)) > 0:  # restart where momentum points uphill
            t, vb, vw = 1.0, b, w
            gb, gw = grad(vb, vw)
            nb, nw = vb - step * scale0**2 * gb, vw - step * scale**2 * gw
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vb, vw = nb + (t - 1) / t2 * (nb - b), nw + (t - 1) / t2 * (nw - w)
        b, w, t = nb, nw, t2
    return b, w


def train(docs: DataFrame, labels: DataFrame, cap: int = 40_000, max_features: int = 3_000, least_g2: float = 16.0, groups=IDENTITY_TERMS, penalty: float = 20.0) -> ToxicityModel:
    """Fit on at most cap labelled rows that aren't held out; at most max_features features get a weight."""
    rows = training_rows(docs, labels, cap)
    n, p = rows.agg(F.count("*"), F.sum("label")).first()
    p = p or 0
    if not n:
        return ToxicityModel(bias=-3.0)
    counts = rows.mapInPandas(_counts, "feature long, pos long, n long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    rate = (p + 0.5) / (n + 1)
    a, m = F.col("pos"), F.col("n")
    share = (a + 1e-9) / m
    g2 = 2 * (a * F.log(share / rate) + F.when(m > a, (m - a) * F.log((1 - share) / (1 - rate))).otherwise(0.0))
    chosen = counts.where((a >= 3) & (share > 2 * rate)).withColumn("g2", g2).where(F.col("g2") >= least_g2)
    chosen = np.sort(np.array([r[0] for r in chosen.orderBy(F.desc("g2"), "feature").limit(max_features).select("feature").collect()], np.int64))

    def designed(it):
        for pdf in it:
            x, cf = design(pdf["text"].tolist(), chosen, groups)
            yield pd.DataFrame({"label": pdf["label"], "x": x, "cf": cf})

    got = rows.mapInPandas(designed, "label int, x array<int>, cf array<array<int>>").toPandas()
    # rows arrive in any order; a fixed one makes the fit repeatable to the last bit
    data = sorted((list(map(int, x)), int(y), [list(map(int, c)) for c in cf]) for x, y, cf in zip(got["x"], got["label"], got["cf"], strict=True))
    b, w = fit_weights([r[0] for r in data], np.array([r[1] for r in data], float), [r[2] for r in data], len(chosen), penalty=penalty)
    return ToxicityModel(b, chosen, w)


def score(docs: DataFrame, model: ToxicityModel, *keep: str) -> DataFrame:
    """The columns named by keep, and `score`: one row for each row of docs."""
    return with_columns(docs, list(keep), "text", "score double", lambda texts: [model.scores(texts)])


def toxicity(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.5 on): one row for each document."""
    got = score(docs, train(docs, labels, **how), "doc_id")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, limit: float = 0.5, **how) -> DataFrame:
    """The documents that score below limit, with all their columns."""
    names, model = docs.columns, train(docs, labels, **how)
    (score,) = free_names(docs, "score")
    scored = with_columns(docs, names, "text", f"{score} double", lambda texts: [model.scores(texts)])
    return scored.where(F.col(score) < limit).select(*back(names))
