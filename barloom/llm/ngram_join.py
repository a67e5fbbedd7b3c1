"""N-gram Jaccard join of documents with themselves: Bayesian pruning of MinHash candidates, then exact verification.

1. Each text becomes its set of five-word shingles. Equal sets are one class, found by a 128-bit digest; from here on only
   one copy of each class is looked at.
2. MinHash values in BANDS bands of ROWS put classes into buckets. Within a bucket, pairs compare their values step by step
   and are dropped once the posterior probability of reaching the threshold, under a uniform prior, is below TOLERANCE.
   Pairs that survive are kept as a star for each group they connect, so a bucket gives one edge a member at most.
3. Connected survivors are brought together once, with their shingles. All their pairs are pruned in the same way and the
   rest verified exactly. Pairs are counted where they are found and never written out; links leave as stars again.
4. Connected components of exact links are the groups.

Members of a bucket or cluster are dealt into blocks, and each pair of blocks is its own task row group: a bucket with a third
of all rows becomes many tasks, and no pair of blocks is skipped. A block holds BLOCK members, or more where that would make
over MOST_BLOCKS of them, but no more than about BLOCK_BYTES of shingles: a member is sent to as many groups as there are
blocks. Equal copies are never paired: they count by
their number. A pair at the threshold of 0.8 itself shares no band with a chance of 3e-6 and is pruned, over all bars together, with
one of 7.6e-6 (at 0.82 1.5e-6).

Defined cases: a text of one to four words is one shingle; null and empty texts link to nothing and are alone in their
group; a group's id is its smallest doc_id (null where it has none); repeated rows and equal ids are separate documents;
very long texts make small blocks, so that two of them fit in a task; an empty table gives an empty result; further columns,
whatever they are called, are ignored or passed on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import SIMILARITY, back, free_names, materialize, mix, shingle_sets, with_columns
from barloom.llm.components import components

BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
TOLERANCE = 1e-6
STEP = 16
BLOCK = 256
MOST_BLOCKS = 32
BLOCK_BYTES = 16 << 20
BROADCAST_ROWS = 1_000_000


def hash_family(k: int = HASHES, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 63, k, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, k, dtype=np.uint64)


_A, _B = hash_family()


def signature(s: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of 32 bits."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(0, len(s), 8192):
            x = s[k : k + 8192, None] * _A[None, :] + _B[None, :]
            out = np.minimum(out, (x >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, by two sums of mixed members."""
    with np.errstate(over="ignore"):
        hi = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))
        lo = mix(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return int(hi.view(np.int64)), int(lo.view(np.int64))


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(n, BANDS) keys of (n, HASHES) signatures."""
    with np.errstate(over="ignore"):
        x = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
        h = np.zeros((len(sig), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)[None, :]
        for r in range(ROWS):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x[:, :, r])
    return h.view(np.int64)


def _beta_tail(m: int, n: int, t: float) -> float:
    """P(J >= t) after m of n values agreed, under a uniform prior: 1 - I_t(m+1, n-m+1), as a binomial sum."""
    return sum(math.comb(n + 1, k) * t**k * (1 - t) ** (n + 1 - k) for k in range(0, m + 1))


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """After each STEP values, the least number that must agree for a pair to stay."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        out.append((n, next((m for m in range(n + 1) if _beta_tail(m, n, threshold) >= tolerance), n)))
    return out


def survivors(x: np.ndarray, y: np.ndarray, bars: list[tuple[int, int]], upper: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of x and y that pass every bar; only i < j where upper."""
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first in range(0, len(x), 256):
        part = x[first : first + 256]
        same = np.zeros((len(part), len(y)), np.int16)
        for c in range(STEP):
            same += part[:, c, None] == y[None, :, c]
        keep = same >= bars[0][1]
        if upper:
            keep &= (first + np.arange(len(part)))[:, None] < np.arange(len(y))[None, :]
        i, j = np.nonzero(keep)
        agreed = same[i, j].astype(np.int32)
        for (n, least), (before, _) in zip(bars[1:], bars, strict=False):
            agreed = agreed + (part[i, before:n] == y[j, before:n]).sum(axis=1)
            ok = agreed >= least
            i, j, agreed = i[ok], j[ok], agreed[ok]
        out_i.append(i + first)
        out_j.append(j)
    return np.concatenate(out_i), np.concatenate(out_j)


def stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position that each of n positions is connected to by the pairs."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        new = root.copy()
        np.minimum.at(new, hi, lo)
        while not np.array_equal(new, new[new]):
            new = new[new]
        root = new[root]
        differ = root[i] != root[j]
        i, j = i[differ], j[differ]
    return root


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, hi, lo, n_shingles, sig for each row; without a word, n_shingles is 0."""

    def fn(texts):
        out = []
        for _, s in shingle_sets(texts):
            out.append((*digest(s), len(s), signature(s).tobytes() if len(s) else None))
        return list(zip(*out, strict=True)) if out else [[], [], [], []]

    return with_columns(docs, ["doc_id"], "text", "hi long, lo long, n_shingles int, sig binary", fn)


def n_blocks(m: Column, shingles: Column) -> Column:
    """How many blocks m members with so many shingles in all are dealt into."""
    rows = F.greatest(F.lit(BLOCK), F.ceil(m / MOST_BLOCKS))
    return F.greatest(F.ceil(m / rows), F.ceil(shingles * 8 / BLOCK_BYTES)).cast("int")


def block_pairs(members: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """The members (node, key) of the keys in sizes (key, nb), dealt into nb blocks; each once for each pair of blocks it is in.

    Adds i, j (the pair, i <= j) and side (0: of block i; 1: of block j, where i < j). With one block no row is repeated.
    """
    own = members.join(sizes.select(key, "nb"), key)
    own = own.withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return other.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}).drop("own", "other", "nb")


def _signatures(pdf: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(len(pdf), HASHES)


def _bucket_stars(bars, pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges (a, b) of the stars of surviving pairs in one pair of blocks of one bucket."""
    pdf = pdf.sort_values(["side", "node"], ignore_index=True)
    sig, left = _signatures(pdf), int((pdf["side"] == 0).sum())
    if pdf["i"].iat[0] == pdf["j"].iat[0]:
        i, j = survivors(sig, sig, bars, True)
    else:
        i, j = survivors(sig[:left], sig[left:], bars, False)
        j = j + left
    root = stars(len(pdf), i, j)
    node = pdf["node"].to_numpy()
    moved = root != np.arange(len(pdf))
    return pd.DataFrame({"a": node[moved], "b": node[root[moved]]})


def jaccard_pairs(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact Jaccard similarity of the given pairs. Shingles are numbered; runs of pairs with one left member are counted at once."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros(len(i))
    if not len(i):
        return out
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    ends = np.cumsum(sizes)
    mark = np.zeros(int(ids.max()) + 1, bool)
    order = np.argsort(i, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(i[order]) > 0, True])
    for c, d in zip(cuts[:-1], cuts[1:], strict=True):
        rows = order[c:d]
        k = i[rows[0]]
        own = ids[ends[k] - sizes[k] : ends[k]]
        mark[own] = True
        js = j[rows]
        both = np.array([np.count_nonzero(mark[ids[ends[q] - sizes[q] : ends[q]]]) for q in js.tolist()], np.int64)
        mark[own] = False
        out[rows] = both / (sizes[k] + sizes[js] - both)
    return out


def _verified(bars, threshold: float, pdf: pd.DataFrame) -> pd.DataFrame:
    """For each node of one pair of blocks of a cluster: its links here (documents and texts) and its root by exact links."""
    pdf = pdf.sort_values(["side", "node"], ignore_index=True)
    sig, left, n = _signatures(pdf), int((pdf["side"] == 0).sum()), len(pdf)
    if pdf["i"].iat[0] == pdf["j"].iat[0]:
        i, j = survivors(sig, sig, bars, True)
    else:
        i, j = survivors(sig[:left], sig[left:], bars, False)
        j = j + left
    used = np.unique(np.r_[i, j]).astype(np.int64)
    at = np.zeros(n, np.int64)
    at[used] = np.arange(len(used))
    shingles = pdf["shingles"].tolist()
    sets = [np.frombuffer(shingles[k], np.uint64) for k in used.tolist()]
    linked = jaccard_pairs(sets, at[i], at[j]) >= threshold - 1e-12
    i, j = i[linked], j[linked]
    copies = pdf["copies"].to_numpy()
    docs = np.bincount(i, weights=copies[j], minlength=n) + np.bincount(j, weights=copies[i], minlength=n)
    texts = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
    root = stars(n, i, j)
    node = pdf["node"].to_numpy()
    return pd.DataFrame({"node": node, "links": docs.astype(np.int64), "texts": texts.astype(np.int64), "root": node[root]})


def join(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row for each document: doc_id, class_id, n_links, n_text_links, n_copies, and its digest (hi, lo).

    class_id is the smallest doc_id of the document's group (connected by links); n_links the number of other documents with
    that Jaccard similarity or more, copies included; n_text_links the number of other, different shingle sets.
    """
    bars = least_matches(threshold)
    prints = materialize(fingerprints(docs), "fingerprints")
    # A class is one shingle set; node is 128 bits as text, so that a table of any size has no equal nodes. Copies of a set
    # have equal signatures, so any one serves.
    node = F.concat(F.lpad(F.hex("hi"), 16, "0"), F.lpad(F.hex("lo"), 16, "0"))
    classes = prints.where("n_shingles > 0").groupBy("hi", "lo").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n_shingles"), F.max("sig").alias("sig"))
    classes = materialize(classes.withColumn("node", node), "classes")
    clusters = components(candidates(classes.select("node", "sig"), bars))
    checked = materialize(verified(docs, classes, clusters, bars, threshold), "checked")
    groups = components(checked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = checked.groupBy("node").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    known = classes.drop("sig", "n_shingles").join(counts, "node", "left").join(groups, "node", "left")
    known = known.select("hi", "lo", "copies", "first_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("root", "node").alias("root"))
    known = materialize(known, "known")
    known = known.join(known.groupBy("root").agg(F.min("first_id").alias("class_id")), "root")
    out = prints.select("doc_id", "hi", "lo", "n_shingles").join(known, ["hi", "lo"], "left")
    alone = F.col("n_shingles") == 0
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, 0).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
        F.when(alone, 0).otherwise(F.col("texts")).cast("long").alias("n_text_links"),
        F.when(alone, 1).otherwise(F.col("copies")).cast("long").alias("n_copies"),
        "hi",
        "lo",
    )


def candidates(sigs: DataFrame, bars: list[tuple[int, int]]) -> DataFrame:
    """Edges (a, b) between nodes that connect all pairs which share a bucket and survive the pruning."""

    def banded(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                yield pd.DataFrame({"node": np.repeat(pdf["node"].to_numpy(), BANDS), "bucket": band_keys(_signatures(pdf)).ravel()})

    bands = materialize(sigs.mapInPandas(banded, "node string, bucket long"), "bands")
    mark = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"x{k}") for k in (0, 1)]
    full = bands.groupBy("bucket").agg(F.count("*").alias("m"), *mark).where("m > 1")
    # near copies meet in many bands with the same company: one bucket of those with the same members is enough
    full = materialize(full.groupBy("m", "x0", "x1").agg(F.min("bucket").alias("bucket")).select("bucket", "m"), "buckets")
    two = bands.join(full.where("m = 2"), "bucket").groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("b")).select("a", "b")
    two = two.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")

    def both(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                same = _signatures(pdf.rename(columns={"sa": "sig"})) == _signatures(pdf.rename(columns={"sb": "sig"}))
                ok = np.all([same[:, :n].sum(axis=1) >= least for n, least in bars], axis=0)
                yield pdf.loc[ok, ["a", "b"]]

    pairs = two.select("a", "b", "sa", "sb").mapInPandas(both, "a string, b string")
    dealt = block_pairs(bands, full.where("m > 2").withColumn("nb", n_blocks(F.col("m"), F.lit(0))), "bucket").join(sigs, "node")
    return pairs.union(dealt.groupBy("bucket", "i", "j").applyInPandas(lambda pdf: _bucket_stars(bars, pdf), "a string, b string"))


def verified(docs: DataFrame, classes: DataFrame, clusters: DataFrame, bars: list[tuple[int, int]], threshold: float) -> DataFrame:
    """node, links, texts, root for each node of a cluster and pair of blocks: what exact verification finds there."""
    member = materialize(clusters.join(classes, "node").select("node", F.col("root").alias("cluster"), "copies", "first_id", "hi", "lo", "n_shingles", "sig"), "members")
    ids = member.select(F.col("first_id").alias("wanted_id")).distinct()
    if member.count() <= BROADCAST_ROWS:  # one long a row; beyond it, the texts are joined by a shuffle
        ids = F.broadcast(ids)

    def shingled(texts):
        out = [(*digest(s), s.tobytes()) for _, s in shingle_sets(texts)]
        return list(zip(*out, strict=True)) if out else [[], [], []]

    sets = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    sets = with_columns(sets, ["doc_id"], "text", "hi long, lo long, shingles binary", shingled)
    sets = sets.join(member.select("hi", "lo", "node"), ["hi", "lo"]).groupBy("node").agg(F.max("shingles").alias("shingles"))
    sizes = member.groupBy("cluster").agg(n_blocks(F.count("*"), F.sum("n_shingles")).alias("nb"))
    dealt = block_pairs(member.select("node", "cluster", "copies", "sig"), sizes, "cluster").join(sets, "node")
    return dealt.groupBy("cluster", "i", "j").applyInPandas(lambda pdf: _verified(bars, threshold, pdf), "node string, links long, texts long, root string")


def keep_one(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with all columns of docs.

    Documents without a word belong to no group and stay. Of rows that repeat the kept id and text, one stays.
    """
    found = materialize(join(docs, threshold), "groups")
    names = docs.columns
    own_id, hi, lo, n, text = free_names(docs, "_id", "_hi", "_lo", "_n", "_text")
    stays = F.col("doc_id").eqNullSafe(F.col("class_id"))
    if found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        gone = found.where(~stays).select(F.col("doc_id").alias(own_id))
        if gone.count() <= BROADCAST_ROWS:  # one long a row; beyond it, the texts are joined by a shuffle
            gone = F.broadcast(gone)
        return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(own_id)), "left_anti").select(*back(names))
    # ids repeat: the digest says which of an id's texts stay, and equal rows are thinned to one
    chosen = found.where(stays).groupBy("doc_id", "hi", "lo").agg(F.count("*").alias(n)).select(F.col("doc_id").alias("want_id"), F.col("hi").alias("want_hi"), F.col("lo").alias("want_lo"), F.col(n).alias("n"))
    digests = lambda texts: list(zip(*[digest(s) for _, s in shingle_sets(texts)], strict=True)) or [[], []]
    rows = with_columns(docs.withColumn(text, F.col("text")), names, text, f"{hi} long, {lo} long", digests)
    rows = rows.toDF(*[f"c{k}" for k in range(len(names))], "hi", "lo").withColumn("id", F.col(f"c{names.index('doc_id')}"))
    kept = rows.join(chosen, F.col("id").eqNullSafe(F.col("want_id")) & (F.col("hi") == F.col("want_hi")) & (F.col("lo") == F.col("want_lo")))
    kept = materialize(kept.select(*[f"c{k}" for k in range(len(names))], "hi", "lo", "n"), "kept")
    none = digest(np.zeros(0, np.uint64))
    single = (F.col("n") == 1) | ((F.col("hi") == none[0]) & (F.col("lo") == none[1]))
    return kept.where(single).unionByName(kept.where(~single).dropDuplicates(["hi", "lo"])).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])
