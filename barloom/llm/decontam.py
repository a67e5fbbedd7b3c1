"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Documents are partitioned by their number of shingles, in powers of two. A partition's sketch has so many bins that the
chance of a shingle to be lost in it is the same in a note and in a book: `BINS_PER_SHINGLE` bins for each shingle of
the partition's upper bound, of which each keeps its smallest hash (one-permutation MinHash, rows of one value). Test
items have one sketch for each partition. An item that shares a bin's value with a document is a candidate, and its
containment |item & document| / |item| is then computed from the whole shingle sets.

Of an item's shingles in a document, each is lost to a smaller hash in its bin with a chance under 1/16, independently; an
item with 20 shared shingles is missed with a chance under 1e-24, and items with fewer than `EXACT_BELOW` shingles are
compared exactly, without the sketch. Documents are read once and nothing is shuffled. Items go to the executors in
blocks whose size is measured; a benchmark beyond one block takes one pass over the documents for each block, one after
the other, so that the driver and the executors hold one block's index at a time, however large the benchmark is.

Defined cases: null and empty texts and items match nothing; a text of one to four words is one shingle; items of one to
four words are looked for as runs of their length; a very long text is searched as a whole, in memory of some 30 bytes a
word; equal items, and items without an id, are each reported; rows are searched one by one, so repeated rows give repeated
results and null ids are kept; an empty table, or an empty benchmark, finds nothing; further columns, whatever they are
called, are ignored or passed on.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import SHINGLE_WORDS, SIMILARITY, back, free_names, hash_words, materialize, pick, shingle_hashes, with_columns, words

BINS_PER_SHINGLE = 8
EXACT_BELOW = 8
BLOCK_BYTES = 4 << 20
LEVELS = range(3, 31)


def level_of(n: int) -> int:
    """The partition of a document with n shingles: its upper bound is 2 ** level."""
    return max(LEVELS[0], int(n - 1).bit_length()) if n > 0 else LEVELS[0]


def sketch(hashes: np.ndarray, level: int) -> np.ndarray:
    """The smallest hash of each non-empty bin, of BINS_PER_SHINGLE << level bins by a hash's leading bits."""
    ordered = np.sort(hashes)
    bins = ordered >> np.uint64(64 - level - BINS_PER_SHINGLE.bit_length() + 1)
    return ordered[np.r_[True, bins[1:] != bins[:-1]]] if len(ordered) else ordered


@dataclass
class Items:
    """The sketches and whole shingle sets of a block of test items."""

    ids: list[int]
    threshold: float
    n: int
    sizes: np.ndarray = field(init=False)
    lengths: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # run length -> sorted shingles, their items
    sketches: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # level -> sorted values, their items

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]], threshold: float, n: int = SHINGLE_WORDS) -> "Items":
        rows = [(i, ws) for i, t in rows if (ws := words(t))]
        out = cls([i for i, _ in rows], threshold, n)
        sets, short = [], {}
        for k, (_, ws) in enumerate(rows):
            m = min(n, len(ws))
            sets.append(np.unique(shingle_hashes(hash_words(ws), m)))
            short.setdefault(m, []).append(k)
        out.sizes = np.array([len(s) for s in sets], np.int64)
        for m, ks in short.items():
            values = np.concatenate([sets[k] for k in ks])
            owner = np.repeat(ks, out.sizes[ks])
            order = np.argsort(values, kind="stable")
            out.lengths[m] = values[order], owner[order]
        out._full = [k for k in short.get(n, []) if out.sizes[k] >= EXACT_BELOW]
        out._small = np.array([len(s) < EXACT_BELOW for s in sets], bool)
        out._sets = sets
        return out

    def at(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        if level not in self.sketches:
            parts = [sketch(self._sets[k], level) for k in self._full]
            values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            owner = np.repeat(self._full, [len(p) for p in parts]).astype(np.int64)
            order = np.argsort(values, kind="stable")
            self.sketches[level] = values[order], owner[order]
        return self.sketches[level]

    def find(self, h: np.ndarray) -> list[tuple[int, int, float]]:
        """(item id, shared shingles, containment) for each item held by the document with these word hashes."""
        found = []
        for m, (values, owner) in self.lengths.items():
            own = np.unique(shingle_hashes(h, m)) if len(h) >= m else np.zeros(0, np.uint64)
            if not len(own):
                continue
            level = level_of(len(own))
            _, candidates = shared(sketch(own, level), *self.at(level)) if m == self.n else (None, np.zeros(0, np.int64))
            wanted = np.zeros(len(self.ids), bool)
            wanted[candidates] = True
            wanted |= self._small
            if m == self.n and not wanted.any():
                continue
            _, hits = shared(own, values, owner)
            ks, counts = np.unique(hits[wanted[hits]] if m == self.n else hits, return_counts=True)
            found += [(self.ids[k], int(c), c / self.sizes[k]) for k, c in zip(ks.tolist(), counts.tolist(), strict=True) if c >= self.threshold * self.sizes[k] - 1e-9]
        return sorted(found, key=lambda f: (f[0] is not None, f[0] or 0, f[1]))


def shared(own: np.ndarray, values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of (values, owner), sorted by value, whose value is in the sorted own."""
    if not len(own) or not len(values):
        return values[:0], owner[:0]
    at = np.searchsorted(own, values).clip(max=len(own) - 1)
    hit = own[at] == values
    return values[hit], owner[hit]


BUCKETS = 4096


def item_blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The items in parts of at most BLOCK_BYTES of text each, or one bucket of equal hashes. At most BUCKETS sizes reach the driver."""
    items = pick(benchmark, "item_id", "text").where("text is not null")
    bucket = F.pmod(F.xxhash64("item_id", "text"), F.lit(BUCKETS))
    sizes = sorted((r[0], r[1]) for r in items.groupBy(bucket.alias("k")).agg(F.sum(F.octet_length("text"))).collect())
    cuts, held = [0], 0
    for k, size in sizes:
        if held and held + size > BLOCK_BYTES:
            cuts.append(k)
            held = 0
        held += size
    return [items] if len(cuts) == 1 else [items.where((bucket >= a) & (bucket < b)) for a, b in zip(cuts, [*cuts[1:], BUCKETS], strict=True)]


def find_items(docs: DataFrame, keep: list[str], items: DataFrame, found: str, threshold: float = SIMILARITY):
    """The columns keep of docs and, as `found`, the items of one block that each document holds; and the broadcast index."""
    index = Items.of([(r[0], r[1]) for r in items.collect()], threshold)
    shipped = docs.sparkSession.sparkContext.broadcast(index)

    def fn(texts):
        index, out = shipped.value, []
        for text in texts:
            ws = words(text)
            got = index.find(hash_words(ws)) if ws else []
            out.append([{"item_id": i, "n_shared": c, "containment": float(x)} for i, c, x in got])
        return [out]

    return with_columns(docs, keep, "text", f"{found} array<struct<item_id: bigint, n_shared: bigint, containment: double>>", fn), shipped


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, n_shared, containment: one row for each document and item in it with that containment or more."""
    blocks, parts = item_blocks(benchmark), []
    for items in blocks:
        got, shipped = find_items(docs, ["doc_id"], items, "found", threshold)
        got = got.where(F.size("found") > 0).select("doc_id", F.inline("found"))
        if len(blocks) > 1:
            got = materialize(got, "contaminated")
            shipped.destroy()
        parts.append(got)
    return reduce(DataFrame.unionAll, parts)


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    names, blocks = docs.columns, item_blocks(benchmark)
    (found,) = free_names(docs, "found")
    for items in blocks:
        got, shipped = find_items(docs, names, items, found, threshold)
        docs = got.where(F.size(found) == 0).select(*back(names))
        if len(blocks) > 1:
            docs = materialize(docs, "decontaminated")
            shipped.destroy()
    return docs
