"""Variable-capacity best-fit packing of documents into training sequences of several permitted lengths.

Documents are counted in tokens, with an end id each; one longer than the longest permitted length is cut into pieces of it
and a rest, so no token is lost. Narrow rows (id, length) are dealt evenly, not by key, to shards of about SHARD_ROWS rows,
and each shard is packed on its own. Pieces go in descending order into the open bin that they leave least room in; where
none has room, a bin opens whose cost for each token it can expect to hold is least. Two plain policies (the longest length,
and the shortest that fits) are packed as well and the cheapest result stays. At last every bin shrinks to the shortest
permitted length that holds its contents.

Defined cases: null and empty texts are one end id; repeated rows and null ids are packed like others; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from barloom.llm.common import Encoder, pick, tokenizer_path

SIZES = (1024, 2048, 4096, 8192)
SHARD_ROWS = 4096


def cost(size: int) -> float:
    """What a sequence of this length costs: its tokens, a quadratic share for attention, a fixed share for handling."""
    return size * (1 + size / 65536) + 32


def pieces_of(lengths: Sequence[int], largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length) of the pieces that rows of these lengths are cut into."""
    n = np.asarray(lengths, np.int64)
    k = np.maximum(1, -(-n // largest))
    row = np.repeat(np.arange(len(n)), k)
    start = (np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)) * largest
    return row, start, np.minimum(n[row] - start, largest)


def best_fit(lengths: np.ndarray, sizes: Sequence[int] = SIZES, price=cost, policy: str = "cost") -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Bin and offset of each piece, final size of each bin, and their total cost."""
    sizes = sorted(sizes)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[tuple[int, int]] = []  # (free, -bin), sorted: of equal room the newest bin comes first
    used: list[int] = []
    rest = int(lengths.sum())
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        at = bisect_left(room, (n, -len(used) - 1))
        if at < len(room):
            free, b = room.pop(at)
            b = -b
        else:
            fitting = [s for s in sizes if s >= n]
            if policy == "cost":
                free = min(fitting, key=lambda s: price(s) / min(s, rest))
            else:
                free = fitting[-1] if policy == "longest" else fitting[0]
            b = len(used)
            used.append(0)
        bins[k], offsets[k] = b, used[b]
        used[b] += n
        rest -= n
        if free > n:
            insort(room, (free - n, -b))
    final = np.array([sizes[bisect_left(sizes, u)] for u in used], np.int64)
    return bins, offsets, final, float(sum(map(price, final.tolist())))


def pack_shard(lengths: Sequence[int], sizes: Sequence[int] = SIZES, price=cost) -> pd.DataFrame:
    """row, piece_start, length, bin, bin_offset, bin_size, bin_used of the pieces of one shard."""
    row, start, n = pieces_of(lengths, max(sizes))
    bins, offsets, final, _ = min((best_fit(n, sizes, price, p) for p in ("cost", "longest", "shortest")), key=lambda r: r[3])
    used = np.bincount(bins, weights=n, minlength=len(final)).astype(np.int64) if len(n) else np.zeros(0, np.int64)
    return pd.DataFrame({"row": row, "piece_start": start, "length": n, "bin": bins, "bin_offset": offsets, "bin_size": final[bins] if len(n) else n, "bin_used": used[bins] if len(n) else n})


def with_lengths(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and n_tokens, the end id included."""

    def counted(it):
        import pyarrow as pa

        encoder = Encoder.at(vocabulary or tokenizer_path())
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(encoder.numbers(batch.column("text")) + 1)], names=["doc_id", "n_tokens"])
            pa.default_memory_pool().release_unused()

    return pick(docs, "doc_id", "text").mapInArrow(counted, "doc_id long, n_tokens long")


def pack(lengths: DataFrame, sizes: Sequence[int] = SIZES, shard_rows: int = SHARD_ROWS, rows: int | None = None) -> DataFrame:
    """Pack rows of (doc_id, n_tokens); rows: how many there are, if known.

    One row for each piece: doc_id, piece_start, length, bin_id, bin_offset, bin_size, bin_used. Bin ids are unique over shards.
    """

    def packed(it):
        import pyarrow as pa
        from pyspark import TaskContext

        batches = [b for b in it if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches).sort_by([("n_tokens", "descending"), ("doc_id", "ascending")])
        got = pack_shard(table.column("n_tokens").to_numpy(), sizes)
        ids = table.column("doc_id").combine_chunks().take(pa.array(got["row"].to_numpy()))
        shard = TaskContext.get().partitionId() << 32
        arrays = [ids, *[pa.array(got[c].to_numpy()) for c in ("piece_start", "length")], pa.array(got["bin"].to_numpy() + shard), *[pa.array(got[c].to_numpy()) for c in ("bin_offset", "bin_size", "bin_used")]]
        yield from pa.Table.from_arrays(arrays, names=["doc_id", "piece_start", "length", "bin_id", "bin_offset", "bin_size", "bin_used"]).to_batches(10_000)

    n = lengths.count() if rows is None else rows
    dealt = lengths.select("doc_id", "n_tokens").repartition(max(1, -(-n // shard_rows)))
    return dealt.mapInArrow(packed, "doc_id long, piece_start long, length long, bin_id long, bin_offset long, bin_size long, bin_used long")


def packing(docs: DataFrame, sizes: Sequence[int] = SIZES, vocabulary: str | None = None) -> DataFrame:
    return pack(with_lengths(docs, vocabulary), sizes, rows=docs.count())
