"""Token ids in ORC: integer run-length encoding, row indexes, and Bloom filters on document ids.

Texts are range-partitioned by doc_id, sorted and encoded; each partition writes one file in which documents follow each
other in ascending order, with `part` (the file's place) and `seq` (the row's place in it). ORC stores the ids as runs,
its row index (every STRIDE rows) and Bloom filters let a search for a document skip files, stripes and row groups, and
files are read by stripes in parallel.

Defined cases: null and empty texts hold the end id alone; null doc_ids come first; rows with equal ids are in the order of
their texts' hashes, and may lie in several files (repeated rows are each written); an empty table gives an empty file set and result; further columns are
ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import Encoder, crc, fresh_path, materialize, pick, tokenizer_path

END_ID = 0
STRIDE = 1000
STRIPE_BYTES = 16 << 20
SCHEMA = "part int, seq long, doc_id long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Encode every whole text and write part, seq, doc_id, ids to ORC files at path. vocabulary: a tokenizers file."""

    def encoded(it):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        encoder = Encoder.at(vocabulary or tokenizer_path())
        for whole in it:
            for first, n in encoder.blocks(whole.column("text")):
                batch = whole.slice(first, n)
                numbers, ids = encoder.encode(batch.column("text"))
                ends = np.cumsum(numbers)
                with_end = np.insert(ids, ends, end_id)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends + np.arange(1, n + 1)], pa.int32()), pa.array(with_end.view(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n)), batch.column("doc_id"), lists], names=["part", "seq", "doc_id", "ids"])
                seq += n
            pa.default_memory_pool().release_unused()

    # rows of one id are told apart by a hash of their text, so that an id with many rows is dealt to several files
    keyed = pick(docs, "doc_id", "text").withColumn("_h", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text").select("doc_id", "text")
    options = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.create.index": "true", "orc.row.index.stride": str(STRIDE), "orc.stripe.size": str(STRIPE_BYTES)}
    ordered.mapInArrow(encoded, SCHEMA).write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files: start is the number of ids of all documents before."""

    def counted(it):
        import pyarrow as pa

        for batch in it:
            ids = batch.column("ids")
            ends = ids.offsets.to_numpy()
            raw = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crcs = [crc(raw[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            columns = [batch.column("part"), batch.column("seq"), batch.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "seq", "doc_id", "n_tokens", "ids_crc32"])

    rows = materialize(tokens.mapInArrow(counted, "part int, seq long, doc_id long, n_tokens long, ids_crc32 long"), "token-digests")
    totals = sorted((r[0], r[1]) for r in rows.groupBy("part").agg(F.sum("n_tokens")).collect())  # one row for each file
    before = dict(zip([p for p, _ in totals], accumulate([0, *[n for _, n in totals]]), strict=False))
    offsets = tokens.sparkSession.createDataFrame(list(before.items()), "part int, before long")
    earlier = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("inside", earlier).join(F.broadcast(offsets), "part").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the table's token files to the shared folder and return what reading them back says of each document."""
    path = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary)
    return digests(read_tokens(docs.sparkSession, path))


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, ids of the documents with these ids; files, stripes and row groups that can't hold them are not read."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")
