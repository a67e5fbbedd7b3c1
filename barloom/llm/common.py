"""What several operators share: written tables in the shared folder, shingle hashing, token counting."""

from __future__ import annotations

import atexit
import os
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
SIMILARITY = 0.8

_written: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a local session one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file:///tmp/barloom-shared-{os.getpid()}"
    return found.rstrip("/")


def _drop_written() -> None:
    for jvm_fs, path in _written:
        try:
            jvm_fs.delete(path, True)
        except Exception:  # the session may be gone at exit
            return


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/barloom/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not _written:
        atexit.register(_drop_written)
    _written.append((jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    The table is removed when the driver's process ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; further ones, whatever they are called, do not reach an operator's inside."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores behind it as it takes to differ from every column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def back(names: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]


def with_columns(df: DataFrame, keep: list[str], source: str, made: str, fn, rows: int = 128) -> DataFrame:
    """The columns keep of df as they are, and those of the DDL schema made, computed by fn from lists of source's values.

    fn gets at most `rows` values at a time and returns one sequence for each new column. Columns travel as Arrow
    arrays, so null ids and large integers stay exact.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    src = pick(df, *dict.fromkeys([*keep, source]))
    new = StructType.fromDDL(made)
    out = StructType([*[src.schema[k] for k in keep], *new.fields])
    arrow = to_arrow_schema(new)
    if set(new.names) & set(keep):
        raise ValueError(f"columns {sorted(set(new.names) & set(keep))} are there already")

    def made_of(it):
        for whole in it:
            for k in range(0, whole.num_rows, rows):
                batch = whole.slice(k, rows)
                got = fn(batch.column(source).to_pylist())
                arrays = [batch.column(c) for c in keep] + [pa.array(v, type=f.type, from_pandas=False) for v, f in zip(got, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *arrow.names])
            pa.default_memory_pool().release_unused()

    return src.mapInArrow(made_of, out)


def held_out(doc_id: Column) -> Column:
    """True for the rows that no label is learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


# ---- word shingles ---------------------------------------------------------------------------------------------------

_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def words(text: str | None) -> list[str]:
    """Lower-cased runs without white space; null has none."""
    return text.lower().split() if text else []


def hash_words(tokens: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(tokens, dtype=object), categorize=True) if tokens else np.zeros(0, np.uint64)


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, from the words' hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            out = out * _MULT + h[k : len(h) - n + 1 + k]
        return mix(out ^ np.uint64(n))


def shingle_sets(texts: list[str | None], n: int = SHINGLE_WORDS, block_chars: int = 400_000):
    """Yields (position, sorted distinct shingle hashes) of each text; a text of 1 to n-1 words is one shingle.

    Words are hashed for many texts at once; a block holds about block_chars characters, or one longer text.
    """
    i = 0
    while i < len(texts):
        j, chars, tokens, ends = i, 0, [], []
        while j < len(texts) and (j == i or chars + len(texts[j] or "") <= block_chars):
            chars += len(texts[j] or "")
            tokens += words(texts[j])
            ends.append(len(tokens))
            j += 1
        h, start = hash_words(tokens), 0
        for k, end in zip(range(i, j), ends, strict=True):
            own = h[start:end]
            yield k, np.unique(shingle_hashes(own, min(n, len(own))) if len(own) else own)
            start = end
        i = j


# ---- tokens ----------------------------------------------------------------------------------------------------------


# The classes by which this byte-level vocabulary cuts a text before merging, and the endings it keeps whole.
LETTER, NUMBER, OTHER, SPACE, UNASSIGNED = range(5)
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
SPACES = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def character_classes() -> np.ndarray:
    """The class of each code point."""
    import unicodedata

    kinds = {"L": LETTER, "N": NUMBER}
    out = np.full(0x110000, UNASSIGNED, np.uint8)
    for plane in (range(0x20000), range(0x20000, 0x32400), range(0xE0000, 0xE0200)):  # no others are assigned but private ones
        out[plane.start : plane.stop] = [UNASSIGNED if (k := unicodedata.category(chr(c))) == "Cn" else kinds.get(k[0], OTHER) for c in plane]
    out[list(SPACES)] = SPACE
    return out


class Pieces(dict):
    """What `make` gives for a piece of text, made once; the first `limit` pieces, and so the frequent ones, are kept."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, piece: bytes):
        got = self.make(piece)
        if len(self) < self.limit:
            self[piece] = got
        return got


class Encoder:
    """Token ids, or their number, of whole texts by the tokenizers library's BPE model, asked for what isn't in a cache.

    A byte-level BPE vocabulary never merges across pre-tokens. Those of many texts are found at once, as changes of class
    between neighbouring bytes, equal ones are numbered by Arrow, and only the different ones of a block are looked up.
    Texts with an added token or an unassigned character go to the library whole. Null counts as empty. Caches are bounded.
    """

    CACHE = 400_000  # pieces, some 150 bytes each
    BLOCK_BYTES = 4 << 20
    _loaded: dict[str, "Encoder"] = {}

    def __init__(self, path: str, limit: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        self.as_chars = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)}
        self.classes = character_classes()
        self.ids_of, self.number_of = Pieces(self.piece, limit), Pieces(lambda p: len(self.tokenize(self.spelt(p))), limit)

    @classmethod
    def at(cls, path: str) -> "Encoder":
        """One for each vocabulary and Python worker."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def spelt(self, pre_token: bytes) -> str:
        """The pre-token in the vocabulary's letters, each of which stands for a byte."""
        return pre_token.decode("latin-1").translate(self.as_chars)

    def piece(self, pre_token: bytes) -> bytes:
        got = [t.id for t in self.tokenize(self.spelt(pre_token))]
        return struct.pack(f"<{len(got)}I", *got)

    def class_of_bytes(self, raw: np.ndarray) -> np.ndarray:
        """The class of the character that each byte belongs to."""
        out = self.classes[:256][raw]
        lead = np.flatnonzero(raw >= 0xC0)
        if len(lead):
            code = raw[lead].astype(np.int64)
            size = 2 + (code >= 0xE0) + (code >= 0xF0)
            code &= 0x7F >> size
            for k in (1, 2, 3):
                more = size > k
                code[more] = code[more] << 6 | raw[lead[more] + k] & 0x3F
            kind = self.classes[code]
            for k in range(4):
                more = size > k
                out[lead[more] + k] = kind[more]
        return out

    def starts(self, raw: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin. raw: the texts' bytes, one after the other; offsets: where texts begin, and the end."""
        n = len(raw)
        begin = np.zeros(n + 4, bool)
        first = begin.copy()
        first[offsets] = True
        begin[1:n] = kind[1:] != kind[:-1]
        begin |= first
        # white space before a word: its last character is apart, and a plain space goes with the word
        word = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~first[1:n]) + 1
        last = word - 1
        if n and raw.max() >= 0xC0:
            for _ in range(2):
                last = last - ((raw[last] & 0xC0) == 0x80)
        begin[last] = True
        begin[word] = raw[word - 1] != 0x20
        # an apostrophe that isn't taken by what stands before it, and the endings that begin with one
        mark = np.flatnonzero(raw == 0x27)
        if len(mark):
            before = np.maximum(mark - 1, 0)
            free = first[mark] | (kind[before] == LETTER) | (kind[before] == NUMBER) | ((kind[before] == SPACE) & (raw[before] != 0x20))
            mark, tail = mark[free], np.r_[raw, np.zeros(3, np.uint8)]
            for ending in (e.encode() for e in ENDINGS):
                hit = np.ones(len(mark), bool)
                for k in range(1, len(ending)):
                    hit &= (tail[mark + k] == ending[k]) & ~first[mark + k]
                at = mark[hit]
                begin[at] = True
                for k in range(1, len(ending)):
                    begin[at + k] = False
                begin[at + len(ending)] = True
        return np.flatnonzero(begin[:n])

    def encode(self, texts, with_ids: bool = True):
        """The number of ids of each text of an Arrow array, and all ids in a row (None without with_ids)."""
        import pyarrow as pa

        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        if not len(raw):
            return np.zeros(len(texts), np.int64), np.zeros(0, np.uint32) if with_ids else None
        kind = self.class_of_bytes(raw)
        begin = self.starts(raw, kind, offsets)
        pieces = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(raw)).astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode()
        which, distinct = pieces.indices.to_numpy(), pieces.dictionary.to_pylist()
        if with_ids:
            found = list(map(self.ids_of.__getitem__, distinct))
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        else:
            sizes = np.fromiter(map(self.number_of.__getitem__, distinct), np.int64, len(distinct))
        ends = np.r_[0, np.cumsum(sizes[which])]
        at = ends[np.searchsorted(begin, offsets)]
        numbers, ids = np.diff(at), None
        if with_ids:
            flat, start = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
            ids = flat[np.repeat(start[which] - ends[:-1], sizes[which]) + np.arange(ends[-1])]
        whole = self.whole_ones(raw, kind, offsets)
        return self.replaced(texts, whole, numbers, at, ids) if whole else (numbers, ids)

    def whole_ones(self, raw: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> list[int]:
        """The texts that the library must have whole."""
        found = np.searchsorted(offsets, np.flatnonzero(kind == UNASSIGNED), "right") - 1
        out, block = set(np.unique(found).tolist()), raw.tobytes()
        for token in self.added:
            if token in block:
                out |= {k for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)) if block.find(token, a, b) >= 0}
        return sorted(out)

    def replaced(self, texts, whole: list[int], numbers: np.ndarray, at: np.ndarray, ids: np.ndarray | None):
        numbers, parts, done = numbers.copy(), [], 0
        for k in whole:
            got = np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32)
            if ids is not None:
                parts += [ids[done : at[k]], got]
                done = at[k + 1]
            numbers[k] = len(got)
        return numbers, None if ids is None else np.concatenate([*parts, ids[done:]])

    def blocks(self, texts):
        """Runs of an Arrow array's texts of about BLOCK_BYTES, at least one text each: (first, how many)."""
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, first = np.cumsum(sizes), 0
        while first < len(sizes):
            before = ends[first] - sizes[first]
            last = max(first + 1, int(np.searchsorted(ends, before + self.BLOCK_BYTES, "right")))
            yield first, last - first
            first = last

    def numbers(self, texts) -> np.ndarray:
        """The number of ids of each text of an Arrow array."""
        return np.concatenate([np.zeros(0, np.int64), *[self.encode(texts.slice(a, n), False)[0] for a, n in self.blocks(texts)]])


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary lies on this machine; resolved where it is used, so on the executors too."""
    import public_tokenizers

    return public_tokenizers.path(name)


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
