"""Token ids in Huffman-coded files.

Pass 1 encodes every document once and keeps the ids in the shared folder. Pass 2 counts each id over the
whole corpus; package-merge turns the counts into the best code lengths up to MAX_BITS, and the canonical
code follows from the lengths alone. Pass 3 puts documents in order of doc_id by ranges and writes blocks
of about BLOCK ids. A block can be decoded by itself: it holds its documents' ids and lengths, the bits, and a
checkpoint (a bit offset) at every INTERVAL-th id. Decoding looks up MAX_BITS bits at a time in a table and runs
all stretches between checkpoints side by side. The only things on the driver are one count per id of the
vocabulary and one total per range.

A token file is a Parquet table of blocks (range, block, first, n_ids, payload) beside the code lengths, so it
can be written to and read from any store that Spark reaches.

Cases: a null or empty text has the end id only; null doc_ids come first; documents of one doc_id stand in
order of their ids; one id alone in the corpus has a code of one bit; an empty table gives no blocks and no
rows; special tokens written in a text are encoded as the library does. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, each, map_arrow, shared_folder
from .tokens import Words, tokenizer, vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
END = 0
MAX_BITS, BLOCK, INTERVAL = 16, 1 << 18, 256
#: Bits of a code word's length.
LENGTH_BITS = 5
MAGIC = b"HTF1"
HEAD = struct.Struct("<4sQQQ")  # magic, documents, ids, bits


@lru_cache(maxsize=2)
def words_of(path: str, width: str) -> Words:
    return Words(path, np.dtype(width).itemsize)


def vocabulary_size(vocabulary: str) -> int:
    return tokenizer(vocabulary_path(vocabulary)).get_vocab_size(with_added_tokens=True)


def width_of(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Package-merge: bits per id, 0 for ids that don't occur, at most limit, with the least total."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    used = used[np.argsort(counts[used], kind="stable")]
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    limit = max(limit, (n - 1).bit_length())
    leaves = counts[used].astype(np.int64)
    level, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = len(level) // 2
        both = np.concatenate([leaves, level[0 : 2 * pairs : 2] + level[1 : 2 * pairs : 2]])
        order = np.argsort(both, kind="stable")
        level = both[order]
        is_leaf.append(order < n)
    need, bits = 2 * n - 2, np.zeros(n, np.uint8)
    for flags in reversed(is_leaf):
        k = int(flags[:need].sum())
        bits[:k] += 1
        need = 2 * (need - k)
    out[used] = bits
    return out


@dataclass
class Code:
    """A canonical code: ids in order of (length, id) have consecutive code words."""

    lengths: np.ndarray

    def __post_init__(self) -> None:
        self.bits = max(1, int(self.lengths.max(initial=1)))
        order = np.lexsort((np.arange(len(self.lengths)), self.lengths))
        order = order[self.lengths[order] > 0]
        spans = np.left_shift(1, self.bits - self.lengths[order].astype(np.int64))
        starts = np.concatenate([[0], np.cumsum(spans)])
        self.words = np.zeros(len(self.lengths), np.uint64)
        self.words[order] = starts[:-1] >> (self.bits - self.lengths[order].astype(np.int64))
        # the id and the length of the code word that the next bits begin with, in one number
        self.table = np.ones(1 << self.bits, np.uint32)
        self.table[: starts[-1]] = np.repeat(order << LENGTH_BITS | self.lengths[order], spans)

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray, int]:
        """The bits of ids, the checkpoints and the number of bits."""
        size = self.lengths[ids].astype(np.int64)
        end = np.cumsum(size)
        start = end - size
        word, shift = start >> 6, 64 - (start & 63) - size
        code = self.words[ids]
        out = np.zeros(int(end[-1] + 63 >> 6) + 1 if len(ids) else 0, np.uint64)
        if len(ids):
            over = np.flatnonzero(shift < 0)
            high = code << np.maximum(shift, 0).astype(np.uint64)
            high[over] = code[over] >> (-shift[over]).astype(np.uint64)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[first]] = np.add.reduceat(high, first)
            out[word[over] + 1] += code[over] << (64 + shift[over]).astype(np.uint64)
        return out.astype(">u8").tobytes(), start[::INTERVAL].astype("<u8"), int(end[-1]) if len(ids) else 0

    def unpack(self, data: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The ids: every stretch between checkpoints is one lane, and all lanes take a step at once."""
        b = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
        wide = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
        at = checkpoints.astype(np.int64)
        out = np.zeros((INTERVAL, len(at)), np.uint32)
        last = n - (len(at) - 1) * INTERVAL
        for step in range(min(INTERVAL, n)):
            if step == last:
                at = at[:-1]
            window = (wide[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - self.bits)
            found = self.table[window]
            out[step, : len(at)] = found
            at = at + (found & ((1 << LENGTH_BITS) - 1))
        return (out >> LENGTH_BITS).T.reshape(-1)[:n]


def write_block(code: Code, doc_ids: list, docs: list[np.ndarray]) -> bytes:
    ids = np.concatenate(docs)
    data, checkpoints, bits = code.pack(ids)
    nulls = np.array([i is None for i in doc_ids], np.uint8)
    numbers = np.array([i or 0 for i in doc_ids], "<i8")
    sizes = np.array([len(x) for x in docs], "<u8")
    return HEAD.pack(MAGIC, len(docs), len(ids), bits) + nulls.tobytes() + numbers.tobytes() + sizes.tobytes() + checkpoints.tobytes() + data


def read_block(code: Code, payload: bytes) -> tuple[list, list[np.ndarray]]:
    """doc_ids and ids of a block's documents."""
    magic, n_docs, n_ids, _ = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = HEAD.size

    def part(kind: str, n: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(payload, kind, n, at)
        at += x.nbytes
        return x

    nulls, numbers, sizes = part("u1", n_docs), part("<i8", n_docs), part("<u8", n_docs)
    checkpoints = part("<u8", -(-n_ids // INTERVAL))
    ids = code.unpack(payload[at:], checkpoints, n_ids)
    return [None if z else int(i) for z, i in zip(nulls, numbers)], np.split(ids, np.cumsum(sizes)[:-1].astype(np.int64))


def encode_ids(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and ids (binary, 16 or 32 bits each, compressed by zstd), the end id last."""
    kind = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
    width = width_of(vocabulary_size(vocabulary))
    end = np.array([END], width).tobytes()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=1).compress
        ids = [zip_(x.tobytes() + end) for x in words_of(vocabulary_path(vocabulary), width).encode(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], schema=kind)

    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(df, lambda it: each(it, one), "doc_id long, ids binary")


def id_counts(ids: DataFrame, size: int, width: str) -> np.ndarray:
    """How often each id occurs; tasks send one row per id that they have."""

    def count(it):
        import zstandard

        unzip = zstandard.ZstdDecompressor().decompress
        total = np.zeros(size, np.int64)
        for batch in it:
            data = b"".join(unzip(x.as_py()) for x in batch.column("ids"))
            total += np.bincount(np.frombuffer(data, width), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(used, pa.int32()), "n": pa.array(total[used], pa.int64())})

    out = np.zeros(size, np.int64)
    for r in map_arrow(ids.select("ids"), count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


@dataclass
class TokenFiles:
    """Blocks in a folder, and the code that they are written in."""

    path: str
    lengths: np.ndarray
    starts: dict[int, int]


def write_token_files(docs: DataFrame, path: str | None = None, vocabulary: str = VOCABULARY) -> TokenFiles:
    spark: SparkSession = docs.sparkSession
    root = path or shared_folder(spark)
    size = vocabulary_size(vocabulary)
    width = width_of(size)
    plain = encode_ids(docs, vocabulary)
    plain.write.option("compression", "none").parquet(f"{root}/ids")
    ids = spark.read.schema(plain.schema).parquet(f"{root}/ids")
    lengths = code_lengths(id_counts(ids, size, width))

    def pack(it):
        import zstandard

        unzip = zstandard.ZstdDecompressor().decompress
        code, part = Code(lengths), TaskContext.get().partitionId()
        block = first = held = 0
        own: list = []
        data: list[np.ndarray] = []

        def flush():
            nonlocal block, first, held, own, data
            row = {"part": [part], "block": [block], "first": [first], "n_ids": [held], "payload": [write_block(code, own, data)]}
            block, first, held, own, data = block + 1, first + held, 0, [], []
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())]))

        for batch in it:
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                own.append(doc_id)
                data.append(np.frombuffer(unzip(x.as_py()), width))
                held += len(data[-1])
                if held >= BLOCK:
                    yield flush()
        if own:
            yield flush()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = ids.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    map_arrow(ordered, pack, "part int, block int, first long, n_ids long, payload binary").write.option("compression", "none").parquet(f"{root}/blocks")
    starts, at = {}, 0
    for r in sorted(spark.read.parquet(f"{root}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        starts[r["part"]], at = at, at + r["n"]
    return TokenFiles(f"{root}/blocks", lengths, starts)


def read_token_files(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the blocks."""
    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    lengths, starts = files.lengths, files.starts

    def decode(it):
        code = Code(lengths)
        for batch in it:
            for part, first, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "first", "payload"))):
                doc_ids, docs = read_block(code, payload)
                sizes = np.array([len(x) for x in docs], np.int64)
                begin = starts[part] + first + np.cumsum(sizes) - sizes
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in docs]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc_ids, begin, sizes, crc)], schema=kind)

    blocks = spark.read.parquet(files.path).select("part", "first", "payload")
    return map_arrow(blocks, decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    return read_token_files(spark, write_token_files(documents(spark, sf_dir)))
