"""BPE encoding with content-defined chunk reuse, and decoding.

Texts are cut into chunks where a rolling hash of eight bytes has certain bits, so copies of a passage give
the same chunks in every document, whatever stands before. A chunk is encoded by the library as a whole, from its
first blank to its last, once by a worker, and its ids are reused for every document that has it. What lies across a
join (the tail of one chunk and the head of the next) is repaired: it is encoded anew with the whole word on
either side, and accepted when those words come out exactly as they stand at the edges of both chunks' ids; else
the window grows by further words until they agree, in the end over both chunks. A document of which a join never
agrees is encoded whole. Blanks are cuts that this kind of tokenizer makes itself, so agreement of the edges fixes all
that lies beyond them.

Only worker-local state is used: a lost executor's documents are encoded again with the same result. The
stores are bounded and are emptied when full.

Cases: a null or empty text has no ids and decodes to nothing; special tokens written in a text are
encoded as the library does; texts without blanks are one word; repeated rows and null ids are kept; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, each, map_arrow, texts
from .tokens import encoded, tokenizer, vocabulary_path

VOCABULARY = "word_bpe_49k.json"
#: A cut falls at one in 2**CUT_BITS places; none within LEAST bytes after another.
CUT_BITS, LEAST = 9, 48
#: Bytes of chunks that a worker keeps.
KEPT_BYTES = 32 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BLANKS = b" \t\n\r\x0b\x0c"

SCHEMA = "doc_id long, ids array<int>, decoded string, n_chunks int, n_reused int"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chunks long, n_reused long"


def cuts(data: bytes) -> list[int]:
    """The ends of the chunks of data, from the bytes around each place alone."""
    n = len(data)
    if n <= 8:
        return [n] if n else []
    at = np.ndarray((n - 7,), np.uint64, data, 0, (1,))
    found = np.flatnonzero((at * MULTIPLIER) >> np.uint64(64 - CUT_BITS) == 0) + 8
    if len(found):
        found = found[np.diff(found, prepend=-LEAST) >= LEAST]
    ends = found.tolist()
    if not ends or ends[-1] != n:
        ends.append(n)
    return ends


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Chunk:
    """head | body | tail: the body lies between the first and the last blank and has whole words only."""

    __slots__ = ("head", "tail", "body", "ids", "whole")

    def __init__(self, data: bytes) -> None:
        parts = data.split(None, 1)
        self.ids, self.body = b"", b""
        self.whole = len(parts) == 1 and data[:1] not in BLANKS and data[-1:] not in BLANKS
        self.head = parts[0] if parts and data[:1] not in BLANKS else b""
        if self.whole:
            self.tail = b""
            return
        self.tail = data.rsplit(None, 1)[-1] if parts and data[-1:] not in BLANKS else b""
        self.body = data[len(self.head) : len(data) - len(self.tail)].strip()


class Encoder:
    def __init__(self, path: str) -> None:
        self.path = path
        self.chunks: dict[bytes, Chunk] = {}
        self.size = 0
        one, two, both, wide = encoded(path, ["one", "two's", "one two's", " one\n two's "])
        self.cuts_at_blanks = one + two == both == wide

    def ids_of(self, strings: list[bytes]) -> dict[bytes, bytes]:
        return dict(zip(strings, map(packed, encoded(self.path, [x.decode() for x in strings]))))

    def encode(self, batch: list[bytes]) -> list[tuple[bytes, int, int]]:
        """(ids as bytes, chunks, chunks reused) of each text. A tokenizer that sees across blanks gets whole texts."""
        if not self.cuts_at_blanks:
            return [(packed(ids), 1, 0) for ids in encoded(self.path, [x.decode() for x in batch])]
        docs: list[list[Chunk]] = []
        reused: list[int] = []
        fresh: list[Chunk] = []
        for data in batch:
            chunks, start, again = [], 0, 0
            for end in cuts(data):
                piece = data[start:end]
                start = end
                chunk = self.chunks.get(piece)
                if chunk is None:
                    chunk = self.chunks[piece] = Chunk(piece)
                    fresh.append(chunk)
                    self.size += 4 * len(piece)
                else:
                    again += 1
                chunks.append(chunk)
            docs.append(chunks)
            reused.append(again)
        found = self.ids_of(list({c.body for c in fresh if c.body}))
        for c in fresh:
            c.ids = found.get(c.body, b"")
        joins = [self.joins(chunks) for chunks in docs]
        lost = {id(j) for j in self.repair([j for own in joins for j in own])}
        out = []
        for data, chunks, own, again in zip(batch, docs, joins, reused):
            if any(id(j) in lost for j in own):
                out.append((packed(encoded(self.path, [data.decode()])[0]), len(chunks), again))
                continue
            parts, at = [], 0
            for j in own:
                parts += [c.ids for c in chunks[at : j.right]]
                parts.append(j.ids)
                at = j.right
            parts += [c.ids for c in chunks[at:]]
            out.append((b"".join(parts), len(chunks), again))
        if self.size > KEPT_BYTES:
            self.chunks, self.size = {}, 0
        return out

    @staticmethod
    def joins(chunks: list[Chunk]) -> list[Join]:
        """What lies between whole words of neighbours; chunks without a blank are part of a join."""
        found, open_, left = [], b"", None
        for i, c in enumerate(chunks):
            open_ += c.head
            if not c.whole:
                if open_:
                    found.append(Join(open_, left, c, i))
                open_, left = c.tail, c
        if open_:
            found.append(Join(open_, left, None, len(chunks)))
        return found

    def repair(self, joins: list[Join]) -> list[Join]:
        """Encode each join with words on either side until those agree with their chunks' own; those that never do."""
        around, lost = 1, []
        while joins:
            windows = [j.window(around) for j in joins]
            got = self.ids_of(list({x for w in windows for x in w if x}))
            got[b""] = b""
            rest = []
            for j, (left, all_, right) in zip(joins, windows):
                if not j.settle(got[left], got[all_], got[right]):
                    (rest if around < j.most() else lost).append(j)
            joins = rest
            around *= 4
        return lost


class Join:
    """What lies between the bodies of two chunks (left or right may be missing)."""

    __slots__ = ("middle", "left", "next", "right", "ids")

    def __init__(self, middle: bytes, left: Chunk | None, right: Chunk | None, at: int) -> None:
        self.middle, self.left, self.next, self.right, self.ids = middle, left, right, at, b""

    def most(self) -> int:
        """Words of the longer of both bodies."""
        return max(len(c.body.split()) if c else 0 for c in (self.left, self.next))

    def window(self, around: int) -> tuple[bytes, bytes, bytes]:
        """(words before, all, words after)."""
        left = b" ".join(self.left.body.rsplit(None, around)[-around:]) if self.left else b""
        right = b" ".join(self.next.body.split(None, around)[:around]) if self.next else b""
        return left, b" ".join(x for x in (left, self.middle, right) if x), right

    def settle(self, left: bytes, all_: bytes, right: bytes) -> bool:
        """Whether both edges agree with the chunks; if so, the ids of the middle are taken."""
        agree = (
            all_.startswith(left)
            and all_.endswith(right)
            and len(left) + len(right) <= len(all_)
            and (not left or self.left.ids.endswith(left))
            and (not right or self.next.ids.startswith(right))
        )
        if agree:
            self.ids = all_[len(left) : len(all_) - len(right)]
        return agree


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def table(path: str) -> list[str]:
    t = tokenizer(path)
    return [t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))]


def decode(ids: list[int], path: str) -> str:
    """As the library decodes ids of a file without a decoder: the tokens with a blank between."""
    return " ".join(map(table(path).__getitem__, ids))


def rows(batch: pa.RecordBatch, path: str):
    for doc_id, (ids, chunks, again) in zip(batch.column("doc_id").to_pylist(), encoder(path).encode([t.encode("utf-8", "replace") for t in texts(batch)])):
        yield doc_id, ids, chunks, again


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def bpe_encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids, decoded (the text of the ids), n_chunks and n_reused of every document."""
    kind = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string()), ("n_chunks", pa.int32()), ("n_reused", pa.int32())])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        path = vocabulary_path(vocabulary)
        got = [(i, (x := np.frombuffer(ids, "<u4").tolist()), decode(x, path), c, a) for i, ids, c, a in rows(batch, path)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got), kind)], schema=kind)

    return map_arrow(plain(docs), lambda it: each(it, one), SCHEMA)


def digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text of every document."""
    kind = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_chunks", pa.int64()), ("n_reused", pa.int64())])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        path = vocabulary_path(vocabulary)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        got = [(i, len(ids) // 4, sha(ids), sha(decode(np.frombuffer(ids, "<u4").tolist(), path).encode()), c, a) for i, ids, c, a in rows(batch, path)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got), kind)], schema=kind)

    return map_arrow(plain(docs), lambda it: each(it, one), DIGEST)


def op6_bpe_chunks(spark, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
