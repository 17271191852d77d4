import heapq
import random
import zlib

import numpy as np

from stratalog.llm import token_files as T
from stratalog.llm.tokens import encoded, vocabulary_path


def huffman_total(counts):
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    return total


def test_code_lengths_are_the_best_within_the_limit():
    rng = np.random.default_rng(1)
    counts = (rng.pareto(0.7, 500) * 20).astype(np.int64)
    bits = T.code_lengths(counts, 30)
    assert int((bits * counts).sum()) == huffman_total(counts)
    short = T.code_lengths(counts, 9)
    used = short[counts > 0]
    assert used.max() <= 9 and (short[counts == 0] == 0).all()
    assert sum(2.0 ** -int(b) for b in used) <= 1
    fibonacci = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    assert T.code_lengths(fibonacci, 4).max() == 4


def test_blocks_round_trip():
    rng = np.random.default_rng(2)
    for n, kinds in ((1, 1), (5, 1), (255, 3), (256, 40), (257, 40), (70_000, 5000)):
        docs = [x for x in np.split(rng.integers(0, kinds, n).astype(np.uint16), sorted(rng.integers(0, n + 1, 3)))]
        code = T.Code(T.code_lengths(np.bincount(np.concatenate(docs), minlength=kinds)))
        names = [None, 3, -5, 1 << 60]
        got_names, got = T.read_block(code, T.write_block(code, names, docs))
        assert got_names == names and all((a == b).all() and len(a) == len(b) for a, b in zip(got, docs))


def test_files_give_the_librarys_ids(spark):
    rng = random.Random(4)
    texts = [None, "", "<|endoftext|>", "a\n\n b  c\t", "don't 12é", "x" * 5000, "日本 語🙂" * 50]
    texts += [" ".join(rng.choice(["the", "of", "and,", "Zürich", "12"]) for _ in range(rng.randint(0, 300))) for _ in range(60)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    df = spark.createDataFrame([(i - 5, texts[i], 0) for i in order], "doc_id long, text string, start int")
    got = {r["doc_id"]: r for r in T.read_token_files(spark, T.write_token_files(df)).collect()}
    start = 0
    for i, ids in enumerate(encoded(vocabulary_path(T.VOCABULARY), [t or "" for t in texts])):
        ids = [*ids, 0]
        assert (got[i - 5]["start"], got[i - 5]["n_tokens"], got[i - 5]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_empty_null_and_repeated(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert T.read_token_files(spark, T.write_token_files(none)).count() == 0
    df = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string")
    rows = sorted(T.read_token_files(spark, T.write_token_files(df)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 1] and [r["start"] for r in rows] == [0, 2, 4]
