import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from stratalog.llm import bpe_chunks as B
from stratalog.llm.tokens import encoded, tokenizer, vocabulary_path

ODD = [None, "", " ", "one", "á éx İstanbul ΑΣ", "x<|endoftext|> y <|startoftext|>z", "don't 'S they'LL 12 345", "　wide blank", "a" * 3000, "日本語" * 700, "\n\n\t tab\x0b\x0c\x1c end ", "🙂 😀" * 90]


def test_ids_and_text_match_the_library(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghéßÀñ,.!") for _ in range(rng.randint(1, 12))) for _ in range(400)]
    shared = " ".join(rng.choice(words) for _ in range(300))
    texts = ODD + [" ".join(rng.choice(words) for _ in range(rng.randint(0, 900))) + shared for _ in range(40)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    path = vocabulary_path(B.VOCABULARY)
    got = {r["doc_id"]: r for r in B.bpe_encode(df).collect()}
    want = encoded(path, [t or "" for t in texts])
    for i, ids in enumerate(want):
        assert got[i]["ids"] == ids, texts[i]
        assert got[i]["decoded"] == tokenizer(path).decode(ids, skip_special_tokens=False)
    assert sum(r["n_reused"] for r in got.values()) > 50
    for r in B.digests(df).collect():
        assert r["ids_sha256"] == hashlib.sha256(np.array(want[r["doc_id"]], "<u4").tobytes()).hexdigest()


def test_rows_are_kept(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert B.digests(df).count() == 3
    assert B.digests(df.where(F.lit(False))).count() == 0


def test_cuts_depend_on_content_only():
    rng = random.Random(5)
    passage = bytes(rng.choice(b"abcdefgh ") for _ in range(20000))
    a, b = B.cuts(passage), B.cuts(b"other words before " + passage)
    inner = {x + 19 for x in a[1:]} & set(b)
    assert len(inner) >= len(a) - 2 and a[-1] == len(passage)


def test_a_tokenizer_that_sees_across_blanks_gets_whole_texts():
    path = vocabulary_path("byte_bpe_50k.json")
    texts = ["some words that " * 400, "xx abc yy", ""]
    got = B.Encoder(path).encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x, _, _ in got] == encoded(path, texts)


def test_joins_that_disagree_grow_and_end_in_the_whole_text(monkeypatch):
    path = vocabulary_path(B.VOCABULARY)
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(800))
    (want,) = encoded(path, [text])
    asked = []
    settle, window = B.Join.settle, B.Join.window
    monkeypatch.setattr(B.Join, "window", lambda self, n: asked.append(n) or window(self, n))
    for turns in (1, 2, 99):  # the first turns are made to disagree
        asked.clear()
        monkeypatch.setattr(B.Join, "settle", lambda self, *a: len(set(asked)) >= turns and settle(self, *a))
        ((ids, _, _),) = B.Encoder(path).encode([text.encode()])
        assert np.frombuffer(ids, "<u4").tolist() == want and max(asked) >= 4 ** min(turns - 1, 3)
