import random

import numpy as np
import pyarrow as pa

from stratalog.llm import tokens as K

PATH = K.vocabulary_path("byte_bpe_50k.json")


def test_joined_words_have_the_librarys_ids():
    rng = random.Random(5)
    odd = ["<|endoftext|>", "don't", "12é", "日本", "🙂🙂", "...", "áb", "́x", "Ġx", "Ġ", "x\x1cy", "\xa0", "'s", "#1,000.50", "ȩ́!", "\x00"]
    words = odd + ["".join(rng.choice("ab1-é日'.<|Ġ\n\t") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    rng.shuffle(words)
    text = " ".join(words)
    (got,) = K.Words(PATH, 2).encode(pa.array([text]))
    assert got.tolist() == K.encoded(PATH, [text])[0]


def test_words_are_encoded_many_at_a_time(monkeypatch):
    calls = []
    monkeypatch.setattr(K, "encoded", lambda path, texts, f=K.encoded: (calls.append(len(texts)), f(path, texts))[1])
    words = [f"{i}-{i * 7919 % 1000}" for i in range(4000)]
    (got,) = K.Words(PATH, 2).encode(pa.array(["x " + " ".join(words)]))
    assert sum(calls) < 20
    assert got.tolist() == K.encoded(PATH, ["x " + " ".join(words)])[0] and isinstance(got, np.ndarray)


def test_any_marks_may_follow_a_plain_word(monkeypatch):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))) + "".join(rng.choice(K.MARKS) for _ in range(rng.randint(0, 4))) for _ in range(3000)]
    text = "ab$$$ " + " ".join(words * 2)
    expected = K.encoded(PATH, [text])[0]
    calls = []
    monkeypatch.setattr(K, "encoded", lambda path, texts, f=K.encoded: (calls.append(len(texts)), f(path, texts))[1])
    (got,) = K.Words(PATH, 2).encode(pa.array([text]))
    assert got.tolist() == expected and not calls


def test_stores_of_two_generations_give_the_same_ids(monkeypatch):
    monkeypatch.setattr(K, "KEPT", 50)
    rng = random.Random(7)
    own = K.Words(PATH, 2)
    for _ in range(6):
        texts = [None, ""] + [" ".join(rng.choice(["ab", "Ab.", "x1", "日本", "é!?", "don't"]) + str(rng.randint(0, 60)) for _ in range(80)) for _ in range(3)]
        got = own.encode(pa.array(texts, pa.string()))
        assert [x.tolist() for x in got] == K.encoded(PATH, [t or "" for t in texts])
