import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import gru
from stratalog.llm import lm_scoring as L
from stratalog.llm.common import held_out


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) + [None]


def corpus(seed, n=200):
    rng = random.Random(seed)
    kinds = [[f"{a}{i}" for i in range(40)] for a in "abc"]
    docs = [None, "", "Zürich ZÜRICH", "  x\n"]
    for i in range(n):
        words = kinds[i % 3]
        docs.append(" ".join(words[(j + rng.randint(0, 2)) % 40] for j in range(rng.randint(0, 120))) + f" only{i}")
    return docs


def rows(spark, docs, **kw):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(docs)], "doc_id long, text string, score int").repartition(3)
    return {r["doc_id"]: r for r in L.lm_scores(df.withColumn("held_out", held_out("doc_id", 10, 0)), **kw).collect()}


def test_base_score_and_a_better_model(spark):
    docs = corpus(1)
    got = rows(spark, docs, vocabulary=60, frequent=100, shard=4000, rounds=2)
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(docs))}
    c = Counter(w for i, t in enumerate(docs) if not out[i] for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(docs):
        own = tokens(t)
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(own), sum(c[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(base, abs=1e-6)
        assert r["score"] < 0
    unseen = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_empty_and_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(None, "a b"), (3, "a"), (3, "a")], "doc_id long, text string")
    got = L.lm_scores(df.withColumn("held_out", F.lit(True))).collect()
    assert [r["score"] for r in got] == [0.0] * 3 and [r["train_tokens"] for r in got] == [0] * 3
    assert L.lm_scores(df.where(F.lit(False)).withColumn("held_out", F.lit(True))).count() == 0


def test_probabilities_add_up_and_state_crosses_windows():
    counts = np.array([9.0, 5, 4, 2, 2, 1])
    shape = gru.Shape.of(counts, 3)
    p = gru.initial(counts, 3.0, shape, 8)
    trainer = gru.Trainer(p, shape, 1)
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 7, n) for n in (0, 1, 5, 33, 70, 64)]
    trainer.train(docs * 3, 4, 8)
    h = rng.normal(size=(5, 8)).astype(np.float32)
    total = sum(np.exp(gru.log_probs(trainer.p, shape, h, np.full(5, w))) for w in range(7))
    assert total == pytest.approx(np.ones(5), abs=1e-4)
    whole, parts = gru.score(trainer.p, shape, docs, 1, steps=100), gru.score(trainer.p, shape, docs, 1, steps=7)
    assert whole == pytest.approx(parts, abs=1e-3)


def test_gradients(monkeypatch):
    counts = np.array([9.0, 5, 4, 2, 2, 1])
    shape = gru.Shape.of(counts, 3)
    p = {k: v.astype(np.float64) for k, v in gru.initial(counts, 3.0, shape, 4).items()}
    rng = np.random.default_rng(2)
    for k in ("wc", "wo"):
        p[k] = rng.normal(0, 0.5, p[k].shape)
    x, y = rng.integers(0, 7, (5, 3)), rng.integers(0, 7, (5, 3))
    got = {}
    trainer = gru.Trainer(p, shape, 1)
    monkeypatch.setattr(trainer, "update", lambda key, g, at=slice(None): got.setdefault(key, np.zeros(p[key].shape)).__setitem__(at, got[key][at] + g))
    trainer.window(x, y, np.zeros((3, 4)))

    def loss():
        h, total = np.zeros((3, 4)), 0.0
        for t in range(5):
            h = gru.step(p, x[t], h)[0]
            total -= gru.log_probs(p, shape, h, y[t]).sum()
        return total / np.sqrt(gru.STEPS * gru.LANES)

    for key, g in got.items():
        for at in [tuple(rng.integers(0, n) for n in p[key].shape) for _ in range(4)]:
            old = p[key][at]
            p[key][at] = old + 1e-5
            up = loss()
            p[key][at] = old - 1e-5
            down = loss()
            p[key][at] = old
            assert (up - down) / 2e-5 == pytest.approx(g[at], abs=1e-4), key


def test_weights_and_scores_do_not_depend_on_the_layout(spark):
    docs = corpus(3, 120)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("held_out", held_out("doc_id", 10, 0))
    kw = {"vocabulary": 60, "frequent": 100, "shard": 1500, "rounds": 3}
    one, two = ({r["doc_id"]: r["score"] for r in L.lm_scores(df.repartition(n), **kw).collect()} for n in (1, 6))
    assert all(one[i] == pytest.approx(two[i], abs=1e-3) for i in one)


def test_score_is_that_of_a_plain_pass_word_by_word(spark, monkeypatch):
    """Rare, unseen and frequent words of a long text, one number at a time in plain Python floats."""
    docs = corpus(2, 60) + [" ".join(f"a{i % 40}" if i % 7 else f"new{i}" for i in range(3000)) + " only3 only4"]
    kept = {}
    train = L.trained
    monkeypatch.setattr(L, "trained", lambda rows, lex, *a: kept.setdefault("p", (train(rows, lex, *a), lex))[0])
    got = rows(spark, docs, vocabulary=30, frequent=50)
    p, lex = kept["p"]
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(docs))}
    c = Counter(w for i, t in enumerate(docs) if not out[i] for w in tokens(t))
    share = lambda w: (c[w] + 0.1) / (sum(c.values()) + 0.1 * (len(c) + 1))
    names = {(w.decode() or None): i + 1 for i, w in enumerate(lex.words[: lex.v])}
    inside = sum(share(w) for w in names)
    f = {k: v.astype(float) for k, v in p.items()}
    n = f["k"].shape[0]
    for i in (0, 2, 5, 9, len(docs) - 1):
        h, last, total = np.zeros(n), names[None], 0.0
        for w in tokens(docs[i]):
            a = f["x"][last] + f["b"]
            z, r = np.split(1 / (1 + np.exp(-(a[: 2 * n] + h @ f["u"]))), 2)
            h = h + z * (np.tanh(a[2 * n :] + (r * h) @ f["k"]) - h)
            last = names.get(w, 0)
            classes = np.exp(h @ f["wc"] + f["bc"])
            kind = lex.shape.word_class[last]
            total += math.log10(classes[kind] / classes.sum())
            if last:
                s, e = lex.shape.starts[kind - 1], lex.shape.starts[kind]
                own = np.exp(h @ f["wo"][:, s:e] + f["bo"][s:e])
                total += math.log10(own[last - 1 - s] / own.sum())
            else:
                total += math.log10(share(w) / (1 - inside))
        assert got[i]["score"] == pytest.approx(total, rel=2e-4, abs=2e-3), i


def test_lanes_take_every_word_once():
    counts = np.array([9.0, 5, 4, 2, 2, 1])
    shape = gru.Shape.of(counts, 3)
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 7, n) for n in (0, 1, 5, 200, 33, 70, 64, 2)]
    trainer = gru.Trainer(gru.initial(counts, 3.0, shape, 4), shape, 1)
    seen, begun, window = [], [], trainer.window
    trainer.window = lambda x, y, h, keep: (seen.append(y[y >= 0]), begun.append(int((keep == 0).sum())), window(x, y, h, keep))[-1]
    trainer.train(docs, 3, 8, 150)
    assert Counter(np.concatenate(seen).tolist()) == Counter(np.concatenate(docs).tolist())
    assert sum(begun) == 7 and trainer.words == sum(map(len, docs))


def test_every_document_trains(spark):
    # many shards and three rounds: what only late shards hold is learned too
    words = [f"w{i}" for i in range(30)]
    text = F.concat_ws(" ", *(F.lit(words[(7 * j) % 30]) for j in range(60)))
    docs = spark.range(400).select(F.col("id").alias("doc_id"), text.alias("text"), (F.col("id") == 0).alias("held_out")).repartition(2)
    (unseen,) = L.lm_scores(docs, shard=3000).where("held_out").collect()
    assert unseen["score"] > unseen["base_score"] + 10


def test_words_of_a_batch_are_those_of_each_text():
    docs = [None, "", " ", "a", " A  b\t\x0b\x0cb\r\n", "\x1cx\x1f \x85y\xa0z", "Ärger ÄRGER a", "\n\na"]
    different, which, starts = L.words_of(L.pa.RecordBatch.from_pydict({"text": L.pa.array(docs, L.pa.string())}))
    names = different.to_pylist()
    got = [[names[i].decode() or None for i in own] for own in np.split(which, starts[1:])]
    assert got == [tokens(t) for t in docs]


def test_probabilities_are_those_of_plain_sums(monkeypatch):
    # a class of one word, documents in blocks, and logits too large for exp without a shift
    counts = np.array([100.0, 3, 2, 2, 1])
    shape = gru.Shape.of(counts, 3)
    assert 1 in np.diff(shape.starts)
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 6, n) for n in (0, 3, 1, 40, 9, 9)]
    monkeypatch.setattr(gru, "BESIDE", 2)
    monkeypatch.setattr(gru, "STRETCH", 16)
    for scale in (1, 200):
        p = gru.initial(counts, 3.0, shape, 4)
        p["wc"], p["wo"] = (rng.normal(0, scale, p[k].shape).astype(np.float32) for k in ("wc", "wo"))
        got = gru.score(p, shape, docs, 1, steps=4)
        for d, found in zip(docs, got):
            h, last, total = np.zeros((1, 4)), 1, 0.0
            for w in d:
                h = gru.step(p, np.array([last]), h.astype(np.float32))[0]
                x = h.astype(float) @ p["wc"] + p["bc"]
                kind = shape.word_class[w]
                total += x[0, kind] - np.logaddexp.reduce(x[0])
                if w:
                    s, e = shape.starts[kind - 1], shape.starts[kind]
                    x = h.astype(float) @ p["wo"][:, s:e] + p["bo"][s:e]
                    total += x[0, w - 1 - s] - np.logaddexp.reduce(x[0])
                last = w
            assert found == pytest.approx(total, rel=1e-4, abs=1e-3)


def test_training_is_the_same_with_and_without_the_shift(monkeypatch):
    counts = np.array([9.0, 5, 4, 2, 2, 1])
    shape = gru.Shape.of(counts, 3)
    docs = [np.random.default_rng(n).integers(0, 7, n) for n in (5, 33, 70, 64, 200)]
    got = []
    for safe in (60.0, 0.0):
        monkeypatch.setattr(gru, "SAFE", safe)
        trainer = gru.Trainer(gru.initial(counts, 3.0, shape, 4), shape, 1)
        trainer.train(docs, 3, 8)
        got.append(trainer.p)
    assert all(got[0][k] == pytest.approx(got[1][k], abs=1e-3) for k in got[0])


def test_few_long_documents_take_many_steps_at_a_time(monkeypatch):
    counts = np.array([9.0, 5, 4, 2, 2, 1])
    shape = gru.Shape.of(counts, 3)
    calls, take = [], gru.log_probs_at
    monkeypatch.setattr(gru, "log_probs_at", lambda *a: (calls.append(len(a[3])), take(*a))[1])
    docs = [np.random.default_rng(n).integers(0, 7, n) for n in (5000, 4000, 10)]
    gru.score(gru.initial(counts, 3.0, shape, 4), shape, docs, 1)
    assert sum(calls) == 9010 and len(calls) < 5
