import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import quality_classifier as Q


def corpus(seed, n=600):
    rng = random.Random(seed)
    small = ["the", "of", "and", "to", "in"]
    word = lambda: rng.choice(small) if rng.random() < 0.4 else "".join(rng.choice("abcdehinorst") for _ in range(rng.randint(3, 9)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 200))]
        good = rng.random() < 0.8
        text = " ".join(words).capitalize() + "." if good else rng.choice([" | ".join(words), " ".join(w.upper() + "!!" for w in words), " ".join(words[:2] * 60)])
        rows.append((i, text, int(good)))
    return rows


def test_held_out_accuracy_and_prior(spark):
    rows = corpus(1)
    docs = spark.createDataFrame([(i, t, "x", 9.0, True, 1, b"") for i, t, _ in rows], "doc_id long, text string, label string, score double, held_out boolean, predicted int, x binary").repartition(3)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 5 < 2], "doc_id long, quality int, toxic int")
    model, prior = Q.train(docs.where(~Q.held_out("doc_id", 4, 2)).select("doc_id", "text"), labels.where(~Q.held_out("doc_id", 4, 2)))
    assert abs(prior - 0.8) < 0.1
    got = {r["doc_id"]: r for r in Q.classify(docs.select("doc_id", "text"), model).collect()}
    unseen = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i]["predicted"] == rows[i][2] for i in unseen]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got.values())


def risk(w, p, u, prior):
    """The non-negative risk with its ridge, word by word from the definition."""
    zp, zu = p @ w, u @ w
    positive = np.mean([np.log1p(np.exp(-z)) for z in zp])
    negative = np.mean([np.log1p(np.exp(z)) for z in zu]) - prior * np.mean([np.log1p(np.exp(z)) for z in zp])
    return prior * positive + max(0.0, negative) + 0.5 * (Q.DECAY * w[:-1] @ w[:-1] + 1e-6 * w[-1] ** 2)


def test_training_reaches_the_least_risk_of_plain_descent(spark):
    rows = corpus(5, 300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 3 == 0], "doc_id long, quality int")
    found = []
    for parts in (1, 5):  # how documents lie in tasks changes nothing
        model, prior = Q.train(docs.repartition(parts), labels)
        found.append(np.append(model.weights, model.bias))
    assert found[0] == pytest.approx(found[1], abs=2e-3)
    x = {i: Q.features(t).astype(np.float16).astype(np.float32) for i, t, _ in rows}
    u = Q.scaled(np.stack([x[i] for i, *_ in rows]), model.mean, model.scale).astype(np.float64)
    p = Q.scaled(np.stack([x[i] for i, _, q in rows if q and i % 3 == 0]), model.mean, model.scale).astype(np.float64)
    w = np.zeros(u.shape[1])
    ridge = np.append(np.full(len(w) - 1, Q.DECAY), 1e-6)
    for _ in range(4000):  # plain gradient descent on all rows
        slope = u.T @ Q.sigmoid(u @ w) / len(u) - prior * p.mean(0) + ridge * w
        w -= 0.02 * slope
    assert risk(found[0], p, u, prior) <= risk(w, p, u, prior) + 5e-3


def test_a_negative_second_term_is_raised():
    rng = np.random.default_rng(4)
    p = np.c_[rng.normal(1, 1, (40, 6)), np.ones(40)]
    u = np.c_[rng.normal(-1, 1, (60, 6)), np.ones(60)]
    w = np.append(np.full(6, 1.5), 0.0)
    term = lambda w: np.logaddexp(0, u @ w).mean() - 0.7 * np.logaddexp(0, p @ w).mean()
    assert term(w) < 0
    slope, loss = Q.negative_part(u, w)
    move = Q.step_of(w, p, slope / len(u), loss / len(u), Q.curvature(u, w, 1.0), 0.7)
    assert term(w + 0.1 * move) > term(w)


def test_prior_is_the_least_ratio_over_all_thresholds():
    rng = np.random.default_rng(5)
    p = rng.normal(1, 1, 80)
    u = np.concatenate([rng.normal(1, 1, 150), rng.normal(-3, 1, 150)])
    margin = np.sqrt(np.log(20) / 2 / len(p)) + np.sqrt(np.log(20) / 2 / len(u))
    best = min(((np.mean(u >= c) + margin) / np.mean(p >= c), np.mean(u >= c) / np.mean(p >= c)) for c in p)[1]
    c = np.unique(p)
    got = Q.prior_of(np.array([np.mean(p >= x) for x in c]), np.array([np.mean(u >= x) for x in c]), len(p), len(u))
    assert got == pytest.approx(best) and abs(got - 0.5) < 0.12


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "a" * 50000), (3, "\n\n|")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in Q.classify(docs, Q.learned(docs, none)).collect()] == [0.5] * 5
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None)], "doc_id long, quality int")
    assert Q.classify(docs, Q.train(docs, labels)[0]).count() == 5
    assert Q.classify(docs.where(F.lit(False)), None).count() == 0
