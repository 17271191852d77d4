"""Quality classifier from positives and unlabelled text.

The only labels used are trusted positives; what separates them from the rest is learned against unlabelled
web text, of which an unknown share is positive too. All documents of the fold serve as that text, labelled or not, with
their labels unseen. The share (the class prior) is estimated first: a discriminator of positives against unlabelled
text is fitted on one half of both, and on the other half the prior is the least ratio, over all thresholds, of the
unlabelled share above the threshold to the positive share above it, each with its confidence margin; then the halves
change places. A linear model then minimises the non-negative unbiased risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with the logistic loss and a ridge; where the second term falls below 0 its gradient is reversed, so the model
cannot profit from calling its own positives negative. The sigmoid of its output is the score.

Every step of the minimisation is one pass over the features of all unlabelled documents, whose gradient is summed over
tasks, so weights do not depend on how documents lie in tasks. Only the curvature that scales the step comes from samples:
at most about MOST positives (the bound of the labelled rows that are used at all) and MOST unlabelled documents. It decides
how fast the steps come to the minimum, not where that lies.

Features come from the whole text only: the frequencies of pairs of character kinds, and a few figures on
words and lines. They are written once for training. Scoring covers every document.

Cases: a null text is an empty one, and an empty text is scored as any other; a very long text costs in proportion to its
length; rows are kept as they are, null and repeated ids included; of several labels of one document the highest counts;
null labels are none; a positive id with several texts counts with one of them; an empty table gives no rows; without
positives among the documents every score is 0.5. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, documents, each, held_out, map_arrow, materialize, session_of, texts

#: About the most positives (labelled rows) that the model is fitted on, and unlabelled documents that tell the curvature.
MOST = 6000
SEED, STEPS, DECAY = 11, 14, 0.1
#: A step that moves no weight by more than this is the last.
SMALL = 2e-3
THRESHOLD = 0.7

#: Kinds of bytes: one for each mark that is not a letter or digit, one each for a-z, A-Z, 0-9, other
#: control characters, and the leading and following bytes of longer characters.
MARKS = "\n !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
KIND = np.zeros(256, np.int64)
for _b in range(256):
    KIND[_b] = 1 if 97 <= _b < 123 else 2 if 65 <= _b < 91 else 3 if 48 <= _b < 58 else 4 if _b >= 192 else 5 if _b >= 128 else 6 + MARKS.index(chr(_b)) if chr(_b) in MARKS else 0
KINDS = 6 + len(MARKS)
PLAIN = 14
WIDTH = KINDS + 256 + PLAIN
#: Pairs of kinds share 256 places.
PLACE = (np.arange(KINDS)[:, None] * 31 + np.arange(KINDS)[None, :] * 17).reshape(-1) % 256


def features(text: str) -> np.ndarray:
    data = text.encode("utf-8", "replace")
    out = np.zeros(WIDTH, np.float32)
    if not data:
        return out
    kind = KIND[np.frombuffer(data, np.uint8)]
    single = np.bincount(kind, minlength=KINDS)
    out[:KINDS] = np.log1p(single * (1000 / len(data)))
    if len(data) > 1:
        pairs = np.bincount(kind[:-1] * KINDS + kind[1:], minlength=KINDS * KINDS)
        pairs[KINDS + 1] = 0  # two small letters: the bulk of any text
        out[KINDS : KINDS + 256] = np.log1p(np.bincount(PLACE, pairs, 256) * (1000 / len(data)))
    words = data.split()
    n = max(1, len(words))
    often = Counter(words)
    most = often.most_common(3)
    bare = [w.strip(b".,!?;:") for w in often]
    lines = data.split(b"\n")
    size = np.array([len(w) for w in often]) if often else np.zeros(1)
    times = np.array(list(often.values())) if often else np.ones(1)
    letters = max(1, single[1] + single[2])
    out[KINDS + 256 :] = (
        np.log1p(len(data)) / 5,
        np.log1p(n) / 5,
        len(often) / n,
        np.sqrt(len(often) / n),
        sum(c for _, c in most[:1]) / n,
        sum(c for _, c in most) / n,
        float((size * times).sum()) / n / 10,
        float(times[size <= 3].sum()) / n,
        float(times[size >= 12].sum()) / n,
        single[2] / letters,
        sum(b.isalpha() and b.islower() for b in bare) / max(1, len(bare)),
        len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))) / 3,
        1 - (single[1] + single[2] + single[4] + single[5] + single[7]) / len(data),
    )
    return out


@dataclass
class Linear:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def summed(rows: DataFrame, figures) -> np.ndarray:
    """The sum over tasks of figures(x), one vector for each block x of features. rows: x (16-bit floats), half."""

    def one(it: Iterator[pa.RecordBatch]):
        total = None
        for batch in it:
            if batch.num_rows:
                own = figures(matrix(batch.column("x").to_pylist()), np.array(batch.column("half").to_pylist()))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"v": [sum(np.frombuffer(v) for v in group["v"]).tobytes()]})

    # sums of a few tasks first, so that the driver adds at most 32
    some = map_arrow(rows.select("x", "half"), one, "v binary").withColumn("few", F.pmod(F.spark_partition_id(), F.lit(32)))
    got = [np.frombuffer(r["v"]) for r in some.groupBy("few").applyInPandas(add, "v binary").collect()]
    return sum(sorted(got, key=lambda v: v.tobytes())) if got else np.zeros(1)


def matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float16).reshape(len(rows), WIDTH).astype(np.float32)


def scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features around 0 with a last one of 1 for the bias."""
    out = np.ones((len(x), x.shape[1] + 1), np.float32)
    np.clip((x - mean.astype(np.float32)) / scale.astype(np.float32), -6, 6, out=out[:, :-1])
    return out


def negative_part(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
    """The sums of the slopes and of the losses of calling every row negative."""
    z = (x @ w.astype(np.float32)).astype(np.float64)
    return (x.T @ sigmoid(z).astype(np.float32)).astype(np.float64), float(np.logaddexp(0, z).sum())


def curvature(x: np.ndarray, w: np.ndarray, weight: float) -> np.ndarray:
    s = sigmoid(x @ w)
    return (x * (s * (1 - s) * (weight / max(1, len(x))))[:, None]).T @ x


def step_of(w: np.ndarray, p: np.ndarray, slope_u: np.ndarray, loss_u: float, bend: np.ndarray, prior: float | None, decay: float = DECAY) -> np.ndarray:
    """How w moves, from means over positives p and the unlabelled text's mean slope and loss.

    Without a prior: positives against unlabelled text. With one: the non-negative risk; while its second term is
    below 0 that term alone is raised.
    """
    ridge = np.full(len(w), decay)
    ridge[-1] = 1e-6
    z = p @ w
    if prior is None:
        slope = slope_u - p.T @ sigmoid(-z) / len(p)
        bend = bend + curvature(p, w, 1.0)
    elif loss_u - prior * np.logaddexp(0, z).mean() >= 0:
        slope = slope_u - prior * p.mean(0)  # the slopes of R_p(+) and -R_p(-) add up to this
    else:
        return 0.2 * np.linalg.solve(bend + np.diag(ridge), slope_u - prior * (p.T @ sigmoid(z)) / len(p))
    return -np.linalg.solve(bend + np.diag(ridge), slope + ridge * w)


def risk(w: np.ndarray, p: np.ndarray, loss_u: float, prior: float | None, decay: float = DECAY) -> float:
    """What is minimised, from the unlabelled text's mean loss."""
    z = p @ w
    ridge = 0.5 * (decay * float(w[:-1] @ w[:-1]) + 1e-6 * float(w[-1]) ** 2)
    if prior is None:
        return float(np.logaddexp(0, -z).mean()) + loss_u + ridge
    return prior * float(np.logaddexp(0, -z).mean()) + max(0.0, loss_u - prior * float(np.logaddexp(0, z).mean())) + ridge


def damped(move: np.ndarray, most: float = 2.0) -> np.ndarray:
    return move * min(1.0, most / max(1e-12, float(np.abs(move).max())))


def prior_of(above_p: np.ndarray, above_u: np.ndarray, n_p: int, n_u: int) -> float:
    """The least ratio of the shares above a threshold; the margin of each share keeps small counts from winning."""
    margin = np.sqrt(np.log(20) / 2 / n_p) + np.sqrt(np.log(20) / 2 / n_u)
    ok = above_p > 0
    best = int(np.argmin((above_u[ok] + margin) / above_p[ok]))
    return float(above_u[ok][best] / above_p[ok][best])


def fitted(rows: DataFrame, p: np.ndarray, sample: np.ndarray, halves: list[int | None], priors: list[float | None], mean: np.ndarray, scale: np.ndarray, p_half: np.ndarray) -> list[np.ndarray]:
    """The weights of one model for each entry of halves (None: all rows), all trained in the same passes over rows."""
    width = WIDTH + 1
    weights = [np.zeros(width) for _ in halves]
    mine = lambda x, half, h: x if h is None else x[half == h]
    open_ = [True] * len(halves)
    best = [(np.inf, w) for w in weights]
    for _ in range(STEPS):
        now = [w.copy() for w in weights]

        def figures(x: np.ndarray, half: np.ndarray) -> np.ndarray:
            x, out = scaled(x, mean, scale), []
            for w, h in zip(now, halves):
                own = mine(x, half, h)
                slope, loss = negative_part(own, w)
                out.append(np.concatenate([slope, [loss, len(own)]]))
            return np.concatenate(out)

        got = summed(rows, figures).reshape(len(halves), width + 2)
        for i, (h, prior, one) in enumerate(zip(halves, priors, got)):
            n = max(1.0, one[-1])
            best[i] = min(best[i], (risk(weights[i], mine(p, p_half, h), one[-2] / n, prior), weights[i]), key=lambda x: x[0])
            move = damped(step_of(weights[i], mine(p, p_half, h), one[:width] / n, one[-2] / n, curvature(sample, weights[i], 1.0), prior))
            weights[i] = weights[i] + move
            open_[i] = float(np.abs(move).max()) > SMALL
        if not any(open_):
            return weights
    return [w for _, w in best]  # reversed steps go to and fro


def class_prior(rows: DataFrame, p: np.ndarray, sample: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> float:
    """The share of positives in the unlabelled text, from two discriminators, each tried on the half it has not seen."""
    p_half = np.arange(len(p)) % 2
    if len(p) < 2:
        return 0.5
    weights = fitted(rows, p, sample, [0, 1], [None, None], mean, scale, p_half)
    other = [p[p_half != h] for h in (0, 1)]
    cuts = [np.unique((x @ w.astype(np.float32)).astype(np.float64)) for x, w in zip(other, weights)]

    def figures(x: np.ndarray, half: np.ndarray) -> np.ndarray:
        x, out = scaled(x, mean, scale), []
        for h, w, c in zip((0, 1), weights, cuts):
            z = np.sort((x[half != h] @ w.astype(np.float32)).astype(np.float64))
            out += [len(z) - np.searchsorted(z, c), [len(z)]]
        return np.concatenate(out).astype(np.float64)

    got, at, found = summed(rows, figures), 0, []
    for x, w, c in zip(other, weights, cuts):
        above_u, n_u = got[at : at + len(c)], got[at + len(c)]
        at += len(c) + 1
        if not n_u:
            return 0.5
        z = np.sort((x @ w.astype(np.float32)).astype(np.float64))
        found.append(prior_of((len(z) - np.searchsorted(z, c)) / len(z), above_u / n_u, len(z), int(n_u)))
    return float(np.clip(np.mean(found), 0.05, 0.98))


def featured(docs: DataFrame) -> DataFrame:
    """The text's features as 16-bit floats in a binary column, the other columns as they are."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = pa.array([features(t).astype(np.float16).tobytes() for t in texts(batch)], pa.binary())
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), x], names=[*(c for c in batch.schema.names if c != "text"), "x"])

    kinds = [f"{c} {t}" for c, t in docs.dtypes if c != "text"]
    return map_arrow(docs, lambda it: each(it, one), ", ".join([*kinds, "x binary"]))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST, seed: int = SEED) -> tuple[Linear | None, float]:
    """The model, and the class prior it was fitted with. docs: doc_id, text; labels: doc_id, quality."""
    session_of(docs)
    positive = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    n = positive.count()
    if not n:
        return None, 0.5
    # most of them by a hash of the id: about that many, and so a table that can be told to all tasks
    order = F.xxhash64(F.lit(seed), "doc_id").cast("double")
    chosen = positive.where(order <= 2.0**64 * min(1.0, most / n) - 2.0**63).withColumn("positive", F.lit(1))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id", "left")
    half = F.pmod(F.xxhash64(F.lit(seed), "x"), F.lit(2)).cast("int")
    rows = materialize(featured(plain).withColumn("half", half))
    own = rows.where("positive = 1").groupBy("doc_id").agg(F.min("x").alias("x")).collect()
    if not own:
        return None, 0.5
    p = matrix([bytes(r["x"]) for r in sorted(own, key=lambda r: r["doc_id"])])
    size = rows.count()
    some = rows.where(F.xxhash64(F.lit(seed + 1), "x", "doc_id").cast("double") <= 2.0**64 * min(1.0, most / size) - 2.0**63).select("x").limit(4 * most).collect()
    u = matrix(sorted(bytes(r["x"]) for r in some)) if some else p
    got = summed(rows, lambda x, half: np.concatenate([x.sum(0, np.float64), (x.astype(np.float64) ** 2).sum(0)]))
    mean = got[:WIDTH] / size
    scale = np.maximum(np.sqrt(np.maximum(0, got[WIDTH:] / size - mean**2)), 1e-2)
    p, u = scaled(p, mean, scale), scaled(u, mean, scale)
    prior = class_prior(rows, p, u, mean, scale)
    (w,) = fitted(rows, p, u, [None], [prior], mean, scale, np.zeros(len(p)))
    discard(rows)
    return Linear(mean, scale, w[:-1], float(w[-1])), prior


def classify(docs: DataFrame, model: Linear | None) -> DataFrame:
    """docs with score and predicted (score >= THRESHOLD); docs keep their columns but for text."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        if model is None:
            score = np.full(batch.num_rows, 0.5)
        else:
            score = model.score(np.stack([features(t) for t in texts(batch)]))
        keep = [c for c in batch.schema.names if c != "text"]
        arrays = [*(batch.column(c) for c in keep), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))]
        return pa.RecordBatch.from_arrays(arrays, names=[*keep, "score", "predicted"])

    kinds = [f"{c} {t}" for c, t in docs.dtypes if c != "text"]
    return map_arrow(docs, lambda it: each(it, one), ", ".join([*kinds, "score double", "predicted int"]))


def learned(docs: DataFrame, labels: DataFrame) -> Linear | None:
    """The model from the rows whose fold may be learned from."""
    outside = lambda x: x.where(~held_out("doc_id", 4, 2))
    return train(outside(docs.select("doc_id", "text")), outside(labels.select("doc_id", "quality")))[0]


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", 4, 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return classify(plain, model)
