import math
import random

import numpy as np
from pyspark.sql import functions as F

from stratalog.llm import exact_topk as E


def brute(rows, queries, k):
    ints = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints[(i, tuple(math.floor(1024 * float(np.float32(x))) for x in v))] = None
    out = []
    for q, a in ints:
        if q in queries:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ints if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_same_as_brute_force(spark):
    rng = random.Random(1)
    hot = [0.5, -0.25, 0.125, 1.0]
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(4)]) for i in range(150)]
    rows += [(i, hot) for i in range(150, 230)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [float("nan"), 0.0, 0.0, 0.0]), (303, [float("inf"), 0.0, 0.0, 0.0]), (None, hot), (100, rows[100][1]), (400, [0.0] * 4)]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, rank int").repartition(3)
    queries = {0, 100, 200, 300, 400}
    for shard, block in ((8192, 1024), (20, 2)):
        got = E.exact_topk(df, df.where(F.col("vec_id").isin(*queries)), 10, shard, block)
        assert sorted(tuple(r)[:4] for r in got.collect()) == brute(rows, queries, 10)


def test_few_vectors_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "vec_id long, embedding array<float>")
    got = E.exact_topk(df, df.where("vec_id = 0")).drop("reads").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 1024 * 1024)]
    assert E.exact_topk(df.where("vec_id > 5"), df.where("vec_id > 5")).count() == 0


def test_bounds_hold_and_save_reads():
    rng = np.random.default_rng(3)
    x = np.floor(1024 * rng.normal(0, 0.2, (4000, 32))).astype(np.int64)
    code, low, step = E.approximate(x)
    scores = x @ x[:300].T
    least, most = E.bounds(code, low, step, x[:300])
    assert (least <= scores).all() and (scores <= most).all()
    left = {n: set() for n in range(300)}
    for q, v, a, b in E.scan(np.arange(4000), code, low, step, np.arange(300), x[:300], 10):
        assert (a <= scores[v, q]).all() and (scores[v, q] <= b).all()
        for i, j in zip(q.tolist(), v.tolist()):
            left[i].add(j)
    scores[np.arange(300), np.arange(300)] = scores.min() - 1
    for n in range(300):
        assert set(np.argsort(-scores[:, n], kind="stable")[:10].tolist()) <= left[n] and n not in left[n]
    assert sum(map(len, left.values())) < 300 * 60


def test_shards_keep_the_smallest_ids_of_a_hot_vector():
    x = np.array([[1, 2], [3, 4], [1, 2], [1, 2], [1, 2], [3, 4]])
    assert sorted(E.several(np.array([9, 8, 7, 6, 5, 4]), x, 1).tolist()) == [1, 3, 4, 5]


def test_few_exact_vectors_are_read(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, [rng.gauss(0, 0.2) for _ in range(16)]) for i in range(1500)], "vec_id long, embedding array<float>")
    got = E.exact_topk(df, df.where("vec_id % 100 = 0"), 10, 400, 10)
    reads = {r["query_id"]: r["reads"] for r in got.collect()}
    assert len(reads) == 15 and all(10 <= n < 100 for n in reads.values())
