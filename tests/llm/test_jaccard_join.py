import random
import re

import numpy as np
from pyspark.sql import functions as F

from stratalog.llm import jaccard_join as J


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute(texts):
    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def corpus(seed, copies=60):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(300)]
    text = lambda n: [rng.choice(pool) for _ in range(n)]
    passage, docs = text(60), [None, "", "  \n", "A b", "a B", "one two three four five", "É x", "é x"]
    for _ in range(5):
        x = text(rng.randint(40, 300))
        for _ in range(copies):
            if rng.random() < 0.7:
                x = list(x)
                for _ in range(rng.randint(1, 4)):
                    x[rng.randrange(len(x))] = rng.choice(pool)
            docs.append(" ".join(x))
    docs += [" ".join(text(20) + passage + text(rng.randint(0, 40))) for _ in range(40)]
    rng.shuffle(docs)
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 3) for i, t in enumerate(docs)], "doc_id long, text string, name int").repartition(3)


def test_components_are_those_of_brute_force(spark):
    docs = corpus(1)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.near_copies(frame(spark, docs)).collect()}
    assert [got[i] for i in range(len(docs))] == brute(docs)


def test_divided_regions_lose_no_link(spark, monkeypatch):
    docs = corpus(2, 40)
    sets = [J.gram_set(t or "") for t in docs]
    want = brute(docs)
    kept = [i for i, s in enumerate(sets) if len(s)]
    for leaf, pivots in ((10**9, 4), (40, 4), (4, 4), (2, 24)):
        forest = J.Forest(len(kept))
        J.join_region(J.Sets([sets[i] for i in kept]), np.arange(len(kept)), forest, pivots=pivots, leaf=leaf)
        assert [kept[forest.root(i)] for i in range(len(kept))] == [want[i][1] for i in kept]
    # the same across tasks: all sets in one region, split twice and more
    one = spark.createDataFrame([(J.set_name(sets[i]), 1, sets[i].tobytes()) for i in kept], "name long, region long, grams binary")
    monkeypatch.setattr(J, "CAPACITY", 30)
    found = J.links(one, pivots=6, capacity=30).collect()
    number = {J.set_name(sets[i]): i for i in reversed(kept)}
    forest = J.Forest(len(docs))
    for i in kept:
        forest.link(i, number[J.set_name(sets[i])])
    for a, b in found:
        forest.link(number[a], number[b])
    assert [forest.root(i) for i in kept] == [want[i][1] for i in kept]


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (7, None), (7, None), (None, "z")], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"], r["component_id"]) for r in J.near_copies(df).where("doc_id is not null").collect())
    assert got == [(False, 4, 4), (False, 4, 4), (False, 7, 7), (False, 7, 7)]
    assert sorted(str(r["component_id"]) for r in J.near_copies(df).where("doc_id is null").collect()) == ["4", "None"]
    assert J.near_copies(df.where(F.lit(False))).count() == 0


def test_ordinary_documents_are_divided_by_set_pivots(spark):
    """The regions of sf0.01 that hold more than a leaf go through set pivots, some of them twice and more."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = J.cells(docs, 5, 80)
    sets = {}
    for r in docs.collect():
        g = J.gram_set(r["text"] or "")
        if len(g):
            sets[J.set_name(g)] = g
    groups = {}
    for r in J.regions(J.materialize(rows), 80).collect():
        groups.setdefault(r["component"], []).append(r["node"])
    levels = []
    for names in groups.values():
        if len(names) > J.LEAF:
            forest = J.Forest(len(names))
            levels.append(J.join_region(J.Sets([sets[x] for x in names]), np.arange(len(names)), forest))
    assert levels and min(levels) >= 1
    # a group of edited copies, each made from the one before, is divided within its divisions
    rng, x, chain = random.Random(3), [f"w{i}" for i in range(300)], []
    for i in range(200):
        x = list(x)
        x[rng.randrange(300)] = f"e{i}"
        chain.append(J.gram_set(" ".join(x)))
    forest = J.Forest(200)
    assert J.join_region(J.Sets(chain), np.arange(200), forest, pivots=4) >= 2
    assert {forest.root(i) for i in range(200)} == {0}


def test_sets_in_everyones_window_are_compared_once():
    # all pairs at distances of some 0.3 to 0.4: near every pivot, yet not linked
    rng = random.Random(9)
    base = list(range(1000))
    sets = [np.array(sorted([*rng.sample(base, 800), *rng.sample(range(1000, 9000), 20)]), np.uint64) for _ in range(400)]
    calls, common = [], J.Sets.common
    all_, forest = J.Sets(sets), J.Forest(400)
    all_.common = lambda *a: calls.append(1) or common(all_, *a)
    J.join_region(all_, np.arange(400), forest)
    assert len(calls) < 2000 and not forest.links


def test_a_very_long_text(spark):
    rng = random.Random(4)
    words = [f"w{rng.randint(0, 5000)}" for _ in range(60_000)]
    other = list(words)
    for j in rng.sample(range(60_000), 1500):
        other[j] = "x"
    docs = [" ".join(words), " ".join(other), "q" * 300_000, " ".join(words[:40_000])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.near_copies(frame(spark, docs)).collect()}
    assert [got[i] for i in range(4)] == brute(docs)


def test_a_region_that_pivots_cannot_divide_is_bounded(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(150):  # distinct near copies of one text, each within reach of every other
        x = list(base)
        for j in rng.sample(range(400), 3):
            x[j] = f"e{i}"
        docs.append(" ".join(x))
    sets = [J.gram_set(t) for t in docs]
    df = spark.createDataFrame([(J.set_name(s), 1, s.tobytes()) for s in sets], "name long, region long, grams binary")
    seen, run = [], J.paired

    def paired(*a):
        seen.append(run(*a))
        return seen[-1]

    monkeypatch.setattr(J, "CAPACITY", 30)
    monkeypatch.setattr(J, "paired", paired)
    found = J.links(df, pivots=6, capacity=30).collect()
    assert max(r["count"] for r in seen[0].groupBy("region").count().collect()) <= 60
    number = {J.set_name(s): i for i, s in enumerate(sets)}
    forest = J.Forest(len(docs))
    for a, b in found:
        forest.link(number[a], number[b])
    assert [forest.root(i) for i in range(len(docs))] == [g for _, g in brute(docs)]
