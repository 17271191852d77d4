import hashlib
import random

from pyspark.sql import functions as F

from stratalog.llm import syncmers as S


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x") for i, t in zip(ids or range(len(texts)), texts)], "doc_id long, text string, fingerprint string").repartition(3)


def corpus():
    rng = random.Random(1)
    text = lambda n: " ".join("".join(rng.choice("abcdefgé") for _ in range(5)) for _ in range(n))
    return [None, "", "a", "a b c", "🙂" * 9, text(400), text(300), text(5)] + [text(rng.randint(0, 90)) for _ in range(40)] + [text(3000)]


def test_edited_texts_and_likeness(spark):
    texts = corpus()
    got = {r["doc_id"]: r for r in S.fingerprints(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t, n = t or "", texts[(i + 1) % len(texts)] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + n[:cut]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[5]["near_edited"] > 0.35 and got[5]["near_next"] < 0.05 and got[0]["near_next"] == 1.0 and got[1]["fingerprint"] == ""


def test_anchors_are_closed_syncmers_and_free_of_context(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(80)]
    more = words[:3] + ["new"] + words
    rows = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(more))], "i int, text string").select("i", S.anchors(F.col("text")).alias("a")).collect()
    first, second = ({(x["hash"], x["at"]) for x in r["a"]} for r in sorted(rows))
    shift = {(h, at - 4) for h, at in second if at >= 4}
    assert first == shift and 10 < len(first) < 76
    # brute force over hashes of words
    hashed = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").select("i", F.xxhash64("w").alias("h"))
    h = [r["h"] for r in sorted(hashed.collect())]
    pairs = spark.createDataFrame([(i, h[i], h[i + 1]) for i in range(79)], "i int, a long, b long").select("i", F.xxhash64("a", "b").alias("g"))
    g = [r["g"] for r in sorted(pairs.collect())]
    want = {i for i in range(76) if min(g[i : i + 4]) in (g[i], g[i + 3])}
    assert {at for _, at in first} == want


def test_equal_texts_repeats_nulls_and_empty(spark):
    df = frame(spark, ["x y z", "x y z", "q", "q", None], [None, 5, 5, 9, 9])
    got = S.fingerprints(df).collect()
    assert len(got) == 5 and len({r["fingerprint"] for r in got if r["n_chars"] == 5}) == 1
    assert S.fingerprints(df.where(F.lit(False))).count() == 0
    assert S.fingerprints(frame(spark, ["only one here"])).first()["near_next"] == 1.0
