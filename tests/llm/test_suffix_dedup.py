import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from stratalog.llm import suffix_dedup as S


def brute(texts, length=S.LENGTH):
    data = [(t or "").encode() for t in texts]
    often = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if often[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randint(60, 160)) for _ in range(6)]
    base = text(500)
    docs = [None, "", "short", "x" * 399, "x" * 400, "x" * 1500, "ab" * 700, "ab" * 700 + "tail"]
    for _ in range(30):
        docs.append(text(rng.randint(0, 90)) + rng.choice(passages)[rng.randint(0, 60) :] + text(rng.randint(0, 90)))
    for _ in range(60):  # one passage in many surroundings
        docs.append(text(rng.randint(30, 50)) + passages[0] + text(rng.randint(30, 50)))
    for _ in range(25):  # edited copies
        x = list(base)
        for _ in range(rng.randint(1, 6)):
            x[rng.randrange(len(x))] = rng.choice("xyz")
        docs.append("".join(x))
    docs += [docs[20], docs[20], passages[1] + passages[1], docs[30]]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, name int").repartition(5)


def same(got, docs, lengths):
    wants = [brute(docs, n) for n in lengths]
    for r in got:
        i = r["doc_id"]
        assert tuple(r)[1:5] == wants[0][i], i
        assert r["covered_bytes"] == [w[i][1] for w in wants], i
    assert len(got) == len(docs)


def test_same_as_brute_force(spark):
    for seed, lengths in ((1, (400,)), (2, (400, 200)), (3, (90,))):
        docs = corpus(seed)
        same(S.suffix_dedup(frame(spark, docs), lengths).collect(), docs, lengths)


def test_common_cores_are_told_and_heavy_ones_counted(spark, monkeypatch):
    docs = corpus(4)
    monkeypatch.setattr(S, "FLOOR", 6)
    for group, floor in ((50_000, 6), (12, 6), (12, 10**6), (2, 3)):
        monkeypatch.setattr(S, "GROUP", group)
        monkeypatch.setattr(S, "FLOOR", floor)
        same(S.suffix_dedup(frame(spark, docs), (400, 200)).collect(), docs, (400, 200))


def test_one_passage_in_thousands_of_surroundings(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(500)
    docs = [text(rng.randint(0, 150)) + passage[rng.randint(0, 90) : len(passage) - rng.randint(0, 90)] + text(rng.randint(0, 150)) for _ in range(3000)]
    same(S.suffix_dedup(frame(spark, docs), (400, 200)).collect(), docs, (400, 200))


def test_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(S, "RUN_BYTES", 20_000)
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    part = text(3000)
    docs = [text(60_000) + part + text(40_000) + part, "ab" * 30_000, text(10) + part[100:900]]
    same(S.suffix_dedup(frame(spark, docs)).collect(), docs, (400,))


def test_query_columns(spark, tmp_path):
    docs = corpus(6)
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = S.op7_suffix_dedup(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage"]
    want, short = brute(docs), brute(docs, S.PASSAGE)
    for r in got.collect():
        assert tuple(r)[1:] == (*want[r["doc_id"]], short[r["doc_id"]][1])


def test_null_ids_repeated_rows_and_empty(spark):
    long = "".join(random.Random(1).choice("abc") for _ in range(600))
    df = spark.createDataFrame([(None, long), (1, long), (1, long), (2, "a")], "doc_id long, text string")
    assert sorted((r["n_removed"], r["n_spans"]) for r in S.suffix_dedup(df).collect()) == [(0, 0), (600, 1), (600, 1), (600, 1)]
    assert S.suffix_dedup(df.where(F.lit(False))).count() == 0


def test_merge_gives_order_and_shared_lengths():
    rng = random.Random(9)
    pool = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    lists = [sorted(rng.sample(pool, rng.randint(0, 60))) for _ in range(7)]
    streams = [S.read_run(S.write_run([(s, b"", 0, bytes([i])) for s in one])) for i, one in enumerate(lists)]
    merged = list(S.merge(streams))
    assert [u[0] for _, u in merged] == sorted(s for one in lists for s in one)
    for (_, a), (k, b) in zip(merged, merged[1:]):
        assert k == S.shared(a[0], b[0])
