import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from stratalog.llm import bpe_chunks, quality_classifier
from stratalog.llm.common import materialize
from stratalog.llm.tokens import encoded, tokenizer, vocabulary_path

from .test_jaccard_join import brute as brute_groups
from .test_suffix_dedup import brute as brute_repeats


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    pool = ["".join(rng.choice("abcdeéfg") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    passage = text(120)
    docs = []
    for _ in range(120):
        docs.append(text(rng.randint(20, 150)))
    docs += [text(100) + passage + text(90) for _ in range(6)]
    docs += [docs[3], docs[3], docs[4] + " more"]
    docs += [" ".join("BUY!!" for _ in range(rng.randint(30, 90))) + " ###" for _ in range(25)]
    docs += [None, "", passage]
    rows = [(i, t, "en", f"s{i % 5}" if i % 7 else None, len(t or "")) for i, t in enumerate(docs)]
    labels = [(i, 0 if t and "BUY" in t else 1, 0) for i, t, *_ in rows if i % 2 == 0 and t]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_every_stage_against_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    names = [n for n, _ in C.STAGES]
    assert names == ["quality", "near_copies", "repeats", "mix", "tokens"]

    after = materialize(C.quality(spark, docs, tables))
    assert after.columns == C.COLUMNS
    left = {r["doc_id"]: r for r in after.collect()}
    model = quality_classifier.learned(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    want = {i for i, r in before.items() if model.score(quality_classifier.features(r["text"] or "")[None, :])[0] >= quality_classifier.THRESHOLD}
    assert set(left) == want and all(tuple(left[i]) == tuple(before[i]) for i in left)
    assert sum("BUY" in (r["text"] or "") for r in left.values()) <= 1
    assert sum("BUY" not in (r["text"] or "BUY") for r in left.values()) >= 125

    ids = sorted(left)
    groups = brute_groups([left[i]["text"] for i in ids])
    want = {i for i, (_, g) in zip(ids, groups) if ids[g] == i}
    after = materialize(C.near_copies_stage(spark, after, tables))
    left = {r["doc_id"]: r for r in after.collect()}
    assert set(left) == want and after.count() == len(want) and all(tuple(left[i]) == tuple(before[i]) for i in left)

    ids = sorted(left)
    cut = dict(zip(ids, brute_repeats([left[i]["text"] for i in ids], C.PASSAGE)))
    after = materialize(C.repeats(spark, after, tables))
    assert after.columns == C.COLUMNS
    now = {r["doc_id"]: r for r in after.collect()}
    for i in ids:
        n_bytes, removed, _, digest = cut[i]
        if not removed:
            assert tuple(now[i]) == tuple(left[i])
        elif n_bytes > removed:
            assert hashlib.sha256(now[i]["text"].encode()).hexdigest() == digest and now[i]["n_chars"] == len(now[i]["text"])
    assert any(c[1] for c in cut.values())

    mixed = materialize(C.mixed(spark, after, tables))
    assert mixed.columns == C.COLUMNS
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert max(times.values()) == 2 and set(times) < set(now)
    words = lambda t: len((t or "").split())
    total = sum(words(r["text"]) for r in now.values())
    assert sum(words(now[i]["text"]) * n for i, n in times.items()) == pytest.approx(1.5 * total, rel=0.1)

    got = sorted((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in C.tokens(spark, mixed, tables).collect())
    path = vocabulary_path(bpe_chunks.VOCABULARY)
    expected = []
    for r in mixed.collect():
        own = encoded(path, [r["text"] or ""])[0]
        expected.append((r["doc_id"], hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer(path).decode(own, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(expected)
    assert sorted(r["doc_id"] for r in C.run(spark, tables).select("doc_id").collect()) == sorted(times.elements())


def test_null_ids_repeats_and_empty_tables(spark, tables):
    odd = spark.createDataFrame([(None, "a b", "en", None, 3), (None, "a b", "en", "s", 3), (1, "c d", "en", "s", 3), (1, "c d", "en", "s", 3), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in C.STAGES:
        assert stage(spark, odd, tables).count() >= 0, name
        assert stage(spark, odd.where(F.lit(False)), tables).count() == 0, name
    kept = C.near_copies_stage(spark, odd, tables).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "None", "None"]


def test_quality_keeps_documents_when_nothing_is_learned(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.quality(spark, docs, str(tmp_path)).count() == docs.count()
    labels = docs.select("doc_id", F.when(F.col("text").contains("BUY"), 0).otherwise(1).alias("quality"))
    assert quality_classifier.learned(docs, labels) is not None


def test_different_texts_of_one_id_are_documents_of_their_own(spark, tables):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    docs = spark.createDataFrame([(3, b, "en", "s", 0), (5, a, "en", "s", 0), (5, b + " more", "en", "s", 0), (5, a, "en", "s", 0), (6, "", "en", "s", 0), (6, None, "en", "s", 0), (7, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r["doc_id"], r["text"] or "") for r in C.near_copies_stage(spark, docs, tables).collect())
    assert kept == [(3, b), (5, a), (6, ""), (7, "")]
    swapped = docs.withColumn("text", F.translate("text", "ab", "ba"))
    kept = sorted((r["doc_id"], (r["text"] or "")[:2]) for r in C.near_copies_stage(spark, swapped, tables).collect())
    assert kept == [(3, "a0"), (5, "b0"), (6, ""), (7, "")]
