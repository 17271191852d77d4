"""Log-likelihood of whole documents under a gated recurrent language model.

Word counts cover every training document; tasks count their own words first, so the shuffle carries each word
once per task. The VOCABULARY most frequent words are the model's; at most about FREQUENT frequent ones
are told to all tasks (both bounded); all others are looked up by a join. Every document is turned into the model's
numbers once, and these are written for training and scoring.

Training is one pass over every training document. The corpus is dealt to shards of about SHARD words by a hash of
id and text, and shards to at most ROUNDS rounds: in a round each shard is trained on by itself from the common weights, its
documents in the order of their hashes, and the shards' weights are averaged by the words they saw, in the order of shards.
So the weights do not depend on how documents lie in files and tasks. Weights have a fixed size whatever the corpus; a
shard has a bounded size, and their number grows with the corpus.

A document's score is the sum over its words, the end included, of log10 p(class | state) plus, for a word of
the vocabulary, log10 p(word | class, state), and for any other word log10 of its share among the words outside
the vocabulary by smoothed counts. Words never seen are one event of the smoothed counts, as in the base score.

Cases: a null or empty text has its end only; null ids count as an empty text for the fold; repeated rows
are scored each, and each trains; a very long text is one lane of its own beside others, its state carried throughout; ties
in frequency go to the smaller word; without training documents all scores are 0 (one event with probability 1); an empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import documents, held_out, map_arrow, materialize, session_of

VOCABULARY, FREQUENT = 2048, 131_072
#: Words of a shard, about, and rounds of training over different shards.
SHARD, ROUNDS = 2_000_000, 3
#: Words that a task counts before it hands the counts on, and words it scores at a time.
COUNTED, SCORED = 400_000, 6_000_000
END = b""
SMOOTH = 0.1


def words_of(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of a batch of texts, the place among them of each word of each text, its end included, and
    where each text's words begin."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(batch.column("text"), "")))
    flat = lists.flatten().dictionary_encode()
    different = pa.concat_arrays([flat.dictionary.cast(pa.binary()), pa.array([END], pa.binary())])
    which = flat.indices.to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    # what stands before a first blank and after a last one is empty, and no word
    kept = np.append(pc.binary_length(different).to_numpy(zero_copy_only=False)[:-1] > 0, True)[which]
    which, text = which[kept], text[kept]
    ends = np.cumsum(np.bincount(text, minlength=len(lists)) + 1)
    out = np.full(len(which) + len(lists), len(different) - 1, np.int32)
    out[np.arange(len(which)) + text] = which
    return different, out, np.append(0, ends)[:-1]


def word_counts(docs: DataFrame) -> DataFrame:
    """word and c of every word of the training documents."""

    def count(it: Iterator[pa.RecordBatch]):
        held, size = [], 0

        def rows():
            each_ = pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("c", "sum")])
            return pa.Table.from_arrays([each_["word"], each_["c_sum"]], names=["word", "c"]).combine_chunks().to_batches()

        for batch in it:
            if not batch.num_rows:
                continue
            different, which, _ = words_of(batch)
            n = np.bincount(which, minlength=len(different))
            used = np.flatnonzero(n)
            held.append(pa.RecordBatch.from_arrays([different.take(pa.array(used)), pa.array(n[used], pa.int64())], names=["word", "c"]))
            size += len(used)
            if size > COUNTED:
                held, size = rows(), 0
                # many of them are new: hand on
                if (size := sum(map(len, held))) > COUNTED // 2:
                    yield from held
                    held, size = [], 0
        if held:
            yield from rows()

    return map_arrow(docs.where("NOT held_out").select("text"), count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Lexicon:
    """Frequent words in order of frequency; numbers up to v are the model's words 1 to v."""

    def __init__(self, words: list[bytes], counts: list[int], total: int, distinct: int, v: int) -> None:
        self.words, self.total, self.distinct, self.v = words, total, distinct, min(v, len(words))
        self.told, self.counts = pa.array(words, pa.binary()), np.array(counts, np.float64)
        self.outside = max(0.0, total - float(self.counts[: self.v].sum()))
        self.shape = gru.Shape.of(self.counts[: self.v])
        self.base = self.log10(self.counts)
        # the smoothed share of all words outside the vocabulary
        self.rest = float(np.log10(max(1e-300, 1 - float((10 ** self.base[: self.v]).sum()))))

    def log10(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + SMOOTH) / (self.total + SMOOTH * (self.distinct + 1)))

    def find(self, words: pa.Array) -> np.ndarray:
        """The number of each word, -1 for those not told."""
        return pc.fill_null(pc.index_in(words, value_set=self.told), -1).to_numpy(zero_copy_only=False)

    def model(self, found: np.ndarray) -> np.ndarray:
        return np.where((found >= 0) & (found < self.v), found + 1, 0)


def lexicon(counts: DataFrame, v: int, frequent: int) -> Lexicon:
    """The words of the highest counts: whole classes of like counts while they fit into frequent, and the v first at least."""
    n = counts.agg(F.sum("c"), F.count("*")).first()
    level = F.floor(F.log2("c") * 16).cast("int")
    # a few hundred rows whatever the corpus
    sizes = sorted(((r["level"], r["n"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, held = 1 << 30, 0
    for at, size in sizes:
        if held + size > frequent:
            break
        least, held = at, held + size
    is_end = F.col("word") == END
    found = counts.where((level >= least) | is_end).collect()
    missing = min(v, n[1]) - len(found)
    if missing > 0:
        found += counts.where((level < least) & ~is_end).orderBy(F.desc("c"), "word").limit(missing).collect()
    pairs = sorted(((bytes(r["word"]), r["c"]) for r in found), key=lambda x: (x[0] != END, -x[1], x[0]))
    return Lexicon([w for w, _ in pairs], [c for _, c in pairs], n[0] or 0, n[1], v)


def mapped(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """One row per document: ids (the model's numbers as 16-bit integers), sums over the told words, and the other words
    with their numbers. docs: doc_id, text, held_out."""
    shared = docs.sparkSession.sparkContext.broadcast(lex)
    other = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))
    kind = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("part", pa.float64()), ("others", other), ("ids", pa.binary())])

    def one(it: Iterator[pa.RecordBatch]):
        words = shared.value
        for batch in it:
            if not batch.num_rows:
                continue
            different, which, starts = words_of(batch)
            ends = np.append(starts[1:], len(which))
            found = words.find(different)[which]
            told, outside = found >= 0, (found < 0) | (found >= words.v)
            base = np.where(told, words.base[np.maximum(found, 0)], 0.0) if len(words.base) else np.zeros(len(found))
            # words outside the vocabulary: their share of that class; what is not told is added after the join
            part = np.add.reduceat(np.where(outside, base, 0.0), starts) - words.rest * np.add.reduceat(outside.astype(np.int64), starts)
            unknown = np.flatnonzero(~told)
            text = np.searchsorted(starts, unknown, "right") - 1
            pairs, n = np.unique(text * len(different) + which[unknown], return_counts=True)
            rest = pa.StructArray.from_arrays([different.take(pa.array(pairs % len(different))), pa.array(n, pa.int32())], fields=list(other.value_type))
            cuts = np.searchsorted(pairs, np.arange(len(starts) + 1) * len(different))
            ids = words.model(found).astype("<i2")
            binary = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((np.append(0, ends) * 2).astype(np.int32)), pa.py_buffer(ids)])
            sums = [ends - starts, np.add.reduceat(told.astype(np.int64), starts), np.add.reduceat(base, starts), part]
            others = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), rest).cast(other)
            columns = [*(batch.column(c) for c in ("row", "doc_id", "held_out")), *(pa.array(x, f.type) for x, f in zip(sums, list(kind)[3:])), others, binary]
            yield pa.RecordBatch.from_arrays(columns, schema=kind)

    kinds = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, part double, others array<struct<word:binary,n:int>>, ids binary"
    return map_arrow(docs.withColumn("row", F.monotonically_increasing_id()), one, kinds)


def trained(rows: DataFrame, lex: Lexicon, shard: int, rounds: int) -> dict[str, np.ndarray]:
    """The model's weights after all rounds. rows: row, doc_id, held_out, ids."""
    spark = rows.sparkSession
    weights = gru.initial(lex.counts[: lex.v], lex.outside, lex.shape)
    names = sorted(weights)
    shards = max(1, -(-int(lex.total) // shard))
    rounds = min(rounds, shards)
    # a row without an id is dealt by its place, so that copies without ids do not meet in one shard
    order = F.xxhash64(F.lit(23), F.coalesce("doc_id", "row"), "ids")
    dealt = rows.where("NOT held_out").select("ids", order.alias("order"), F.pmod(order, F.lit(shards)).alias("shard"))
    kind = "name string, shard long, n long, w binary"

    def add(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard")
        total = sum(np.frombuffer(w, "<f8") for w in group["w"])
        return pd.DataFrame({"name": [group["name"].iloc[0]], "shard": [group["shard"].iloc[0]], "n": [int(group["n"].sum())], "w": [total.tobytes()]})

    for r in range(rounds):
        shared = spark.sparkContext.broadcast((weights, lex.shape))

        def train(group: pd.DataFrame) -> pd.DataFrame:
            start, shape = shared.value
            trainer = gru.Trainer(start, shape, 1)
            trainer.train(np.frombuffer(x, "<i2") for x in group.sort_values("order", kind="stable")["ids"])
            one = int(group["shard"].iloc[0])
            return pd.DataFrame([(name, one, trainer.words, (trainer.p[name].astype("<f8") * trainer.words).tobytes()) for name in names], columns=["name", "shard", "n", "w"])

        some = dealt.where(F.col("shard") % rounds == r).groupBy("shard").applyInPandas(lambda g: train(g), kind)
        # sums of a few shards first, then of those: no task adds more than the square root of all
        few = F.pmod(F.floor(F.col("shard") / rounds), F.lit(32))
        sums = some.withColumn("few", few).groupBy("name", "few").applyInPandas(lambda g: add(g), kind).groupBy("name").applyInPandas(lambda g: add(g), kind)
        got = sums.collect()
        if got:
            weights = {x["name"]: (np.frombuffer(x["w"], "<f8") / x["n"]).astype(np.float32).reshape(weights[x["name"]].shape) for x in got}
        shared.unpersist()
    return weights


def scored(rows: DataFrame, lex: Lexicon, weights: dict[str, np.ndarray]) -> DataFrame:
    """row and model: log10 of the model's probability of each document's numbers. rows: row, ids."""
    shared = rows.sparkSession.sparkContext.broadcast((weights, lex.shape))

    def score(it: Iterator[pa.RecordBatch]):
        p, shape = shared.value
        names: list[int] = []
        ids: list[np.ndarray] = []
        size = 0

        def flush():
            got = gru.score(p, shape, ids, 1) / np.log(10) if p else np.zeros(len(ids))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(got, pa.float64())], names=["row", "model"])

        for batch in it:
            names += batch.column("row").to_pylist()
            own = [np.frombuffer(x, "<i2") for x in batch.column("ids").to_pylist()]
            ids += own
            size += sum(map(len, own))
            if size >= SCORED:
                yield flush()
                names, ids, size = [], [], 0
        if names:
            yield flush()

    return map_arrow(rows.select("row", "ids"), score, "row long, model double")


def lm_scores(docs: DataFrame, vocabulary: int = VOCABULARY, frequent: int = FREQUENT, shard: int = SHARD, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. docs: doc_id, text, held_out."""
    session_of(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "held_out")
    counts = materialize(word_counts(docs))
    lex = lexicon(counts, vocabulary, frequent)
    rows = materialize(mapped(docs, lex))
    weights = trained(rows, lex, shard, rounds) if lex.v else {}
    told = F.lit(float(np.log10(lex.total + SMOOTH * (lex.distinct + 1))))
    others = rows.select("row", F.explode("others").alias("o")).select("row", "o.word", "o.n")
    looked = others.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + SMOOTH) - told)).alias("more"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("seen"),
    )
    more = F.coalesce("more", F.lit(0.0))
    all_ = rows.drop("others", "ids").join(scored(rows, lex, weights), "row").join(looked, "row", "left")
    return all_.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("part") + F.col("model") + more if lex.v else F.col("base") + more).alias("score"),
    )


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir).withColumn("held_out", held_out("doc_id", 10, 0)))
