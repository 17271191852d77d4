"""Exact top-k by inner product with a vector-approximation file.

Every component x becomes floor(1024 * x). The vectors are written twice, in shards: exactly, and as cells, one byte
per component that names one of CELLS intervals of its shard and column. Then

1. queries, in blocks, meet the cells only. The cells bound every score from below and above, for a whole block by one
   matrix product: all intervals of a column are equally wide, so the width adds the same to all vectors of a shard.
   A (block, shard) task returns the vectors whose upper bound reaches the k-th lower bound there;
2. over all shards the k-th lower bound of each query drops most of those;
3. exact vectors are read in the order of their bounds (for scores the upper bound plays the part of a distance's lower
   bound): first the k with the highest bounds, whose k-th score is known then, and after them those alone
   whose bounds reach that score. Nothing unread can enter.

All pairs of a query and a vector have to be bounded; what moves for that is one byte per component and vector
for each block of queries, and the queries once per shard. Exact vectors move once in each of the two turns of step 3,
however many blocks there are.

Copies of one vector in a shard beyond the k + 1 smallest ids cannot be among the k best (ties go to smaller ids
and only a query's own id is left out), so the cells leave them out. This keeps a vector that a third of all
rows share from adding reads, and drops no result.

Cases: rows with a null id, a null vector, or null or non-finite components take no part; an empty vector scores 0 with
all; a shorter vector counts as followed by zeros; repeated rows of one id and vector count once, and differing rows of
one id are candidates each, but never for a query of that id; differing rows of one query's id share one list. Ties go
to the smaller id. Scores must fit a long. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, session_of

SCALE = 1024
#: Vectors of a shard and queries of a block: with 64 components 0.6 MB of cells and 1 MB of queries in a task.
SHARD, BLOCK = 8192, 4096
#: Intervals per component; an interval's number fits one byte.
CELLS = 256
#: Queries of one matrix product: with SHARD vectors 16 MB of bounds.
TURN = 256
#: Most tasks of the scan; a task takes its (block, shard) pairs one after another.
TASKS = 20_000


def prepared(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """Distinct (vec_id, v) with v the integer components, of the rows that take part; key tells the rows of one id apart."""
    c = F.col("embedding")
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    v = F.transform(c, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & c.isNotNull() & fine).select("vec_id", v.alias("v")).distinct().withColumn("key", F.xxhash64("v"))


def matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def approximate(x: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cell of each component, and of each column the least value and the width of its cells."""
    low, high = x.min(0), x.max(0)
    step = np.maximum(1, -(-(high - low + 1) // cells))
    return ((x - low) // step).astype(np.uint8), low, step


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in integers; through floating point where every sum is exact there."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 2**53 else a @ b.T


def bounds(code: np.ndarray, low: np.ndarray, step: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the most that each vector of a shard (rows) can score with each query (columns)."""
    base = product(code.astype(np.int64), queries * step) + (queries @ low)
    return base + np.minimum(queries, 0) @ (step - 1), base + np.maximum(queries, 0) @ (step - 1)


def several(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """The rows without the copies of a vector beyond its k + 1 smallest ids."""
    order = np.lexsort((ids, *vectors.T[::-1]))
    new = np.r_[True, (vectors[order[1:]] != vectors[order[:-1]]).any(1)]
    at = np.arange(len(ids))
    return order[at - np.maximum.accumulate(np.where(new, at, 0)) <= k]


def scan(ids: np.ndarray, code: np.ndarray, low: np.ndarray, step: np.ndarray, qids: np.ndarray, queries: np.ndarray, k: int):
    """(query row, vector row, least, most) arrays of the vectors that the bounds of this shard leave open."""
    width = min(code.shape[1], queries.shape[1])
    code, low, step, queries = code[:, :width], low[:width], step[:width], queries[:, :width]
    never = np.iinfo(np.int64).min
    for at in range(0, len(qids), TURN):
        least, most = bounds(code, low, step, queries[at : at + TURN])
        own = ids[:, None] == qids[None, at : at + TURN]
        least[own] = never
        floor = np.partition(least, len(ids) - k, axis=0)[len(ids) - k] if len(ids) >= k else np.full(least.shape[1], never)
        q, v = np.nonzero(((most >= floor) & ~own).T)
        yield q + at, v, least[v, q], most[v, q]


def cells(vectors: DataFrame, k: int) -> DataFrame:
    """The approximation file: a row per shard with its ids, keys, cells and the intervals of its columns. vectors: vec_id, key, v, shard."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        ids, keys = group["vec_id"].to_numpy(np.int64), group["key"].to_numpy(np.int64)
        x = matrix(group["v"], max(len(v) for v in group["v"]))
        rows = several(ids, x, k)
        code, low, step = approximate(x[rows])
        packed = [a.tobytes() for a in (ids[rows], keys[rows], code, low, step)]
        return pd.DataFrame([(int(group["shard"].iloc[0]), *packed)], columns=["shard", "ids", "keys", "code", "low", "step"])

    return vectors.groupBy("shard").applyInPandas(build, "shard int, ids binary, keys binary, code binary, low binary, step binary")


def blocks_of(queries: DataFrame) -> DataFrame:
    """A row per block of queries. queries: vec_id, key, v, block."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        x = matrix(group["v"], max(len(v) for v in group["v"]))
        small = np.abs(x).max(initial=0) < 2**31
        packed = [group["vec_id"].to_numpy(np.int64).tobytes(), group["key"].to_numpy(np.int64).tobytes(), x.astype(np.int32 if small else np.int64).tobytes()]
        return pd.DataFrame([(int(group["block"].iloc[0]), *packed, x.shape[1])], columns=["block", "qids", "qkeys", "x", "width"])

    return queries.groupBy("block").applyInPandas(build, "block int, qids binary, qkeys binary, x binary, width int")


def candidates(file: DataFrame, blocks: DataFrame, shards: int, n_blocks: int, k: int) -> DataFrame:
    """query_id, query_key, vec_id, key, least, most: what the cells of each shard leave open for each query."""
    to = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tasks = min(TASKS, shards * n_blocks)
    pairs = file.withColumn("block", to(n_blocks)).repartition(tasks, "shard", "block").join(blocks.withColumn("shard", to(shards)).repartition(tasks, "shard", "block"), ["shard", "block"])
    names = ["query_id", "query_key", "vec_id", "key", "least", "most"]

    def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = lambda data: np.frombuffer(data, np.int64)
        for frame in frames:
            for r in frame.itertuples(index=False):
                ids, keys, qids, qkeys, low, step = (whole(x) for x in (r.ids, r.keys, r.qids, r.qkeys, r.low, r.step))
                code = np.frombuffer(r.code, np.uint8).reshape(len(ids), len(low))
                x = np.frombuffer(r.x, np.int32 if len(r.x) == 4 * len(qids) * r.width else np.int64).reshape(len(qids), r.width)
                for q, v, least, most in scan(ids, code, low, step, qids, x.astype(np.int64), k):
                    yield pd.DataFrame(dict(zip(names, (qids[q], qkeys[q], ids[v], keys[v], least, most))))

    return pairs.mapInPandas(one, ", ".join(f"{x} long" for x in names))


def scored(open_: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, vec_id, score: reads the exact vectors of open_ by id."""
    dot: Column = F.aggregate(F.zip_with("v", "q", lambda a, b: F.coalesce(F.try_multiply(a, b), F.lit(0))), F.lit(0).cast("long"), lambda s, x: F.try_add(s, x))
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("key").alias("query_key"), F.col("v").alias("q"))
    return open_.join(vectors.select("vec_id", "key", "v"), ["vec_id", "key"]).join(q, ["query_id", "query_key"]).select("query_id", "vec_id", dot.alias("score"))


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score (and reads, exact vectors read) of each query's k best.

    vectors and queries: vec_id, embedding. An empty side gives no rows.
    """
    session_of(vectors)
    v, q = materialize(prepared(vectors)), materialize(prepared(queries))
    shards, blocks = (max(1, -(-n // size)) for n, size in ((v.count(), shard), (q.count(), block)))
    spread = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    file = materialize(cells(v.withColumn("shard", spread(shards, 1)), k))
    found = materialize(candidates(file, blocks_of(q.withColumn("block", spread(blocks, 2))), shards, blocks, k))

    def kth(rows: DataFrame, by: str) -> DataFrame:
        """query_id, floor: the k-th highest value of by; null where there are fewer."""
        top = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by)))).where(F.col("n") <= k)
        return top.groupBy("query_id").agg(F.when(F.max("n") == k, F.min(by)).alias("floor"))

    reaches = F.col("floor").isNull() | (F.col("most") >= F.col("floor"))
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("most"), "vec_id", "key"))
    open_ = materialize(found.join(kth(found, "least"), "query_id").where(reaches).drop("floor").withColumn("turn", turn))
    first = materialize(scored(open_.where(F.col("turn") <= k), v, q))
    then = scored(open_.where(F.col("turn") > k).join(kth(first, "score"), "query_id").where(reaches), v, q)
    both = first.unionByName(then).withColumn("reads", F.count("*").over(Window.partitionBy("query_id")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "reads")


def op2_exact_topk(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_topk(table, table.where(F.col("vec_id") % 100 == 0)).drop("reads")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
      FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
