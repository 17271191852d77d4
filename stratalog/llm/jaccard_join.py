"""Exact self-join of documents by the Jaccard metric of their word n-grams, down to components.

d(A, B) = 1 - |A & B| / |A | B| is a metric; documents link when d <= EPS. The space of sets is divided
again and again, and every division keeps each linked pair together somewhere:

1. Pivots that are single n-grams. A set is at distance 1 - 1/|A| from its own n-grams and 1 from all
   others, so its Voronoi cells tie, and the order of hashes decides. The k-th n-gram that two linked sets have in
   common lies within the first |A| - ceil(0.8 |A|) + k of either, as the n-grams passed by are part of their
   symmetric difference: that window of cells is where a set is replicated to, k being a part of the set. So two
   linked sets meet in k cells at least: a set that meets others in fewer has no link, and the k - 1 most
   crowded cells of a set can be left out, as the least crowded cell of a linked pair is never among
   them. What hangs together by the cells that stay is a region, and no link leaves a region. Documents can't be the
   pivots of this first division: two unrelated texts share no n-gram at all, so nearly all sets are at distance 1 from
   nearly all documents, and would fall into one cell.
2. Pivots that are sets. Within a region sets have much in common, and every region of more than LEAF sets is
   divided by set pivots, each the set that is farthest from the pivots before it. A set goes to its nearest pivot
   (or, if all are farther than FAR, to the rest), and is replicated to every other cell j where a partner may live:
   d(x, p_j) <= FAR + EPS, and d(x, p_j) <= d(x, p_home) + 2 EPS. Both follow from the triangle inequality. Sets within
   EPS of a pivot are linked to it there and then. Cells are divided again until they have LEAF sets, in which every
   set is compared with every other, or until all their sets hang together already.
3. A region of more than CAPACITY sets, more than a task should hold, is first divided over tasks in the same way. One
   that pivots do not divide (a sample of its sets tells) stays as it is: its sets are dealt to blocks, and every two
   blocks meet in a task of their own, so no task holds more than about CAPACITY sets.

Copies (equal sets) are one point of the space and are never compared with each other. A task returns at
most one link per set that joins two components of its own, which keeps every component and no pairs.

Sets hold 64-bit hashes of n-grams, and 64-bit hashes name sets; with a billion different sets the chance that
any two share a name is about 3 %.

Cases: a document without words has an empty set, links with nothing and is its own component; one with
fewer than N words has its whole word sequence as one n-gram; a null text is empty; a null doc_id is the
component of nothing but other null ids (component_id is null only if all ids in the component are);
repeated rows link as copies do. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, documents, map_arrow, materialize, session_of, texts
from .components import components

N = 5
#: Link when 100 * intersection >= NEAR * union.
NEAR = 80
EPS = 1 - NEAR / 100
FAR = 0.6
PIVOTS, LEAF, CAPACITY = 24, 2, 8192
#: Sets of a region that tell whether a division is worth it.
TOLD = 256
#: A window holds a SPARE-th of its set more n-grams than one meeting needs.
SPARE = 10
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class WordHashes(dict):
    """Word -> 64-bit hash, kept for the next time while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


WORDS = WordHashes()


def gram_set(text: str, n: int = N) -> np.ndarray:
    """The hashes of the distinct n-grams of a text, ascending."""
    words = text.encode("utf-8", "replace").lower().split()
    h = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = (out ^ h[i : len(h) - width + 1 + i]) * MIX[i % len(MIX)]
        out ^= out >> np.uint64(29)
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


def set_name(grams: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes()))))


def least_common(size: int, near: int = NEAR) -> int:
    """How many n-grams of its window a set shares with any linked set's window (which is at least near % as large)."""
    return -(-(-(-near * size // 100)) // SPARE)


def window(size: int, near: int = NEAR) -> int:
    """The n-grams of a set, first in the common order, among which are size / SPARE that a linked set has there too."""
    return size - -(-near * size // 100) + -(-size // SPARE)


def cells(docs: DataFrame, n: int, near: int) -> DataFrame:
    """doc_id, n_shingles, name of every document, with the cells of its window (once per task for each set)."""
    kind = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("name", pa.int64()), ("cells", pa.list_(pa.int64()))])

    def one(it: Iterator[pa.RecordBatch]):
        seen: set[int] = set()
        for batch in it:
            if len(seen) > 1_000_000:
                seen = set()
            sizes, names, windows = [], [], []
            for t in texts(batch):
                grams = gram_set(t, n)
                name = set_name(grams) if len(grams) else None
                sizes.append(len(grams))
                names.append(name)
                windows.append(None if name is None or name in seen else grams[: window(len(grams), near)].view(np.int64))
                seen.add(name)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(windows, pa.list_(pa.int64()))], schema=kind)

    return map_arrow(docs, one, "doc_id long, n_shingles long, name long, cells array<long>")


def regions(rows: DataFrame, near: int) -> DataFrame:
    """node (set name) and component of the sets that share enough cells with other sets."""
    met = rows.where("cells IS NOT NULL").select("name", F.explode("cells").alias("cell"))
    shared = met.groupBy("cell").agg(F.min("name").alias("first"), F.max("name").alias("last"), F.count("*").alias("n")).where("first <> last").select("cell", "n")
    held = met.join(shared, "cell").distinct()
    size = rows.where("cells IS NOT NULL").groupBy("name").agg(F.max("n_shingles").alias("size"))
    need = F.ceil(F.ceil(F.col("size") * near / 100) / SPARE)
    own = Window.partitionBy("name")
    ranked = held.withColumns({"place": F.row_number().over(own.orderBy(F.desc("n"), "cell")), "all": F.count("*").over(own)}).join(size, "name")
    kept = materialize(ranked.where((F.col("all") >= need) & (F.col("place") >= need)).select("name", "cell"))
    first = kept.groupBy("cell").agg(F.min("name").alias("first"))
    found = components(kept.join(first, "cell").where("name <> first").select(F.col("name").alias("a"), F.col("first").alias("b")).distinct())
    discard(kept)
    return found


class Sets:
    """Sets of a task in one array."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        values, self.grams = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(values), bool)

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The grams of rows, and for each the place of its row in rows."""
        size = self.sizes[rows]
        owner = np.repeat(np.arange(len(rows)), size)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.starts[rows], size)
        return self.grams[at], owner

    def common(self, row: int, grams: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """How many grams the row shares with each of n rows."""
        own = self.grams[self.starts[row] : self.ends[row]]
        self.mark[own] = True
        both = np.bincount(owner[self.mark[grams]], minlength=n)
        self.mark[own] = False
        return both

    def distance(self, row: int, grams: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        both = self.common(row, grams, owner, len(sizes))
        return 1 - both / (sizes + self.sizes[row] - both)


class Forest:
    def __init__(self, n: int) -> None:
        self.parent = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def link(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.links.append((a, b))


def voronoi(distances: np.ndarray, eps: float, far: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) pairs: every row in its home and in the cells where a partner may live. The rest is cell -1."""
    home = distances.argmin(1)
    least = distances[np.arange(len(home)), home]
    slack = 1e-9
    reach = (distances <= far + eps + slack) & (distances <= np.where(least <= far, least + 2 * eps, 2)[:, None] + slack)
    reach[np.arange(len(home)), home] |= least <= far
    row, cell = np.nonzero(reach)
    rest = np.flatnonzero(least > far)
    return np.concatenate([row, rest]), np.concatenate([cell, np.full(len(rest), -1)])


def divide(sets: Sets, rows: np.ndarray, forest: Forest, near: int, pivots: int) -> np.ndarray:
    """Distances of rows to pivots among them, each farthest from those before it; sets near enough to one are linked to it."""
    grams, owner = sets.of(rows)
    sizes = sets.sizes[rows]
    nearest, found, i = np.full(len(rows), 2.0), [], 0
    for _ in range(max(2, min(pivots, len(rows) // LEAF))):
        both = sets.common(int(rows[i]), grams, owner, len(rows))
        union = sizes + sizes[i] - both
        for j in np.flatnonzero(100 * both >= near * union).tolist():
            if j != i:
                forest.link(int(rows[i]), int(rows[j]))
        found.append(1 - both / union)
        nearest = np.minimum(nearest, found[-1])
        i = int(nearest.argmax())
    return np.stack(found, 1)


def compare(sets: Sets, rows: np.ndarray, forest: Forest, near: int) -> None:
    """Link rows by comparing all with all, but for those that the largest number of rows hangs together with already."""
    roots = np.array([forest.root(int(x)) for x in rows])
    values, at, times = np.unique(roots, return_inverse=True, return_counts=True)
    open_ = np.flatnonzero(at != times.argmax())
    if not len(open_):
        return
    grams, owner = sets.of(rows)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    sizes = sets.sizes[rows]
    for i in open_.tolist():
        own = sets.grams[sets.starts[rows[i]] : sets.ends[rows[i]]]
        begins, ends = np.searchsorted(grams, own, "left"), np.searchsorted(grams, own, "right")
        lists = [owner[a:b] for a, b in zip(begins.tolist(), ends.tolist()) if b - a > 1]
        if not lists:
            continue
        both = np.bincount(np.concatenate(lists), minlength=len(rows))
        for j in np.flatnonzero(100 * both >= near * (sizes + sizes[i] - both)).tolist():
            if j != i:
                forest.link(int(rows[i]), int(rows[j]))


def join_region(sets: Sets, rows: np.ndarray, forest: Forest, near: int = NEAR, pivots: int = PIVOTS, leaf: int = LEAF) -> int:
    """Link all pairs of rows, directly or through others; the number of divisions that lay one within the other."""
    eps = 1 - near / 100
    todo, deepest = [(rows, 0)], 0
    while todo:
        rows, level = todo.pop()
        if len({forest.root(int(x)) for x in rows}) < 2:  # they hang together: no link among them tells more
            continue
        if len(rows) <= leaf:
            compare(sets, rows, forest, near)
            continue
        row, cell = voronoi(divide(sets, rows, forest, near, pivots), eps, FAR)
        parts = [rows[row[cell == c]] for c in np.unique(cell)]
        deepest = max(deepest, level + 1)
        # sets that are near many pivots stand in many cells: a division must leave clearly fewer pairs than there were
        if sum(len(part) ** 2 for part in parts) <= 0.7 * len(rows) ** 2:
            todo += [(part, level + 1) for part in parts]
        else:
            compare(sets, rows, forest, near)
    return deepest


def with_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """name, region and grams (binary) of the wanted sets; repeated rows may give one more than once. wanted: doc_id, name, region.

    Texts are compressed for the join, which halves what it moves.
    """

    def squeeze(it: Iterator[pa.RecordBatch]):
        zip_ = zstandard.ZstdCompressor(level=1).compress
        seen: set = set()
        for batch in it:
            if len(seen) > 1_000_000:
                seen = set()
            rows = []
            for doc_id, t in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                data = t.encode("utf-8", "replace")
                row = (doc_id, xxhash.xxh3_64_intdigest(data))
                if row not in seen:  # repeated rows cross once per task
                    seen.add(row)
                    rows.append((doc_id, zip_(data)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ([], []), (pa.int64(), pa.binary()))], names=["id", "data"])

    def grams(it: Iterator[pa.RecordBatch]):
        unzip = zstandard.ZstdDecompressor().decompress
        for batch in it:
            got = []
            for data, name, region in zip(*(batch.column(c).to_pylist() for c in ("data", "name", "region"))):
                own = gram_set(unzip(data).decode(), n)
                if set_name(own) == name:
                    got.append((name, region, own.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got) if got else ([], [], []), (pa.int64(), pa.int64(), pa.binary()))], names=["name", "region", "grams"])

    packed = map_arrow(docs, squeeze, "id long, data binary")
    same = packed.join(wanted, F.col("id").eqNullSafe(F.col("doc_id"))).select("data", "name", "region")
    return map_arrow(same, grams, "name long, region long, grams binary")


def arrays(grams) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in grams]


def split(sets: DataFrame, sizes: DataFrame, near: int, pivots: int) -> DataFrame:
    """Divide the regions of sizes (region, n) by pivots; name, region, grams with new region numbers."""
    big = sets.join(sizes, "region")
    slices = F.ceil(F.col("n") / CAPACITY).cast("int")
    order = F.xxhash64("name", F.lit(5))
    cut = F.lit(2.0**64) / F.col("n") * (2 * pivots) - 2.0**63
    near_pivots = big.where(order < cut.cast("long")).groupBy("region", "n").agg(F.slice(F.sort_array(F.collect_list(F.struct(order.alias("o"), "grams"))), 1, pivots).alias("p"))
    pivot = near_pivots.withColumn("to", F.explode(F.sequence(F.lit(0), slices - 1))).select(F.col("region").alias("of"), "to", F.col("p.grams").alias("p"))
    dealt = big.withColumn("slice", F.pmod(F.xxhash64("name", F.lit(7)), slices).cast("int")).select("name", "region", "slice", "grams")

    def deal(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame({"name": [], "region": [], "grams": []})
        a = a.drop_duplicates("name")
        own, middle = arrays(a["grams"]), arrays(b["p"].iloc[0]) if len(b) else []
        if not middle:
            return a[["name", "region", "grams"]]
        all_ = Sets(own + middle)
        rows = np.arange(len(own))
        grams, owner = all_.of(rows)
        distances = np.stack([all_.distance(len(own) + i, grams, owner, all_.sizes[rows]) for i in range(len(middle))], 1)
        row, cell = voronoi(distances, 1 - near / 100, FAR)
        region = int(a["region"].iloc[0])
        number = {int(c): xxhash.xxh3_64_intdigest(f"{region}/{c}".encode()) >> 1 for c in np.unique(cell)}
        return pd.DataFrame({"name": a["name"].to_numpy()[row], "region": [number[int(c)] for c in cell], "grams": a["grams"].to_numpy()[row]})

    return dealt.groupBy("region", "slice").cogroup(pivot.groupBy("of", "to")).applyInPandas(deal, "name long, region long, grams binary")


def divided(sets: DataFrame, sizes: DataFrame, near: int, pivots: int) -> DataFrame:
    """The regions of sizes (region, n) whose cells together have less to compare than the region, judged by a sample."""
    big = sets.join(sizes, "region")
    order = F.xxhash64("name", F.lit(5))
    cut = F.lit(2.0**64) / F.col("n") * (2 * pivots + TOLD) - 2.0**63
    sample = big.where(order.cast("double") < cut).select("region", "name", order.alias("o"), "grams")

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("name").sort_values("o")
        all_ = Sets(arrays(group["grams"]))
        rows = np.arange(min(pivots, len(group) - 1), len(group))
        grams, owner = all_.of(rows)
        distances = np.stack([all_.distance(i, grams, owner, all_.sizes[rows]) for i in range(max(1, rows[0]))], 1)
        _, cell = voronoi(distances, 1 - near / 100, FAR)
        share = np.unique(cell, return_counts=True)[1] / len(rows)
        return group[["region"]].head(1) if (share**2).sum() <= 0.9 else group[["region"]].head(0)

    return sample.groupBy("region").applyInPandas(judge, "region long")


def paired(sets: DataFrame, capacity: int) -> DataFrame:
    """name, region, grams with the regions of more than capacity sets dealt to blocks, a region for every two of them."""
    n = sets.groupBy("region").agg(F.count("*").alias("n")).where(F.col("n") > capacity)
    blocks = F.ceil(F.col("n") / max(1, capacity // 3)).cast("int")
    own = F.pmod(F.xxhash64("name", F.lit(13)), F.col("blocks")).cast("int")
    dealt = sets.join(n.select("region", blocks.alias("blocks")), "region").withColumn("own", own)
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("own <> other")
    number = F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other"))
    return sets.join(n, "region", "left_anti").select("name", "region", "grams").unionByName(met.select("name", number.alias("region"), "grams"))


def bounded(sets: DataFrame, near: int, pivots: int, capacity: int, depth: int) -> DataFrame:
    """sets in regions of about capacity at most, such that all linked sets meet in a region."""
    stuck: set[int] = set()
    for _ in range(depth):
        sizes = sets.groupBy("region").agg(F.count("*").alias("n"))
        # rows of regions that are too large for a task: few, and only their numbers
        big = [r for r in sizes.where(F.col("n") > capacity).collect() if r["region"] not in stuck]
        if not big:
            break
        table = lambda rows: sets.sparkSession.createDataFrame([(r["region"], r["n"]) for r in rows], "region long, n long")
        good = {r["region"] for r in divided(sets, table(big), near, pivots).collect()}
        stuck |= {r["region"] for r in big} - good
        if not good:
            break
        now = table([r for r in big if r["region"] in good])
        parts = materialize(split(sets, now, near, pivots))
        rest = sets.join(now, "region", "left_anti")
        sets = parts.unionByName(rest.select("name", "region", "grams"))
    return paired(sets, capacity)


def links(sets: DataFrame, near: int = NEAR, pivots: int = PIVOTS, capacity: int = CAPACITY, depth: int = 6) -> DataFrame:
    """a, b: links between sets that join all that is linked. sets: name, region, grams."""

    def join(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("name")
        names = group["name"].to_numpy()
        forest = Forest(len(names))
        if len(names) > 1:
            join_region(Sets(arrays(group["grams"])), np.arange(len(names)), forest, near, pivots)
        return pd.DataFrame([(names[a], names[b]) for a, b in forest.links], columns=["a", "b"], dtype="int64")

    return bounded(sets, near, pivots, capacity, depth).groupBy("region").applyInPandas(join, "a long, b long")


def near_copies(docs: DataFrame, n: int = N, near: int = NEAR) -> DataFrame:
    """doc_id, n_shingles, component_id of every document. docs: doc_id, text."""
    session_of(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wide = materialize(cells(docs, n, near))
    rows = materialize(wide.drop("cells"))
    classes = rows.where("name IS NOT NULL").groupBy("name").agg(F.min("doc_id").alias("least"))
    together = regions(wide, near).select(F.col("node").alias("name"), F.col("component").alias("region"))
    wanted = classes.join(together, "name").select(F.col("least").alias("doc_id"), "name", "region")
    discard(wide)
    sets = materialize(with_sets(docs, wanted, n))
    linked = components(links(sets, near)).select(F.col("node").alias("name"), "component")
    discard(sets)
    group = classes.join(linked, "name", "left").withColumn("group", F.coalesce("component", "name"))
    least = group.groupBy("group").agg(F.min("least").alias("component_id"))
    named = group.join(least, "group").select("name", "component_id")
    full = rows.where("name IS NOT NULL").select("doc_id", "n_shingles", "name").join(named, "name").select("doc_id", "n_shingles", "component_id")
    empty = rows.where("name IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(empty)


def op5_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_copies(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
u AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
five AS (
  SELECT doc_id, n, i, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS g
  FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, g FROM five WHERE i <= greatest(1, n - 4)),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y FROM met JOIN size AS p ON p.doc_id = x JOIN size AS q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
way AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (
  SELECT doc_id, doc_id AS label FROM documents
  UNION
  SELECT way.y, reach.label FROM reach JOIN way ON way.x = reach.doc_id WHERE reach.label < way.y)
SELECT reach.doc_id, coalesce(any_value(size.n), 0) AS n_shingles, min(label) AS component_id
FROM reach LEFT JOIN size ON size.doc_id = reach.doc_id GROUP BY reach.doc_id
"""
