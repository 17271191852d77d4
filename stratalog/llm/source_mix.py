"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). A flow network has
one node per pattern and one per source: a pattern offers its words once at cost 0, again at cost 1 and
so on (convex: no second copy while a first is left), passes them to its own sources, and each source
takes up to its quota. The cheapest largest flow says how many words each pattern gives. Only this
network, one row per pattern and per source, is on the driver.

A pattern's documents then give that many words: all documents give the whole repeats, and the rest
comes from the documents whose seeded hash is under a threshold. The threshold is found by three
histograms of 4096 buckets, each within the bucket that the one before has singled out, so no task sees
more than its share of a hot pattern. The last bucket, in most cases one document, gives what is still open: each of its
documents the same part of its words, so ties of hashes are no matter and a target is met to the word, or
missed by less than one word for each document of that bucket.

Cases: a null text has size 0; a null source is a source of its own, last in order; an empty table gives
no rows; a document without sources gives nothing; repeated rows of one id share a decision, and so do null ids;
documents of size 0 are taken 0 words; a very long text is one document as any other, taken in part if it stands at the
threshold. Extra columns are ignored.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, session_of

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, REPEATS, SEED = (5, 2, 1), 1.5, 2, 17
BITS, LEVELS = 12, 3
#: Rows of a plan (one per pattern, some 200 bytes each) that are told to all tasks.
TOLD = 10_000


def source_order(name):
    return (name is None, name or "")


def targets(sizes: dict, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, total: int | None = None) -> dict:
    """The words each source should give: by weight, at most repeats times its size, excess shared anew."""
    names = sorted(sizes, key=source_order)
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, found = share * (sum(sizes.values()) if total is None else total), names, {}
    while open_:
        whole = sum(weigh[s] for s in open_)
        above = [s for s in open_ if left * weigh[s] / whole > repeats * sizes[s]]
        if not above:
            return found | {s: left * weigh[s] / whole for s in open_}
        found |= {s: float(repeats * sizes[s]) for s in above}
        left -= sum(repeats * sizes[s] for s in above)
        open_ = [s for s in open_ if s not in found]
    return found


class Network:
    """Cheapest largest flow by successive shortest paths."""

    def __init__(self) -> None:
        self.out: dict = {}
        self.arcs: list[list] = []

    def arc(self, a, b, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.arcs))
            self.arcs.append([y, r, c])
        return len(self.arcs) - 2

    def solve(self, start, end) -> None:
        while True:
            best, by, queue, queued = {start: 0}, {}, deque([start]), {start}
            while queue:
                x = queue.popleft()
                queued.discard(x)
                for e in self.out.get(x, ()):
                    y, room, cost = self.arcs[e]
                    if room > 0 and best[x] + cost < best.get(y, 1 << 60):
                        best[y], by[y] = best[x] + cost, e
                        if y not in queued:
                            queued.add(y)
                            queue.append(y)
            if end not in best:
                return
            path, x = [], end
            while x != start:
                path.append(by[x])
                x = self.arcs[by[x] ^ 1][0]
            flow = min(self.arcs[e][1] for e in path)
            for e in path:
                self.arcs[e][1] -= flow
                self.arcs[e ^ 1][1] += flow

    def flow(self, e: int) -> int:
        return self.arcs[e ^ 1][1]


def route(sizes: dict[tuple, int], quotas: dict, repeats: int = REPEATS) -> dict[tuple, dict]:
    """Words that each pattern gives to each of its sources. Patterns that share no source are solved apart."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for p in sizes:
        for s in p[1:]:
            root[find((s,))] = find((p[0],))
    parts: dict = {}
    for p in sorted(sizes, key=lambda p: [source_order(s) for s in p]):
        if p:
            parts.setdefault(find((p[0],)), []).append(p)
    given: dict[tuple, dict] = {p: {} for p in sizes}
    for patterns in parts.values():
        net, arcs = Network(), {}
        for p in patterns:
            for again in range(repeats):
                net.arc("start", ("p", p), sizes[p], again)
            for s in p:
                arcs[p, s] = net.arc(("p", p), ("s", s), repeats * sizes[p], 0)
        for s in sorted({s for p in patterns for s in p}, key=source_order):
            net.arc(("s", s), "end", int(quotas[s]), 0)
        net.solve("start", "end")
        for (p, s), e in arcs.items():
            given[p][s] = net.flow(e)
    return given


def with_plan(rows: DataFrame, plan: list[tuple], schema: str) -> DataFrame:
    """rows joined with one row per pattern by key; told to all tasks while it is small, else shuffled."""
    table = rows.sparkSession.createDataFrame(plan, schema)
    return rows.join(F.broadcast(table) if len(plan) <= TOLD else table, "key")


def thresholds(rows: DataFrame, rest: dict[str, int]) -> dict[str, tuple[int, int, int]]:
    """Per pattern the bucket of hashes at which the words run out: its first hash (smaller ones are taken), the words that
    it still has to give, and the words that it has.

    rows: key, h (0 to 2**63 - 1), size. rest: words to find, under the pattern's size.
    """
    at = {k: (0, r, 0) for k, r in rest.items()}
    for level in range(1, LEVELS + 1):
        shift = 63 - BITS * level
        b = F.shiftright("h", shift)
        now = with_plan(rows, [(k, lo >> (shift + BITS), r) for k, (lo, r, _) in at.items()], "key string, prefix long, rest long")
        inside = now.where(F.shiftright("h", shift + BITS) == F.col("prefix")).select("key", "rest", b.alias("b"), "size")
        counts = inside.groupBy("key", "rest", "b").agg(F.sum("size").alias("words"))
        # at most 4096 buckets a key stand in one array
        lists = counts.groupBy("key", "rest").agg(F.sort_array(F.collect_list(F.struct("b", "words"))).alias("all"))
        none = F.struct(F.col("rest").alias("open"), F.lit(None).cast("long").alias("stop"), F.lit(0).cast("long").alias("words"))
        step = F.aggregate(
            "all",
            none,
            lambda a, x: F.when(a["stop"].isNotNull(), a)
            .when(x["words"] > a["open"], F.struct(a["open"].alias("open"), x["b"].alias("stop"), x["words"].alias("words")))
            .otherwise(F.struct((a["open"] - x["words"]).alias("open"), a["stop"].alias("stop"), a["words"].alias("words"))),
        )
        # a bucket has more words than are open, so one of its parts has more than is open then
        at = {r["key"]: (r["got"]["stop"] << shift, r["got"]["open"], r["got"]["words"]) for r in lists.select("key", step.alias("got")).collect()}
    return at


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = SEED, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken of every document.

    docs: doc_id, size long, sources array<string>, and the columns of by, whose seeded hash chooses. source_size and target
    belong to the first source by order (its only one, where sources do not overlap). copies: how often the
    whole document is taken; taken: the words, those of a document taken in part included.
    """
    session_of(docs)
    h = F.xxhash64(F.lit(seed), *by).bitwiseAND((1 << 63) - 1)
    pattern = F.array_sort(F.array_distinct("sources"))
    rows = materialize(docs.select("doc_id", F.to_json(pattern).alias("key"), pattern.alias("pattern"), F.coalesce("size", F.lit(0)).cast("long").alias("size"), h.alias("h")))
    table = rows.groupBy("key", "pattern").agg(F.sum("size").alias("size")).collect()
    size_of = {r["key"]: int(r["size"]) for r in table}
    keys = {r["key"]: tuple(sorted(r["pattern"] or (), key=source_order)) for r in table}
    sources: dict = {}
    for key, p in keys.items():
        for s in p:
            sources[s] = sources.get(s, 0) + size_of[key]
    goal = targets(sources, weights, share, repeats, sum(size_of.values()))
    given = route({p: size_of[k] for k, p in keys.items()}, goal, repeats)
    words = {k: sum(given[p].values()) for k, p in keys.items()}
    whole = {k: words[k] // size_of[k] if size_of[k] else 0 for k in keys}
    rest = {k: words[k] - whole[k] * size_of[k] for k in keys}
    open_ = {k: r for k, r in rest.items() if r > 0}
    edge = thresholds(rows, open_) if open_ else {}
    first = {k: p[0] if p else None for k, p in keys.items()}
    all_ = with_plan(
        rows,
        [(k, sources.get(first[k], 0), float(goal.get(first[k], 0.0)), whole[k], *edge.get(k, (0, 0, 1))) for k in keys],
        "key string, source_size long, target double, whole int, bound long, open long, words long",
    )
    some = F.col("size") > 0
    copies = F.when(some, F.col("whole") + (F.col("h") < F.col("bound")).cast("int")).otherwise(0)
    last = (F.col("h") >= F.col("bound")) & (F.col("h") < F.col("bound") + (1 << (63 - BITS * LEVELS)))
    part = F.when(some & last, F.expr("CAST(size AS DECIMAL(19,0)) * open div words")).otherwise(F.lit(0).cast("long"))
    return all_.withColumn("copies", copies).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size") + part).cast("long").alias("taken"))


def sized(docs: DataFrame, doc_id: str = "doc_id", *more: str) -> DataFrame:
    """doc_id, size and sources of documents with one source each, and any columns more."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), size.alias("size"), F.array(F.col("source").cast("string")).alias("sources"), *more)


def op9_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix(sized(documents(spark, sf_dir)))
