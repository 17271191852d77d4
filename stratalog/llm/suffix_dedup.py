"""Repeated passages by a distributed merge sort of suffixes that never compares a known prefix again.

A byte is removed when a string of `length` bytes that covers it also starts somewhere else. Suffixes need not
start everywhere: in every stretch of `window` places the one with the smallest hash of its eight bytes is an
anchor (the first, in ties), so two equal strings have their first anchors at the same offset t < window.
The strings whose first anchor is a form a run; they hold the core, the length - window + 1 bytes from a on. So

1. cores are counted over the corpus (by a hash, which can only keep too many; tasks count first), and anchors whose
   core occurs once are dropped. The few very common cores, at most SHARE by their definition, are told to all tasks;
   the others are looked up by a join, in which no key is hot;
2. every task sorts the suffixes at its remaining anchors into runs, and exchanges them front-coded: for each
   suffix the length it shares with the one before, and the rest. Equal suffixes in equal surroundings are one
   entry with a list of places. The hash of the core gives the range that a suffix goes to, so equal cores meet
   and ranges are even;
3. a range merges its runs with a loser tree. Each loser keeps the length it shares with the winner it lost to:
   of two candidates the one that shares more with the last winner is smaller, and only at equal lengths bytes
   are compared, from there on. The merge also yields the length each suffix shares with the one before;
4. suffixes with one core stand together in the merged order. Two of them that share r bytes from the anchor on and
   l bytes before it hold equal strings at the offsets length - r to l, which settles every offset of every run.

A core that occurs more than GROUP times would be a group without bound. Its strings are counted one by one
instead, each by its hash: tasks count their own first, so a string that a third of all documents share crosses
once per task; those that are very common are told, the others joined.

Several lengths can be asked for at once; the smallest one sets window and core, and one merge answers for all.
Texts that occur more than once as a whole are sorted once, and removed whole if they have `length` bytes.

Cases: a null text is empty; texts shorter than `length` lose nothing; repeated rows and null ids are kept (they are
copies of each other); an empty table gives no rows; a very long text gives as many suffixes as its length asks
for, and a run is closed within it when full. A hash of 64 bits names a text. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, documents, map_arrow, materialize, session_of, texts

#: The query removes what LENGTH bytes repeat, and reports beside it what PASSAGE bytes (some 35 words) repeat.
LENGTH, PASSAGE = 400, 200
#: Bytes of suffixes that a task holds before it closes a run; suffixes of a range, about.
RUN_BYTES, RANGE = 20 << 20, 20_000
#: A core is told to all tasks if it is more than a SHARE-th of all and occurs more than FLOOR times: SHARE cores at most.
SHARE, FLOOR = 10_000, 64
#: Occurrences of a core that one task takes.
GROUP = 50_000
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
PLACE_BITS = 28
PLACE = np.uint64((1 << PLACE_BITS) - 1)
NOTHING = hashlib.sha256(b"").hexdigest()


def window_of(length: int) -> int:
    return length // 2


def runs(data: bytes, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """anchor, first and last start of each run of strings with one first anchor."""
    n = len(data) - length + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 3
    size = n + window - 1
    h = np.ndarray((size,), np.uint64, data, 0, (1,)) * M1
    h ^= h >> np.uint64(31)
    h *= M2
    h = (h & ~PLACE) | np.arange(size, dtype=np.uint64)
    blocks = -(-size // window)
    padded = np.full(blocks * window, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:size] = h
    grid = padded.reshape(blocks, window)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    first = (np.minimum(behind[:n], ahead[window - 1 : window - 1 + n]) & PLACE).astype(np.int64)
    start = np.flatnonzero(np.diff(first, prepend=-1))
    return first[start], start, np.append(start[1:], n) - 1


def core_hashes(data: bytes, anchors: list[int], core: int) -> list[int]:
    digest = xxhash.xxh3_64_intdigest
    return [digest(data[a : a + core]) - (1 << 63) for a in anchors]


def text_name(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data, 1) - (1 << 63)


def shared(a: bytes, b: bytes, at: int = 0) -> int:
    """The length of the common prefix, of which at bytes are known."""
    n = min(len(a), len(b))
    step = 32
    while at < n:
        end = min(n, at + step)
        x, y = a[at:end], b[at:end]
        if x != y:
            differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
            return at + (8 * (end - at) - differ.bit_length()) // 8
        at = end
        step *= 2
    return n


HEAD = struct.Struct("<HHHHI")  # known prefix, rest, bytes before, least offset, bytes of places


def write_run(units: list[tuple]) -> bytes:
    """Front-coded, in order. A unit: suffix, the bytes before the anchor (as many as the greatest offset), least offset,
    places (text and anchor of each, as 64-bit integers)."""
    parts, last = [], b""
    for suffix, before, least, places in units:
        known = shared(last, suffix)
        parts += (HEAD.pack(known, len(suffix) - known, len(before), least, len(places)), suffix[known:], before, places)
        last = suffix
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def read_run(run: bytes) -> Iterator[tuple[int, tuple]]:
    """(length shared with the unit before, unit)."""
    data = zstandard.ZstdDecompressor().decompress(run)
    at, last = 0, b""
    while at < len(data):
        known, rest, size, least, more = HEAD.unpack_from(data, at)
        at += HEAD.size
        middle = at + rest
        last = last[:known] + data[at:middle]
        at = middle + size + more
        yield known, (last, data[middle : middle + size], least, data[middle + size : at])


def merge(streams: list[Iterator[tuple[int, tuple]]]) -> Iterator[tuple[int, tuple]]:
    """One sorted stream of (length shared with the unit before, unit) by a loser tree."""
    k = 1
    while k < len(streams):
        k *= 2
    end = (-1, None)
    # what stands at the head of each stream: the length it shares with the last winner, and the unit
    heads = [next(s, end) for s in streams] + [end] * (k - len(streams))
    heads = [(0, u) if u is not None else end for _, u in heads]
    tree = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's length becomes what it shares with the winner."""
        (x, u), (y, v) = heads[a], heads[b]
        if v is None:
            return a, b
        if u is None:
            return b, a
        if x > y:
            return a, b
        if y > x:
            return b, a
        common = shared(u[0], v[0], x)
        if u[0][common : common + 1] <= v[0][common : common + 1]:
            heads[b] = (common, v)
            return a, b
        heads[a] = (common, u)
        return b, a

    winners = list(range(k))
    node = k
    while len(winners) > 1:
        node //= 2
        up = []
        for i in range(0, len(winners), 2):
            w, tree[node + i // 2] = play(winners[i], winners[i + 1])
            up.append(w)
        winners = up
    best = winners[0]
    while heads[best][1] is not None:
        yield heads[best]
        heads[best] = next(streams[best], end) if best < len(streams) else end
        node = (best + k) // 2
        while node:
            best, tree[node] = play(best, tree[node])
            node //= 2


def equal_offsets(group: list[tuple], known: list[int], lengths: tuple[int, ...]) -> Iterator[tuple[bytes, list[list[tuple[int, int]]]]]:
    """(places, spans of offsets by length) of the strings that also start elsewhere.

    group: units with one core in order; known: the length each shares with the one before.
    """
    first: dict[tuple[bytes, bytes], int] = {}
    kinds: list[tuple] = []
    places: list[list[bytes]] = []
    right: list[int] = []  # what a kind's suffix shares with the kind's before
    least_known = max(lengths)
    for unit, k in zip(group, known):
        least_known = min(least_known, k)
        key = unit[:2]
        at = first.get(key)
        if at is None:
            first[key] = len(kinds)
            kinds.append(unit)
            places.append([unit[3]])
            right.append(least_known)
            least_known = max(lengths)
        else:
            places[at].append(unit[3])
            # units of a kind need not be neighbours, but their suffixes are equal
    all_places = [b"".join(x) for x in places]
    # the offsets of a kind's strings: none reaches beyond the end of the text
    low = [[max(u[2], n - len(u[0])) for u in kinds] for n in lengths]
    high = [len(u[1]) for u in kinds]
    single = [len(x) == 16 for x in all_places]
    for i, x in enumerate(all_places):
        if not single[i]:
            yield x, [[(lo[i], high[i])] if lo[i] <= high[i] else [] for lo in low]
    if len(kinds) == 1 or not any(single):
        return
    if len(kinds) <= 40:
        numbers = [int.from_bytes(u[1], "big") for u in kinds]
        for i in range(len(kinds)):
            if not single[i]:
                continue
            spans: list[list[tuple[int, int]]] = [[] for _ in lengths]
            for j in range(len(kinds)):
                if j == i:
                    continue
                a, b = min(i, j), max(i, j)
                r = min(right[a + 1 : b + 1])
                differ = numbers[i] ^ numbers[j]
                before = min(high[i], high[j])
                left = min(before, ((differ & -differ).bit_length() - 1) // 8) if differ else before
                for n, lo, own in zip(lengths, low, spans):
                    x, y = max(lo[i], n - r), min(high[i], left)
                    if x <= y:
                        own.append((x, y))
            if any(spans):
                yield all_places[i], [joined(own) for own in spans]
        return
    # many kinds: at each offset t, equal strings are equal in length - t bytes from the anchor and t bytes before it
    back = [u[1][::-1] for u in kinds]
    order = sorted(range(len(kinds)), key=back.__getitem__)
    beside = np.array([0] + [shared(back[a], back[b]) for a, b in zip(order, order[1:])])
    ahead = np.array(right)
    ahead[0] = 0
    size = np.array(high)
    rest = np.array([len(u[0]) for u in kinds])
    hits = []
    rank = np.empty(len(kinds), np.int64)
    for n, lo in zip(lengths, low):
        hit = np.zeros((len(kinds), max(high) + 1), bool)
        for t in range(min(lo), max(high) + 1):
            rank[order] = np.cumsum(beside < t)
            both = np.cumsum(ahead < n - t) * (len(kinds) + 1) + rank
            whole = (size >= t) & (rest >= n - t)
            _, at, times = np.unique(both[whole], return_inverse=True, return_counts=True)
            hit[np.flatnonzero(whole)[times[at] > 1], t] = True
        hits.append(hit)
    for i in np.flatnonzero(single).tolist():
        spans = []
        for hit, lo in zip(hits, low):
            t = np.flatnonzero(hit[i, lo[i] : high[i] + 1]) + lo[i]
            spans.append([(int(part[0]), int(part[-1])) for part in np.split(t, np.flatnonzero(np.diff(t) > 1) + 1)] if len(t) else [])
        if any(spans):
            yield all_places[i], spans


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (both ends within) that touch are one."""
    out: list[tuple[int, int]] = []
    for x, y in sorted(spans):
        if out and x <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def repeats(merged: Iterator[tuple[int, tuple]], lengths: tuple[int, ...]) -> Iterator[tuple[int, int, int, int]]:
    """(text, number of the length, from, to): bytes of texts that a repeated string covers."""
    core = min(lengths) - window_of(min(lengths)) + 1
    group: list[tuple] = []
    known: list[int] = []

    def settle():
        if len(group) > 1 or len(group[0][3]) > 16:
            for places, spans in equal_offsets(group, known, lengths):
                at = struct.unpack(f"<{len(places) // 8}q", places)
                for i, (n, own) in enumerate(zip(lengths, spans)):
                    for x, y in own:
                        for text, anchor in zip(at[0::2], at[1::2]):
                            yield text, i, anchor - y, anchor - x + n

    for k, unit in merged:
        if k < core and group:
            yield from settle()
            group, known = [], []
        group.append(unit)
        known.append(k)
    if group:
        yield from settle()


def named(docs: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """doc_id, name, n_bytes, sha256 of every document, the hashes of its cores, and those of them that it has twice."""
    kind = pa.schema([("doc_id", pa.int64()), ("name", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string()), ("cores", pa.list_(pa.int64())), ("own", pa.list_(pa.int64()))])
    least, window = min(lengths), window_of(min(lengths))

    def one(it: Iterator[pa.RecordBatch]):
        for batch in it:
            rows = []
            for doc_id, t in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                data = t.encode("utf-8", "replace")
                cores, times = np.unique(np.array(core_hashes(data, runs(data, least, window)[0].tolist(), least - window + 1), np.int64), return_counts=True)
                rows.append((doc_id, text_name(data), len(data), hashlib.sha256(data).hexdigest(), cores, cores[times > 1]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

    return map_arrow(docs, one, "doc_id long, name long, n_bytes long, sha256 string, cores array<long>, own array<long>")


def counted(keys: DataFrame, total: int) -> tuple[DataFrame, dict[int, int], int]:
    """(key and n of the keys that occur more than once, the very common ones, the largest n). keys: key, n."""
    often = materialize(keys.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"))
    told = {r["key"]: r["n"] for r in often.where(F.col("n") > max(FLOOR, total // SHARE)).collect()}
    most = often.agg(F.max("n")).first()[0] or 0
    return often, told, most


def sorted_array(keys) -> np.ndarray:
    return np.array(sorted(keys), np.int64)


def among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which values are in the sorted keys."""
    if not len(keys):
        return np.zeros(len(values), bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def without_told(once: DataFrame, told: dict[int, int]) -> DataFrame:
    """name, cores that are not told, and whether any is told."""
    known = sorted_array(told)

    def one(it: Iterator[pa.RecordBatch]):
        for batch in it:
            lists = batch.column("cores")
            values = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int64)
            hit = among(values, known)
            before = np.append(0, np.cumsum(hit))
            some = before[ends[1:]] > before[ends[:-1]]
            left = ends - before[ends]
            cores = pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(values[~hit], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("name"), cores, pa.array(some)], names=["name", "cores", "some"])

    return map_arrow(once, one, "name long, cores array<long>, some boolean")


def repeated_cores(once: DataFrame, often: DataFrame, told: dict[int, int]) -> DataFrame:
    """name, cores to merge and cores to count string by string of the texts that have any that are repeated.

    The told cores are in no list: every task knows them.
    """
    rest = without_told(once, told)
    looked = rest.select("name", F.explode("cores").alias("key")).join(often, "key")
    some = rest.where("some").select(F.lit(None).cast("long").alias("key"), "name", F.lit(0).cast("long").alias("n"))
    small = F.collect_list(F.when(F.col("n") <= GROUP, F.col("key")))
    large = F.collect_list(F.when(F.col("n") > GROUP, F.col("key")))
    return looked.select("key", "name", "n").unionByName(some).groupBy("name").agg(small.alias("cores"), large.alias("heavy"))


def squeezed(docs: DataFrame) -> DataFrame:
    """doc_id, name and the compressed text of every document."""

    def one(it: Iterator[pa.RecordBatch]):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in it:
            data = [t.encode("utf-8", "replace") for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(text_name, data), pa.int64()), pa.array(map(squeeze, data), pa.binary())], names=["doc_id", "name", "data"])

    return map_arrow(docs, one, "doc_id long, name long, data binary")


def each_text(it: Iterator[pa.RecordBatch], *columns: str):
    """name, text and the named columns of each row of compressed texts."""
    unsqueeze = zstandard.ZstdDecompressor().decompress
    for batch in it:
        for name, packed, *more in zip(*(batch.column(c) for c in ("name", "data", *columns))):
            yield name.as_py(), unsqueeze(packed.as_py()), *(x.as_py() for x in more)


def sorted_runs(kept: DataFrame, ranges: int, lengths: tuple[int, ...], told: dict[int, int]) -> DataFrame:
    """range, run: the suffixes at anchors with repeated cores. kept: name, data, cores."""
    least, most, window = min(lengths), max(lengths), window_of(min(lengths))
    core_size = least - window + 1
    common = frozenset(k for k, n in told.items() if n <= GROUP)

    def one(it: Iterator[pa.RecordBatch]):
        held: dict[int, dict] = {}
        size = 0

        def close():
            rows = [(r, write_run(sorted((*k, struct.pack(f"<{len(v)}q", *v)) for k, v in units.items()))) for r, units in held.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary()))], names=["range", "run"])

        for name, data, cores in each_text(it, "cores"):
            wanted = set(cores)
            anchors, first, last = (x.tolist() for x in runs(data, least, window))
            for a, s, e, core in zip(anchors, first, last, core_hashes(data, anchors, core_size)):
                if core in wanted or core in common:
                    units = held.setdefault(core % ranges, {})
                    key = (data[a : a + most], data[s:a], a - e)
                    if key in units:
                        units[key] += (name, a)
                        size += 16
                    else:
                        units[key] = [name, a]
                        size += most + window
                    if size > RUN_BYTES:
                        yield close()
                        held, size = {}, 0
        if held:
            yield close()

    return map_arrow(kept, one, "range int, run binary")


def covered(sorted_: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """name, which (the number of the length), spans: per range and text the bytes that repeated strings cover."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for text, i, a, b in repeats(merge([read_run(r) for r in group["run"]]), lengths):
            found.setdefault((text, i), []).append((a, b - 1))
        return pd.DataFrame([(t, i, [x for s in joined(spans) for x in s]) for (t, i), spans in found.items()], columns=["name", "which", "spans"])

    return sorted_.groupBy("range").applyInPandas(one, "name long, which int, spans array<int>")


def heavy_strings(kept: DataFrame, lengths: tuple[int, ...], told: dict[int, int]):
    """(name, which, starts and hashes of the strings) of each text that has cores beyond GROUP, as a function of a task's rows."""
    least, window = min(lengths), window_of(min(lengths))
    common = frozenset(k for k, n in told.items() if n > GROUP)
    digest = xxhash.xxh3_64_intdigest

    def strings(it: Iterator[pa.RecordBatch]):
        for name, data, heavy in each_text(it, "heavy"):
            wanted = set(heavy)
            anchors, first, last = (x.tolist() for x in runs(data, least, window))
            own = [(s, e) for s, e, core in zip(first, last, core_hashes(data, anchors, least - window + 1)) if core in wanted or core in common]
            for i, n in enumerate(lengths):
                starts = [x for s, e in own for x in range(s, min(e, len(data) - n) + 1)]
                if starts:
                    yield name, i, np.array(starts, np.int64), np.array([digest(data[x : x + n], i) - (1 << 63) for x in starts], np.int64)

    return strings


def heavy_spans(kept: DataFrame, lengths: tuple[int, ...], told: dict[int, int]) -> DataFrame:
    """name, which, spans for the cores beyond GROUP, whose strings are counted one by one. kept: name, data, heavy."""
    strings = heavy_strings(kept, lengths, told)

    def count(it: Iterator[pa.RecordBatch]):
        held, size = [], 0

        def sums():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])

        for *_, keys in strings(it):
            held.append(keys)
            size += len(keys)
            if size > 1_000_000:
                yield sums()
                held, size = [], 0
        if held:
            yield sums()

    keys = materialize(map_arrow(kept, count, "key long, n long"))
    often, common, _ = counted(keys, keys.agg(F.sum("n")).first()[0] or 0)
    known = sorted_array(common)

    def mark(it: Iterator[pa.RecordBatch]):
        for name, i, starts, keys in strings(it):
            hit = among(keys, known)
            rows = [(name, i, a, b, None) for a, b in joined([(x, x) for x in starts[hit].tolist()])]
            rows += [(name, i, x, x, k) for x, k in zip(starts[~hit].tolist(), keys[~hit].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["name", "which", "first", "last", "key"])

    marked = materialize(map_arrow(kept, mark, "name long, which int, first int, last int, key long"))
    hits = marked.where("key IS NULL").drop("key").unionByName(marked.join(often, "key").select("name", "which", "first", "last"))
    size = F.element_at(F.array(*[F.lit(n) for n in lengths]), F.col("which") + 1)
    return hits.groupBy("name", "which").agg(F.flatten(F.collect_list(F.array(F.col("first"), F.col("last") + size - 1))).alias("spans"))


def cut(kept: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """name, n_removed, n_spans, kept_sha256, kept of texts with spans, and the bytes covered by length.

    kept: name, data, spans array<struct<which, spans>>. The text kept loses the rest of a character that was cut into.
    """

    def one(it: Iterator[pa.RecordBatch]):
        unsqueeze = zstandard.ZstdDecompressor().decompress
        for batch in it:
            rows = []
            for name, packed, lists in zip(*(batch.column(c).to_pylist() for c in ("name", "data", "spans"))):
                data = unsqueeze(packed)
                spans = [joined([(x["spans"][i], x["spans"][i + 1]) for x in lists if x["which"] == j for i in range(0, len(x["spans"]), 2)]) for j in range(len(lengths))]
                at, parts = 0, []
                for a, b in spans[0]:
                    parts.append(data[at:a])
                    at = b + 1
                left = b"".join([*parts, data[at:]])
                sizes = [sum(b + 1 - a for a, b in own) for own in spans]
                rows.append((name, sizes[0], len(spans[0]), sizes, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string()))], names=["name", "n_removed", "n_spans", "sizes", "kept_sha256", "kept"])

    return map_arrow(kept, one, "name long, n_removed long, n_spans long, sizes array<long>, kept_sha256 string, kept string")


def suffix_dedup(docs: DataFrame, lengths: tuple[int, ...] = (LENGTH,), with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; with_text: also name and kept.

    The first length is the one that removes; covered_bytes has the bytes that each of the lengths covers.
    kept (the text that is left) is null where nothing is removed. docs: doc_id, text.
    """
    session_of(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wide = materialize(named(docs, lengths))
    rows = materialize(wide.drop("cores", "own"))
    reps = rows.groupBy(F.col("name").alias("rep")).agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    once = materialize(wide.join(reps, (F.col("name") == F.col("rep")) & F.col("doc_id").eqNullSafe(F.col("least"))).where(F.size("cores") > 0).select("name", "cores", "own").dropDuplicates(["name"]))
    discard(wide)
    total = once.agg(F.sum(F.size("cores"))).first()[0] or 0
    often, told, most = counted(once.select(F.explode(F.concat("cores", "own")).alias("key"), F.lit(1).alias("n")), total)
    cores = materialize(repeated_cores(once.select("name", "cores"), often, told))
    size = often.where(F.col("n") <= GROUP).agg(F.sum("n")).first()[0] or 0
    discard(once, often)
    wanted = cores.join(reps, F.col("name") == F.col("rep")).select("rep", "least", "cores", "heavy")
    texts_ = squeezed(docs)
    kept = materialize(texts_.join(wanted, (texts_["name"] == wanted["rep"]) & texts_["doc_id"].eqNullSafe(wanted["least"])).select("name", "data", "cores", "heavy").dropDuplicates(["name"]))
    discard(cores)
    spans = covered(sorted_runs(kept.select("name", "data", "cores"), max(1, -(-size // RANGE)), lengths, told), lengths)
    if most > GROUP:
        spans = spans.unionByName(heavy_spans(kept.select("name", "data", "heavy"), lengths, told))
    spans = spans.groupBy("name").agg(F.collect_list(F.struct("which", "spans")).alias("spans"))
    whole = lambda n: (F.col("copies") > 1) & (F.col("n_bytes") >= n)
    gone = cut(kept.select("name", "data").join(spans, "name"), lengths)
    gone = gone if with_text else gone.drop("kept")
    all_ = rows.join(reps, F.col("name") == F.col("rep")).drop("rep", "least").join(gone, "name", "left")
    columns = [
        F.col("doc_id"),
        F.col("n_bytes"),
        F.when(whole(lengths[0]), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole(lengths[0]), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole(lengths[0]), F.lit(NOTHING)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        F.array(*[F.when(whole(n), F.col("n_bytes")).otherwise(F.coalesce(F.get("sizes", F.lit(i)), F.lit(0))) for i, n in enumerate(lengths)]).alias("covered_bytes"),
    ]
    if with_text:
        columns += [F.col("name"), F.when(whole(lengths[0]), F.lit("")).otherwise(F.col("kept")).alias("kept")]
    return all_.select(*columns)


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for strings of LENGTH bytes, and n_passage: the bytes that strings of PASSAGE bytes cover which also start elsewhere."""
    found = suffix_dedup(documents(spark, sf_dir), (LENGTH, PASSAGE))
    return found.withColumn("n_passage", F.get("covered_bytes", F.lit(1))).drop("covered_bytes")


def _runs(n: int) -> str:
    """SQL for run<n>: the maximal runs of bytes from a to before b that repeated strings of n bytes cover."""
    return f"""
part{n} AS (SELECT r, 2048 * j AS base, substr(h, 4096 * j + 1, 4096 + {2 * n - 2}) AS p FROM (SELECT r, h, unnest(range(len(h) // 4096 + 1)) AS j FROM d)),
start{n} AS (SELECT r, base + i AS i, md5(substr(p, 2 * i + 1, {2 * n})) AS k FROM (SELECT r, base, p, unnest(range(len(p) // 2 - {n - 1})) AS i FROM part{n})),
again{n} AS (SELECT r, i FROM start{n} SEMI JOIN (SELECT k FROM start{n} GROUP BY k HAVING count(*) > 1) AS often USING (k)),
new{n} AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {n} THEN 0 ELSE 1 END AS first FROM again{n}),
number{n} AS (SELECT r, i, sum(first) OVER (PARTITION BY r ORDER BY i) AS run FROM new{n}),
run{n} AS (SELECT r, run, min(i) AS a, max(i) + {n} AS b FROM number{n} GROUP BY r, run)"""


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
{_runs(LENGTH)},
{_runs(PASSAGE)},
piece AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM run{LENGTH}),
cut AS (
  SELECT r, sum(b - a) AS n, count(*) AS spans,
         string_agg(substr(any_h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(any_h), 2 * max(b) + 1) AS kept
  FROM piece JOIN (SELECT r, h AS any_h FROM d) AS t USING (r) GROUP BY r),
passage AS (SELECT r, sum(b - a) AS n FROM run{PASSAGE} GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(cut.n, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256, CAST(coalesce(passage.n, 0) AS BIGINT) AS n_passage
FROM d LEFT JOIN cut USING (r) LEFT JOIN passage USING (r)
"""
