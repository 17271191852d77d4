"""Fuzzy search for short license notices.

A notice of n characters may hold k edits. Cut into k + 1 pieces, at least one piece is left whole
(pigeonhole), so exact searches for the pieces find every place where the notice can stand. The
bounded-error matching of the regex library then verifies each place and counts its edits.

Texts are compared as words: A-Z is lower-cased, words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+, and one
space joins them. Cases: a null or empty text has no words, no spans and score 0; rows are kept as they
are, null and repeated ids included; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each, map_arrow, texts

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: Bytes of a word keep their place, A-Z are lowered and all else is a space. Bytes over 0x7F belong to words.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


@dataclass(frozen=True)
class Notice:
    """words: the notice in normal form; exact: words after it that may hold no edit (versions)."""

    label: str
    words: str
    exact: str = ""
    edits: int = 2
    base: bool = False

    @property
    def phrase(self) -> str:
        return f"{self.words} {self.exact}".strip()

    def seeds(self) -> list[tuple[int, str]]:
        """The edits + 1 pieces with their offsets."""
        cuts = [round(i * len(self.words) / (self.edits + 1)) for i in range(self.edits + 2)]
        return [(a, self.words[a:b]) for a, b in zip(cuts, cuts[1:])]

    def pattern(self):
        tail = f" {regex.escape(self.exact)}" if self.exact else ""
        return regex.compile(f"(?b)(?<![^ ])(?:{regex.escape(self.words)}){{e<={self.edits}}}{tail}(?![^ ])")


NOTICES = (
    Notice("mit", "under the mit license", base=True),
    Notice("apache-2", "apache license version", "2", base=True),
    Notice("cc-by-nc", "cc by nc", edits=0, base=True),
    Notice("gpl-3", "gnu general public license version", "3", edits=3),
    Notice("gpl-2", "gnu general public license version", "2", edits=3),
    Notice("lgpl", "gnu lesser general public license", edits=3),
    Notice("agpl-3", "gnu affero general public license version", "3", edits=3),
    Notice("mpl-2", "mozilla public license version", "2", edits=3),
    Notice("bsd", "redistribution and use in source and binary forms", edits=4),
    Notice("cc-by-sa", "cc by sa", edits=0),
    Notice("isc", "under the isc license", edits=1),
    Notice("public-domain", "released into the public domain", edits=3),
)

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
    " score double, spans array<struct<label:string,start:int,end:int,edits:int,exact:boolean>>"
)
ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    + [("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32()), ("exact", pa.bool_())])))]
)


def normal(text: str) -> tuple[str, int]:
    """The words with a space around each, and their number."""
    words = text.encode("utf-8", "replace").translate(NORMAL).split(b" ")
    words = [w for w in words if w]
    return f" {b' '.join(words).decode()} ", len(words)


@lru_cache(maxsize=8)
def prepared(notices: tuple[Notice, ...]):
    by_seed: dict[str, list[tuple[int, int]]] = {}
    for i, n in enumerate(notices):
        for offset, seed in n.seeds():
            by_seed.setdefault(seed, []).append((i, offset))
    return [(n, n.pattern()) for n in notices], by_seed


def places(line: str, phrase: str) -> list[int]:
    """Every offset in line where the phrase's words stand consecutively."""
    found, at, needle = [], -1, f" {phrase} "
    while (at := line.find(needle, at + 1)) >= 0:
        found.append(at + 1)
    return found


def fuzzy(line: str, notices: tuple[Notice, ...]) -> list[tuple[str, int, int, int]]:
    """(label, start, end, edits) of each verified notice in a normal line, in order."""
    patterns, by_seed = prepared(notices)
    windows: dict[int, set[int]] = {}
    for seed, uses in by_seed.items():
        at = line.find(seed)
        while at >= 0:
            for i, offset in uses:
                windows.setdefault(i, set()).add(at - offset)
            at = line.find(seed, at + 1)
    found = set()
    for i, starts in windows.items():
        n, pattern = patterns[i]
        for start in starts:
            end = start + len(n.phrase) + n.edits + 1
            if m := pattern.search(line, max(0, start - n.edits), min(len(line), end)):
                # pos and endpos hide what lies beyond them: the ends of a span must be those of words
                if (m.start() == 0 or line[m.start() - 1] == " ") and (m.end() == len(line) or line[m.end()] == " "):
                    found.add((n.label, m.start(), m.end(), sum(m.fuzzy_counts)))
    kept: list[tuple[str, int, int, int]] = []
    for x in sorted(found, key=lambda x: (x[0], x[3], x[1], x[2])):
        if not any(x[0] == y[0] and x[1] < y[2] and y[1] < x[2] for y in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: (x[1], x[2], x[0]))


def scan_text(text: str, notices: tuple[Notice, ...] = NOTICES) -> tuple:
    """The row of one text, without its id."""
    line, n_words = normal(text)
    hits = [(p, n) for n in notices if n.base for p in places(line, n.phrase)]
    found = fuzzy(line, notices)
    spans = []
    if hits or found:
        ends = [(m.start(), m.end()) for m in WORD.finditer(text.translate(LOWER))]
        word = lambda at: line.count(" ", 0, at) - 1
        starts = [word(p) for p, _ in hits]
        for label, a, b, edits in found:
            a += line[a] == " "
            b -= line[b - 1] == " "
            spans.append({"label": label, "start": ends[word(a)][0], "end": ends[word(b)][1], "edits": edits, "exact": edits == 0})
    base = sorted({n.label for _, n in hits})
    labels = sorted({*base, *(x[0] for x in found)})
    sure = {n.label: len(n.phrase) for n in notices}
    score = max([1.0 if hits else 0.0, *(1 - x[3] / sure[x[0]] for x in found)])
    first, last = (min(starts), max(starts)) if hits else (None, None)
    return n_words, len(hits), first, last, ",".join(base), ",".join(labels), score, spans


LOWER = {c: c + 32 for c in range(65, 91)}


def license_scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """One row per document with its notices; spans hold character offsets in the whole text."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(i, *scan_text(t, notices)) for i, t in zip(batch.column("doc_id").to_pylist(), texts(batch))]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)

    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(df, lambda it: each(it, one), SCHEMA)


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return license_scan(documents(spark, sf_dir)).withColumn("n_spans", F.size("spans")).drop("spans")
