import random
import re

import pytest
from pyspark.sql import functions as F

from stratalog.llm import license_scan as L

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    w, found = words(text), []
    for label, phrase in (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")):
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), len(found), min(found)[0] if found else None, max(found)[0] if found else None, ",".join(sorted({x for _, x in found}))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


CASES = [
    None,
    "",
    " \n--",
    "Licensed under the Apache License, Version 2.0.",
    "CC BY-NC, cc by nc CC-BY-NC-cc by nc é",
    "Under the MIT License; UNDER THE MIT LICENSE",
    "underthe mit license",
    "Released undr the MIT Licence.",
    "Apache Licens, Version 2.0 and Apache License, Version 3",
    "GNU Genral Public License, version 3",
    "the mit is licensed under water",
    "ünder the MIT license",
]


def test_base_columns_and_rows(spark):
    df = spark.createDataFrame([(i, t, 1.5) for i, t in enumerate(CASES)] + [(None, CASES[3], 0.0), (3, CASES[3], 0.0)], "doc_id long, text string, score double")
    got = L.license_scan(df).collect()
    assert len(got) == len(CASES) + 2
    for r in got:
        text = CASES[r["doc_id"]] if r["doc_id"] is not None else CASES[3]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
        for s in r["spans"]:
            assert 0 <= s["start"] < s["end"] <= len(text)
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert [labels[i] for i in (6, 7, 8, 9, 10)] == ["mit", "mit", "apache-2", "gpl-3", ""]
    assert L.license_scan(df.where(F.lit(False))).count() == 0


def test_seeds_find_every_notice_within_its_edits():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.choice([x for x in L.NOTICES if x.edits])
        phrase = list(n.words)
        for _ in range(rng.randint(0, n.edits)):
            at, how = rng.randrange(1, len(phrase) - 1), rng.choice("dis")
            phrase[at : at + (how != "i")] = [] if how == "d" else [rng.choice("xyz")]
        edited = "".join(phrase)
        if "  " in edited or edited != edited.strip():
            continue
        line, _ = L.normal(f"before {edited} {n.exact} after")
        hits = [(a, b, e) for label, a, b, e in L.fuzzy(line, L.NOTICES) if label == n.label]
        assert hits and min(e for *_, e in hits) <= edit_distance(edited, n.words)


@pytest.mark.parametrize("text", [t for t in CASES if t])
def test_edits_are_what_they_say(text):
    line, _ = L.normal(text)
    by_label = {n.label: n for n in L.NOTICES}
    for label, a, b, e in L.fuzzy(line, L.NOTICES):
        assert edit_distance(line[a:b].strip(), by_label[label].phrase) <= e <= by_label[label].edits
