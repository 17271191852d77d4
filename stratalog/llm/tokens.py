"""Public tokenizers, and a store of the ids of words for those that cannot see across a blank between words.

A text is cut before each single blank that stands between two words, where the tokenizer's own splitting cuts
anyway, so the ids of the pieces, joined, are the ids of the text. Each new piece is encoded by the tokenizers
library: a plain word by its merge model at once, which is what its splitting would hand on, all others by the whole
tokenizer. Pieces seen before come from a bounded store of the worker. Results don't depend on what it holds.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces of a generation that a worker keeps; two generations are about 120 MB.
KEPT = 300_000
#: Marks that may follow a plain word: none that begins a contraction or stands in special tokens.
MARKS = ".,!?;:\"#$%&()*+-/=@[\\]^_`{}~"
#: A blank that is not alone between two words (a pattern of Arrow), and one that is.
UNEVEN = r"[\s\x0b\x1c-\x1f\x85\p{Z}] | [\s\x0b\x1c-\x1f\x85\p{Z}]|^ | $"
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: Words that are encoded as one text.
JOINED = 512


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_padding()
    found.no_truncation()
    return found


def vocabulary_path(name: str) -> str:
    """The place of a tokenizer file of the machine that runs this."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(path: str, texts: list[str]) -> list[list[int]]:
    return [x.ids for x in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=4)
def begin_with_blank(path: str) -> np.ndarray:
    """Whether each id of a byte-level vocabulary begins with a blank."""
    found = tokenizer(path)
    words = found.get_vocab(with_added_tokens=True)
    out = np.zeros(max(words.values(), default=-1) + 1, bool)
    out[[i for w, i in words.items() if w.startswith(LETTERS[32])]] = True
    return out


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: its own where it can be seen, else one from U+0100 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in seen]
    return [chr(b) if b in seen else chr(256 + rest.index(b)) for b in range(256)]


LETTERS = byte_letters()


class Words:
    """Ids of texts from the ids of their words. The tokenizer is a byte-level one whose splitting takes letters, with the
    blank before them, as one part, and marks after them as another."""

    def __init__(self, path: str, width: int) -> None:
        self.path, self.kind = path, {2: "H", 4: "I"}[width]
        # ids of words as a text begins and after a blank: those used lately, and those of the generation before
        self.first: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.next: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def learn(self, stores: tuple[dict[str, bytes], dict[str, bytes]], words: list[str], before: str) -> tuple[tuple[dict[str, bytes], dict[str, bytes]], list[bytes]]:
        """The stores with all words (different ones) in the first one, and the ids of each word. A full store becomes the
        generation before."""
        store, old = stores if len(stores[0]) <= KEPT else ({}, stores[0])
        tokenize, kind, rest, marks = tokenizer(self.path).model.tokenize, self.kind, [], {}
        ahead = LETTERS[32] if before else ""
        out, seen = list(map(store.get, words)), old.get
        for i, found in enumerate(out):
            if found is not None:
                continue
            w = words[i]
            if (found := seen(w)) is None:
                core = w if w.isalpha() else w.rstrip(MARKS)
                if not core.isalpha() or not (w.isascii() or max(core) <= "\xff"):
                    rest.append(i)
                    continue
                ids = [t.id for t in tokenize(ahead + (core if core.isascii() else "".join([LETTERS[b] for b in core.encode()])))]
                if len(core) < len(w):
                    after = w[len(core) :]
                    if after not in marks:
                        marks[after] = [t.id for t in tokenize(after)]
                    ids += marks[after]
                found = array(kind, ids).tobytes()
            store[w] = out[i] = found
        left = [words[i] for i in rest]
        if before:
            left = self.learn_joined(store, left)
        for i in range(0, len(left), 1000):
            part = left[i : i + 1000]
            for w, ids in zip(part, encoded(self.path, [before + w for w in part])):
                store[w] = array(kind, ids).tobytes()
        for i in rest:
            out[i] = store[words[i]]
        return (store, old), out

    def learn_joined(self, store: dict[str, bytes], words: list[str]) -> list[str]:
        """Encode words after a blank many at a time, as one text that is cut again where an id begins with a blank; returns
        those left out: what has blanks of its own or other ones at its ends, and texts whose cuts are not one for each word."""
        begins, left, whole = begin_with_blank(self.path), [], []
        for w in words:
            (left if not w or " " in w or w[0].isspace() or w[-1].isspace() else whole).append(w)
        size = np.dtype(self.kind).itemsize
        parts = [whole[i : i + JOINED] for i in range(0, len(whole), JOINED)]
        for part in parts:
            (got,) = encoded(self.path, [" " + " ".join(part)])
            ids = np.array(got, self.kind)
            cuts = np.flatnonzero(begins[ids])
            if len(cuts) != len(part) or cuts[0]:
                left += part
                continue
            data, ends = ids.tobytes(), [*(cuts * size).tolist(), len(ids) * size]
            store.update((w, data[a:b]) for w, a, b in zip(part, ends, ends[1:]))
        return left

    @staticmethod
    def flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, pa.DictionaryArray]:
        """All words in a row, where each text's begin and end, and the different words."""
        words = lists.flatten()
        ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
        return words, ends, words.dictionary_encode()

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null is empty. Each different word of the batch is looked up once."""
        kind = np.dtype("<u2" if self.kind == "H" else "<u4")
        texts = pc.fill_null(texts, "")
        lists = pc.split_pattern(texts, " ")
        order = np.arange(len(texts))
        uneven = np.flatnonzero(pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False))
        if len(uneven):
            even = np.delete(order, uneven)
            order = np.concatenate([even, uneven])
            pieces = pa.array([BETWEEN.split(texts[i].as_py()) for i in uneven.tolist()], pa.list_(pa.string()))
            lists = pa.concat_arrays([lists.take(pa.array(even)), pieces])
        words, ends, coded = self.flat(lists)
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        heads = words.take(pa.array(ends[:-1])).to_numpy(zero_copy_only=False).tolist()
        different = list(dict.fromkeys(heads))
        self.first, ids_first = self.learn(self.first, different, "")
        self.next, ids_next = self.learn(self.next, known, " ")
        parts = pa.array([*ids_next, *map(dict(zip(different, ids_first)).__getitem__, heads)], pa.binary())
        _, offsets, values = parts.buffers()
        bounds = np.frombuffer(offsets, np.int32, len(parts) + 1).astype(np.int64) // kind.itemsize
        data = np.frombuffer(values, kind, int(bounds[-1])) if len(parts) else np.zeros(0, kind)
        size, start = np.diff(bounds), bounds[:-1]
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        which[ends[:-1]] = len(known) + np.arange(len(heads))
        size, start = size[which], start[which]
        stop = np.append(0, np.cumsum(size))
        ids = data[np.repeat(start - stop[:-1], size) + np.arange(stop[-1])]
        out = [ids] * len(texts)
        for i, a, b in zip(order.tolist(), stop[ends[:-1]].tolist(), stop[ends[1:]].tolist()):
            out[i] = ids[a:b]
        return out
