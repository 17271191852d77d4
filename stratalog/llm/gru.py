"""A gated recurrent language model over class-factored words, in numpy.

The next word's probability is p(class | state) * p(word | class, state). Class 0 holds all words outside the
vocabulary; the other classes cut the vocabulary, most frequent words first, into stretches of like total
square-root frequency. The state is carried from one window of a document to the next, in training (where gradients end
at the window's first step: truncated backpropagation) and in scoring.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

HIDDEN, CLASSES, STEPS, LANES = 16, 32, 16, 192
RATE = 0.3
#: Words that are dealt to lanes at a time, and windows that are laid out at a time.
DEALT, WINDOWS = 1_000_000, 64
#: Documents that are scored side by side, and words whose probabilities are taken at a time: about what a core's own cache holds.
BESIDE, STRETCH = 768, 8192
#: Logits up to this size, and sums of their exp, fit 32-bit floats without a shift.
SAFE = 60.0
#: Places of one word in a window that are added up place by place for all words.
FEW = 5


@dataclass
class Shape:
    """Where each class begins among the words 1 to V (0 is outside the vocabulary)."""

    starts: np.ndarray  # of classes 1.., in words counted from 0; the last entry is V
    word_class: np.ndarray  # class of word 0 (0) and of words 1 to V

    @classmethod
    def of(cls, counts: np.ndarray, classes: int = CLASSES) -> Shape:
        v = len(counts)
        if not v:
            return cls(np.zeros(1, np.int64), np.zeros(1, np.int64))
        share = np.cumsum(np.sqrt(counts)) / np.sqrt(counts).sum()
        number = np.minimum((share * classes).astype(np.int64), classes - 1)
        number = np.unique(number, return_inverse=True)[1]
        starts = np.append(np.searchsorted(number, np.arange(number.max() + 1)), v)
        return cls(starts, np.concatenate([[0], number + 1]))


def initial(counts: np.ndarray, outside: float, shape: Shape, hidden: int = HIDDEN, seed: int = 3) -> dict[str, np.ndarray]:
    """Small random weights; biases that give the words' corpus frequencies."""
    rng = np.random.default_rng(seed)
    v, c = len(counts), len(shape.starts)
    f = np.float32
    total = np.array([max(outside, 1e-9)] + [counts[a:b].sum() for a, b in zip(shape.starts, shape.starts[1:])])
    return {
        "x": rng.normal(0, 0.3, (v + 1, 3 * hidden)).astype(f),
        "b": np.concatenate([np.full(hidden, -1.0), np.zeros(2 * hidden)]).astype(f),
        "u": rng.normal(0, hidden**-0.5, (hidden, 2 * hidden)).astype(f),
        "k": rng.normal(0, hidden**-0.5, (hidden, hidden)).astype(f),
        "wc": np.zeros((hidden, c), f),
        "bc": np.log(total / total.sum()).astype(f),
        "wo": np.zeros((hidden, v), f),
        "bo": np.log(np.maximum(counts, 1e-9)).astype(f),
    }


def forward(a: np.ndarray, h: np.ndarray, ut: np.ndarray, kt: np.ndarray, rh: np.ndarray, out: np.ndarray) -> None:
    """The next state into out. a holds the inputs and becomes the gates z (keeps the old state in part) and r (gates it),
    and the candidate. Here and below, columns are words side by side, so that every row is one long stretch of memory."""
    n = len(h)
    gates, c = a[: 2 * n], a[2 * n :]
    gates += ut @ h
    np.negative(gates, out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    np.multiply(gates[n:], h, out=rh)
    c += kt @ rh
    np.tanh(c, out=c)
    np.subtract(c, h, out=out)
    out *= gates[:n]
    out += h


def step(p: dict, ids: np.ndarray, h: np.ndarray):
    """The next state of each row of h, and what it was made of: the states, gates, gated states and candidates before."""
    n = h.shape[1]
    a = (p["x"][ids] + p["b"]).T.copy()
    before = np.ascontiguousarray(h.T)
    rh, out = np.empty_like(before), np.empty_like(before)
    forward(a, before, p["u"].T, p["k"].T, rh, out)
    return out.T, (h, a[: 2 * n].T, rh.T, a[2 * n :].T)


def with_bias(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weights with their biases as those of one more state that is always 1. Rows have a few columns more than that, as rows
    that lie a power of two apart would share few lines of the cache."""
    out = np.zeros((len(w) + 1, w.shape[1] + 8), w.dtype)
    out[:-1, : w.shape[1]], out[-1, : w.shape[1]] = w, b
    return out


def is_small(block: np.ndarray) -> bool:
    """Whether exp needs no shift for any logit that with_bias() gives for states between -1 and 1."""
    return float(np.abs(block).sum(0).max()) < SAFE


def within(shape: Shape, words: np.ndarray, number: np.ndarray) -> tuple[list[tuple[int, int, int, int]], np.ndarray, np.ndarray]:
    """Of words in order of their class (number): first word and end, begin and end among words, for each class of more than one
    word; which words those have; and where their own logits stand when the classes' logits follow one another."""
    ends = np.searchsorted(number, np.arange(1, len(shape.starts) + 1))
    width, size = np.diff(ends), np.diff(shape.starts)
    used = (width > 0) & (size > 1)
    begin = np.cumsum(width * size * used) - width * size * used
    rows = np.arange(ends[0], len(words))
    if (size == 1).any():
        rows = rows[used[number[rows] - 1]]
    kind = number[rows] - 1
    own = (begin - shape.starts[:-1] * width - width - ends[:-1])[kind] + words[rows] * width[kind] + rows
    classes = zip(shape.starts[:-1][used].tolist(), shape.starts[1:][used].tolist(), ends[:-1][used].tolist(), ends[1:][used].tolist())
    return list(classes), rows, own


class Room:
    """Arrays that are used again and again: memory that is asked for anew is filled with zeros by the machine each time."""

    def __init__(self, kind: np.dtype) -> None:
        self.kind, self.held = kind, {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        """An array of this shape with any content; it lasts until the name is asked for again."""
        size = math.prod(shape)
        if name not in self.held or self.held[name].size < size:
            self.held[name] = np.empty(size, self.kind)
        return self.held[name][:size].reshape(shape)


def logits_within(block: np.ndarray, states: np.ndarray, classes: list[tuple[int, int, int, int]], small: bool, room: Room) -> tuple[np.ndarray, list[np.ndarray]]:
    """The logits of each class's words, one class after another in one row, and as one array for each class."""
    flat = room("logits", sum((stop - first) * (e - s) for first, stop, s, e in classes))
    at, parts = 0, []
    for first, stop, s, e in classes:
        g = flat[at : at + (stop - first) * (e - s)].reshape(stop - first, e - s)
        np.matmul(block[:, first:stop].T, states[:, s:e], out=g)
        if not small:
            g -= np.maximum.reduce(g, 0)
        parts.append(g)
        at += g.size
    return flat, parts


def log_probs(p: dict, shape: Shape, h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Natural log probability of each word (0: that it lies outside the vocabulary) given its state, a row of h."""
    return log_probs_at(p, shape, h.T, words)


def log_probs_at(p: dict, shape: Shape, h: np.ndarray, words: np.ndarray, blocks: tuple | None = None, room: Room | None = None) -> np.ndarray:
    """log_probs() of states that are columns, a stretch of columns at a time. blocks: output_blocks(p), if at hand."""
    out, room = np.empty(len(words), h.dtype), room or Room(h.dtype)
    (wc, small), (wo, small_within) = blocks or output_blocks(p)
    c = len(shape.starts)
    for at in range(0, len(words), STRETCH):
        w = words[at : at + STRETCH]
        number = shape.word_class[w]
        order = np.argsort(number.astype(np.uint16), kind="stable")
        w, number = w[order], number[order]
        own = room("own", len(h) + 1, len(w))
        np.take(h[:, at : at + STRETCH], order, 1, out=own[:-1], mode="clip")
        own[-1] = 1
        x = np.matmul(wc[:, :c].T, own, out=room("x", c, len(w)))
        if not small:
            x -= x.max(0)
        got = x[number, np.arange(len(w))]
        np.exp(x, out=x)
        got -= np.log(x.sum(0))
        classes, rows, places = within(shape, w, number)
        flat, parts = logits_within(wo, own, classes, small_within, room)
        found, total = flat[places], np.ones(len(w), h.dtype)
        np.exp(flat, out=flat)
        for (_, _, s, e), g in zip(classes, parts):
            np.add.reduce(g, 0, out=total[s:e])
        got[rows] += found - np.log(total[rows])
        out[at + order] = got
    return out


def output_blocks(p: dict) -> tuple:
    """The weights of the classes and of the words, each with whether their logits are small."""
    return tuple((x, is_small(x)) for x in (with_bias(p["wc"], p["bc"]), with_bias(p["wo"], p["bo"])))


def score(p: dict, shape: Shape, docs: list[np.ndarray], end: int, steps: int = 32) -> np.ndarray:
    """Natural log probability of each whole document; a document's words include its end."""
    out = np.zeros(len(docs))
    order = np.argsort([-len(d) for d in docs], kind="stable")
    blocks, room = output_blocks(p), Room(p["x"].dtype)
    for at in range(0, len(docs), BESIDE):
        own = order[at : at + BESIDE]
        out[own] = score_beside(p, shape, [docs[i] for i in own], end, steps, blocks, room)
    return out


def score_beside(p: dict, shape: Shape, docs: list[np.ndarray], end: int, steps: int, blocks: tuple, room: Room) -> np.ndarray:
    """score() of documents that all go forward at once, longest first."""
    sizes = np.array([len(d) for d in docs], np.int64)
    totals = np.zeros(len(docs))
    flat = np.concatenate(docs).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    x, b, ut, kt = p["x"], p["b"][:, None], np.ascontiguousarray(p["u"].T), np.ascontiguousarray(p["k"].T)
    n, kind = len(kt), x.dtype
    h = np.zeros((n, len(docs)), kind)
    last = np.full(len(docs), end, np.int64)
    at = 0
    while at < sizes[0]:
        # documents longer than at stand first; where few are left, more steps go together
        wide = max(steps, STRETCH // int(np.searchsorted(-sizes, -at, "left")))
        lives = np.searchsorted(-sizes, -np.arange(at, min(at + wide, int(sizes[0]))), "left").tolist()
        ends = np.cumsum([0, *lives]).tolist()
        states, words = room("states", n, ends[-1]), np.empty(ends[-1], np.int64)
        for t, live in enumerate(lives):
            a = np.add(x.take(last[:live], 0).T, b, order="C")
            now = states[:, ends[t] : ends[t + 1]]
            forward(a, h[:, :live], ut, kt, np.empty((n, live), kind), now)
            h, last = now, flat[starts[:live] + (at + t)]
            words[ends[t] : ends[t + 1]] = last
        h = h.copy()
        got = log_probs_at(p, shape, states, words, blocks, room)
        for t, live in enumerate(lives):
            totals[:live] += got[ends[t] : ends[t + 1]]
        at += wide
    return totals


class Trainer:
    """Adagrad on windows of several documents side by side."""

    def __init__(self, p: dict, shape: Shape, end: int, rate: float = RATE) -> None:
        self.p = {k: v.copy() for k, v in p.items()}
        self.wo = with_bias(p["wo"], p["bo"])
        self.p["wo"], self.p["bo"] = self.wo[:-1, : p["wo"].shape[1]], self.wo[-1, : p["wo"].shape[1]]
        self.shape, self.end, self.rate = shape, end, rate
        self.sums = {k: np.full(v.shape, 1e-2, np.float32) for k, v in p.items()}
        self.words = 0
        self.room = Room(p["x"].dtype)

    def update(self, key: str, g: np.ndarray, at=slice(None)) -> None:
        g = np.clip(g, -1, 1)
        sums = self.sums[key][at]
        sums += g * g
        if not isinstance(at, slice):
            self.sums[key][at] = sums
        g *= self.rate
        g /= np.sqrt(sums)
        self.p[key][at] -= g

    def train(self, docs: Iterable[np.ndarray], lanes: int = LANES, steps: int = STEPS, dealt: int = DEALT) -> None:
        """One pass over docs, which may be a stream. Documents follow each other in a lane, each from an empty state."""
        held, size = [], 0
        for d in docs:
            if len(d):
                held.append(d)
                size += len(d)
                if size >= dealt:
                    self.deal(held, lanes, steps)
                    held, size = [], 0
        self.deal(held, lanes, steps)

    def deal(self, docs: list[np.ndarray], lanes: int, steps: int) -> None:
        """Train on docs side by side in lanes of like lengths: longest documents first, each to the shortest lane."""
        heap = [(0, i) for i in range(min(lanes, len(docs)))]
        dealt: list[list[np.ndarray]] = [[] for _ in heap]
        for d in sorted(docs, key=len, reverse=True):
            size, i = heap[0]
            dealt[i].append(d)
            heapq.heapreplace(heap, (size + len(d), i))
        dealt.sort(key=lambda own: -sum(map(len, own)))
        target = [np.concatenate(own) for own in dealt]
        source, keep = [], []
        for own, y in zip(dealt, target):
            starts = np.cumsum([0, *map(len, own[:-1])])
            x, k = np.roll(y, 1), np.ones(len(y), np.float32)
            x[starts], k[starts] = self.end, 0
            source.append(x)
            keep.append(k)
        sizes = [len(y) for y in target]
        h = np.zeros((len(target), self.p["k"].shape[0]), np.float32)
        wide = steps * WINDOWS
        for begin in range(0, sizes[0] if sizes else 0, wide):
            live = sum(n > begin for n in sizes)
            x = np.full((live, wide), self.end, np.int64)
            y = np.full((live, wide), -1, np.int64)
            k = np.ones((live, wide), np.float32)
            for i in range(live):
                n = min(wide, sizes[i] - begin)
                x[i, :n], y[i, :n], k[i, :n] = source[i][begin : begin + n], target[i][begin : begin + n], keep[i][begin : begin + n]
            x, y, k = x.T, y.T, k.T
            for at in range(0, min(wide, sizes[0] - begin), steps):
                live = sum(n > begin + at for n in sizes)
                h = self.window(x[at : at + steps, :live], y[at : at + steps, :live], h[:live], k[at : at + steps, :live])

    def window(self, x: np.ndarray, y: np.ndarray, h: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
        """One update from x (inputs), y (words to foretell, -1: none) and the states before; keep is 0 where a document begins."""
        p, shape, n, room, (steps, live) = self.p, self.shape, h.shape[1], self.room, x.shape
        kind = p["x"].dtype
        ids = x.reshape(-1)
        # a step's columns stand together; rows that lie a power of two apart would share few lines of the cache
        a = room("a", steps, 3 * n, live)
        inputs = np.take(p["x"], ids, 0, out=room("wide", ids.size, 3 * n), mode="clip")
        np.add(inputs.reshape(steps, live, 3 * n).transpose(0, 2, 1), p["b"][:, None], out=a)
        kept, states, gated = (room(name, steps, n, live) for name in ("kept", "states", "gated"))
        u, k = p["u"], p["k"]
        ut, kt = np.ascontiguousarray(u.T), np.ascontiguousarray(k.T)
        now = h.T
        # few lanes begin a document in a step
        step, lane = np.nonzero(keep == 0) if keep is not None else (np.zeros(0, np.int64),) * 2
        begun = np.searchsorted(step, np.arange(steps + 1)).tolist()
        begun = [lane[i:j] for i, j in zip(begun, begun[1:])]
        for t in range(steps):
            kept[t] = now
            if len(begun[t]):
                kept[t][:, begun[t]] = 0
            now = states[t]
            forward(a[t], kept[t], ut, kt, gated[t], now)
        words = y.reshape(-1)
        rows = np.flatnonzero(words >= 0)
        # by class, so that each class is a slice
        rows = rows[np.argsort(shape.word_class[words[rows]].astype(np.uint16), kind="stable")]
        own, words, m = room("own", n + 1, len(rows)), words[rows], len(rows)
        np.take(self.beside("flat", states), rows, 1, out=own[:-1], mode="clip")
        own[-1] = 1
        self.words += m
        number = shape.word_class[words]
        words_of_a_window = STEPS * LANES  # so that a few last long documents move the weights little
        scale = kind.type(1 / np.sqrt(words_of_a_window))
        wc, c = with_bias(p["wc"], p["bc"]), len(shape.starts)
        g = np.matmul(wc[:, :c].T, own, out=room("g", c, m))
        if not is_small(wc):
            g -= g.max(0)
        np.exp(g, out=g)
        g *= scale / g.sum(0)
        g[number, np.arange(m)] -= scale
        # one column more, for words that are not there
        dh = room("dh", n, m + 1)
        np.matmul(p["wc"], g, out=dh[:, :m])
        dh[:, m] = 0
        dwc = own @ g.T
        classes, _, places = within(shape, words, number)
        logits, parts = logits_within(self.wo, own, classes, is_small(self.wo), room)
        np.exp(logits, out=logits)
        total = np.ones(m, kind)
        for (_, _, s, e), g in zip(classes, parts):
            np.add.reduce(g, 0, out=total[s:e])
        np.divide(scale, total, out=total)
        for (_, _, s, e), g in zip(classes, parts):
            g *= total[s:e]
        logits[places] -= scale
        dwo, more = room("dwo", *self.wo.shape), room("more", n, m)
        dwo[:] = 0
        more[:] = 0
        for (first, stop, s, e), g in zip(classes, parts):
            np.matmul(p["wo"][:, first:stop], g, out=more[:, s:e])
            np.matmul(own[:, s:e], g.T, out=dwo[:, first:stop])
        dh[:, :m] += more
        place = np.full(ids.size, m)
        place[rows] = np.arange(m)
        flat = np.take(dh, place, 1, out=room("flat", n, ids.size), mode="clip")
        all_ = room("all", steps, n, live)
        all_[:] = flat.reshape(n, steps, live).transpose(1, 0, 2)
        # what a step's gradient is multiplied with, for all steps at once
        z, r, c = a[:, :n], a[:, n : 2 * n], a[:, 2 * n :]
        old, to_c, to_z, to_r = (room(name, steps, n, live) for name in ("old", "to_c", "to_z", "to_r"))
        np.subtract(1, z, out=old)
        np.multiply(c, c, out=to_c)
        np.subtract(1, to_c, out=to_c)
        to_c *= z
        np.subtract(c, kept, out=to_z)
        to_z *= z
        to_z *= old
        np.subtract(1, r, out=to_r)
        to_r *= r
        to_r *= kept
        da = room("da", steps, 3 * n, live)
        back = np.zeros((n, live), kind)
        for t in reversed(range(steps)):
            d, part = all_[t], da[t]
            d += back
            np.multiply(d, to_c[t], out=part[2 * n :])
            drh = k @ part[2 * n :]
            np.multiply(d, to_z[t], out=part[:n])
            np.multiply(drh, to_r[t], out=part[n : 2 * n])
            np.multiply(d, old[t], out=back)
            drh *= r[t]
            back += drh
            back += u @ part[: 2 * n]
            if len(begun[t]):
                back[:, begun[t]] = 0
        wide = room("wide", steps, live, 3 * n)
        wide[:] = da.transpose(0, 2, 1)
        da = wide.reshape(-1, 3 * n)
        du = self.beside("flat", kept) @ da[:, : 2 * n]
        dk = self.beside("flat", gated) @ da[:, 2 * n :]
        order = np.argsort(ids.astype(np.uint16) if len(p["x"]) <= 1 << 16 else ids, kind="stable")
        times = np.bincount(ids, minlength=1)
        used = np.flatnonzero(times)
        n_used = times[used]
        first = np.cumsum(n_used) - n_used
        sorted_ = np.take(da, order, 0, out=room("sorted", ids.size, 3 * n), mode="clip")
        dx = sorted_.take(first, 0)
        # most words are there a few times; frequent ones, with word 0 half of all, are summed one by one
        often = np.flatnonzero(n_used > FEW)
        for i in range(1, FEW):
            again = np.flatnonzero((n_used > i) & (n_used <= FEW))
            dx[again] += sorted_.take(first[again] + i, 0)
        for i, at, size in zip(often.tolist(), first[often].tolist(), n_used[often].tolist()):
            np.add.reduce(sorted_[at : at + size], 0, out=dx[i])
        v = p["wo"].shape[1]
        for key, g in (("wc", dwc[:-1]), ("bc", dwc[-1]), ("wo", dwo[:-1, :v]), ("bo", dwo[-1, :v]), ("u", du), ("k", dk), ("b", dx.sum(0))):
            self.update(key, g)
        self.update("x", dx, used)
        return states[-1].T.copy()

    def beside(self, name: str, x: np.ndarray) -> np.ndarray:
        """The columns of all steps in one row."""
        out = self.room(name, x.shape[1], x.shape[0], x.shape[2])
        out[:] = x.transpose(1, 0, 2)
        return out.reshape(x.shape[1], -1)
