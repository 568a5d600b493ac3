"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters the network with word inputs (how much oftener it stands in toxic documents, and a learned vector of its
hash) and character inputs (the same for its 3-, 4- and 5-grams of characters, pooled). The network reads overlapping
windows of words; a document's score is that of its most toxic window. Everything of the network that depends on a word
alone is one row of a table, made once a word and kept in a bounded memo, so scoring costs a gather and a small product a
word and direction.

Training takes a bounded sample of labelled documents (SAMPLE of either class) on the driver; scoring is a map over all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import append_columns, arrow_batches, col, slices

#: Labelled documents of each class that training takes at most, and bytes of their texts.
SAMPLE, SAMPLE_BYTES = 1_500, 48 << 20
WINDOW, STRIDE = 48, 36
HIDDEN, EMBED = 8, 4
GRAMS = (3, 4, 5)
GRAM_BITS, WORD_BITS, EMBED_BITS = 18, 18, 14
#: Bytes of words and their rows that a scorer keeps.
MEMO_BYTES = 64 << 20
EPOCHS, BATCH, RATE, VECTOR_RATE = 2, 128, 0.02, 0.05
#: Parts of the training documents; what a document meets as ratios comes from the other parts.
PARTS = 4
#: Documents' worth of doubt in a ratio.
DOUBT = 4.0
#: Weights tried for the number of windows: the highest of many is higher by chance.
SLOPES = (0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0)
#: Windows that the slope counts at most unless told otherwise, those of 5,000 words; all windows are scored in any case.
MOST_WINDOWS = 139
#: Rows with remainder HELD_OUT of crc32(doc_id) modulo FOLDS are never learned from.
FOLDS, HELD_OUT = 5, 0

WORD = re.compile(r"[^\W_]+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _scramble(x: np.ndarray, bits: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _M2
    return (x >> np.uint64(64 - bits)).astype("i8")


@dataclass
class Shapes:
    """Hashes of a list of words: of each word, and of its character n-grams with their owners, ascending."""

    word: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray]]

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embedding rows of some words: of each word, of its shortest n-grams, and whose those are."""
        ids, owner = self.grams[0]
        first = np.searchsorted(owner, which)
        count = np.searchsorted(owner, which, "right") - first
        upto = np.cumsum(count)
        picked = np.repeat(first - (upto - count), count) + np.arange(upto[-1] if len(upto) else 0)
        return self.word[which] >> (WORD_BITS - EMBED_BITS), ids[picked] >> (GRAM_BITS - EMBED_BITS), np.repeat(np.arange(len(which)), count)


def shapes(words: Sequence[str]) -> Shapes:
    lengths = np.fromiter(map(len, words), "i8", len(words)) + 2
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), "<u4").astype("u8")
    owner = np.repeat(np.arange(len(words)), lengths)
    first = np.cumsum(lengths) - lengths
    place = (np.arange(len(points)) - np.repeat(first, lengths)).astype("u8")
    with np.errstate(over="ignore"):
        whole = np.add.reduceat((points + _M2) * ((place * np.uint64(2) + np.uint64(1)) * _M1 ^ (place * _M2)), first) if len(words) else np.zeros(0, "u8")
        grams = []
        for n in GRAMS:
            h = np.zeros(max(0, len(points) - n + 1), "u8")
            for k in range(n):
                h = (h + points[k : k + len(h)]) * _M1
            inside = owner[: len(h)] == owner[n - 1 : n - 1 + len(h)] if len(h) else np.zeros(0, bool)
            grams.append((_scramble(h[inside], GRAM_BITS), owner[: len(h)][inside]))
        return Shapes(_scramble(whole, WORD_BITS), grams)


@dataclass
class Odds:
    """Documents of each class in which a word or an n-gram stands, by hash."""

    docs: np.ndarray = field(default_factory=lambda: np.zeros(2))
    word: np.ndarray = field(default_factory=lambda: np.zeros((2, 1 << WORD_BITS), "f4"))
    gram: np.ndarray = field(default_factory=lambda: np.zeros((len(GRAMS), 2, 1 << GRAM_BITS), "f4"))

    def add(self, seen: Shapes, toxic: int) -> None:
        self.docs[toxic] += 1
        self.word[toxic, np.unique(seen.word)] += 1
        for i, (ids, _) in enumerate(seen.grams):
            self.gram[i, toxic, np.unique(ids)] += 1

    def __sub__(self, other: Odds) -> Odds:
        return Odds(self.docs - other.docs, self.word - other.word, self.gram - other.gram)

    def ratios(self) -> tuple[np.ndarray, np.ndarray]:
        """Log ratios of the classes' shares, 0 where nothing was seen, held between -4 and 6."""
        total = max(1.0, self.docs.sum())
        prior = DOUBT * np.maximum(self.docs / total, 1e-2)

        def log(c: np.ndarray) -> np.ndarray:
            share = [(c[..., k, :] + prior[k]) / (self.docs[k] + prior[k]) for k in (0, 1)]
            base = np.log(prior[1] / (self.docs[1] + prior[1])) - np.log(prior[0] / (self.docs[0] + prior[0]))
            out = np.log(share[1]) - np.log(share[0]) - base
            return np.clip(np.where(c.sum(-2) >= 2, out, 0), -4, 6).astype("f4")

        return log(self.word), log(self.gram)


def _pool(values: np.ndarray, owner: np.ndarray, n: int, how: np.ufunc) -> np.ndarray:
    out = np.zeros(n, "f4")
    if len(owner):
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        out[owner[first]] = how.reduceat(values, first)
    return out


N_FIXED = 1 + 2 * len(GRAMS)


def fixed_inputs(seen: Shapes, ratios: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Inputs that aren't learned by descent: log ratios of the word, and of its n-grams the highest and the mean."""
    word, gram = ratios
    n = len(seen.word)
    columns = [word[seen.word]]
    for i, (ids, owner) in enumerate(seen.grams):
        values = gram[i][ids]
        count = np.maximum(np.bincount(owner, minlength=n), 1)
        columns += [_pool(values, owner, n, np.maximum), _pool(values, owner, n, np.add) / count]
    return (np.stack(columns, 1) / 3).astype("f4") if n else np.zeros((0, N_FIXED), "f4")


class Network:
    """Parameters, and the two passes over a batch of windows."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        inputs = N_FIXED + 2 * EMBED
        draw = lambda *s, scale=0.3: rng.normal(0, scale, s).astype("f4")
        self.p = {
            "word": draw(1 << EMBED_BITS, EMBED, scale=0.05), "char": draw(1 << EMBED_BITS, EMBED, scale=0.05),
            "wf": draw(inputs, 3 * HIDDEN), "wb": draw(inputs, 3 * HIDDEN), "uf": draw(HIDDEN, 3 * HIDDEN), "ub": draw(HIDDEN, 3 * HIDDEN),
            "bf": np.zeros(3 * HIDDEN, "f4"), "bb": np.zeros(3 * HIDDEN, "f4"),
            "attend": draw(2 * HIDDEN), "out": draw(2 * HIDDEN), "bias": np.zeros(1, "f4"),
        }

    def inputs(self, fixed: np.ndarray, at_word: np.ndarray, at_char: np.ndarray, owner: np.ndarray) -> np.ndarray:
        n = len(fixed)
        count = np.maximum(np.bincount(owner, minlength=n), 1)[:, None]
        mean = np.stack([np.bincount(owner, self.p["char"][at_char, k], n) for k in range(EMBED)], 1) / count
        return np.concatenate([fixed, self.p["word"][at_word], mean.astype("f4")], 1)

    def rows(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a word brings into either direction, whatever stands around it."""
        return x @ self.p["wf"] + self.p["bf"], x @ self.p["wb"] + self.p["bb"]

    @staticmethod
    def step(gx: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
        gh = h @ u
        zr = gx[:, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN]
        np.negative(zr, zr)
        np.exp(zr, zr)
        zr += 1
        np.reciprocal(zr, zr)
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(gx[:, 2 * HIDDEN :] + r * gh[:, 2 * HIDDEN :])
        return n + z * (h - n), z, r, n, gh[:, 2 * HIDDEN :]

    def states(self, index: np.ndarray, mask: np.ndarray | None, tables: tuple[np.ndarray, np.ndarray], keep: list | None = None) -> np.ndarray:
        """Hidden states of both directions, (windows, words, 2 HIDDEN). Masked places leave the state as it was."""
        b, t = index.shape
        out = np.empty((b, t, 2 * HIDDEN), "f4")
        for d, (table, u) in enumerate(zip(tables, (self.p["uf"], self.p["ub"]), strict=True)):
            h = np.zeros((b, HIDDEN), "f4")
            for k in range(t) if d == 0 else range(t - 1, -1, -1):
                new, *rest = self.step(table[index[:, k]], h, u)
                if mask is not None:
                    new = np.where(mask[:, k, None], new, h)
                if keep is not None:
                    keep.append((d, k, h, *rest))
                h = new
                out[:, k, d * HIDDEN : (d + 1) * HIDDEN] = h
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        score = states @ self.p["attend"]
        if mask is not None:
            score = np.where(mask, score, -1e9)
        weight = np.exp(score - score.max(1, keepdims=True))
        weight /= weight.sum(1, keepdims=True)
        context = np.matmul(weight[:, None, :], states)[:, 0]
        return context @ self.p["out"] + self.p["bias"], weight, context

    def gradients(self, index: np.ndarray, mask: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Loss, gradients of the dense parameters, and of the inputs of each listed word."""
        p, g = self.p, {}
        tables = x @ p["wf"] + p["bf"], x @ p["wb"] + p["bb"]
        keep: list = []
        s = self.states(index, mask, tables, keep)
        logit, w, c = self.pool(s, mask)
        prob = 1 / (1 + np.exp(-logit))
        d = ((prob - y) / len(y)).astype("f4")
        g["bias"], g["out"] = np.array([d.sum()], "f4"), c.T @ d
        dc = d[:, None] * p["out"]
        inner = np.matmul(s, dc[:, :, None])[:, :, 0]
        ds_score = w * (inner - (w * inner).sum(1, keepdims=True))
        g["attend"] = np.einsum("bt,bth->h", ds_score, s)
        ds = w[:, :, None] * dc[:, None, :] + ds_score[:, :, None] * p["attend"]
        dx = np.zeros_like(x)
        for side, (wn, un, bn) in enumerate((("wf", "uf", "bf"), ("wb", "ub", "bb"))):
            u, dh = p[un], np.zeros((len(y), HIDDEN), "f4")
            gu, dtable = np.zeros_like(u), np.zeros((len(x), 3 * HIDDEN), "f4")
            for _, k, h, z, r, n, ghn in reversed([e for e in keep if e[0] == side]):
                dh = dh + ds[:, k, side * HIDDEN : (side + 1) * HIDDEN]
                on = mask[:, k, None]
                dnew = np.where(on, dh, 0)
                dn = dnew * (1 - z) * (1 - n * n)
                dz = dnew * (h - n) * z * (1 - z)
                dr = dn * ghn * r * (1 - r)
                dgx = np.concatenate([dz, dr, dn], 1)
                dgh = np.concatenate([dz, dr, dn * r], 1)
                gu += h.T @ dgh
                np.add.at(dtable, index[:, k], dgx)
                dh = np.where(on, dnew * z, dh) + dgh @ u.T
            g[un], g[wn], g[bn] = gu, x.T @ dtable, dtable.sum(0)
            dx += dtable @ p[wn].T
        loss = float(-(y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9)).mean())
        return loss, g, dx


class _Adam:
    def __init__(self) -> None:
        self.m: dict[str, np.ndarray] = {}
        self.v: dict[str, np.ndarray] = {}
        self.t = 0

    def update(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        for k, x in g.items():
            x = x * min(1.0, 1.0 / (size + 1e-9))
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * x
            v = self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * x * x
            p[k] -= (rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)).astype("f4")


    def rows(self, p: dict[str, np.ndarray], name: str, at: np.ndarray, g: np.ndarray, rate: float) -> None:
        """A step on some rows of a table of vectors, each by the gradients that it has had so far."""
        which, own = np.unique(at, return_inverse=True)
        total = np.zeros((len(which), g.shape[1]), "f4")
        np.add.at(total, own, g)
        seen = self.v.setdefault(name, np.full(len(p[name]), 1e-8, "f4"))
        seen[which] += (total * total).mean(1)
        p[name][which] -= rate * total / np.sqrt(seen[which])[:, None]


def starts(n: int, window: int = WINDOW, stride: int = STRIDE) -> list[int]:
    """First words of the windows of a text of n words: every stride words, and one that ends at the last word."""
    return [*range(0, n - window, stride), n - window] if n > window else [0] if n else []


def weighing(windows: int, most: int | None) -> int:
    """Windows of a text that the slope counts."""
    return max(1, windows) if most is None else min(max(1, windows), most)


class Model:
    """A document's logit is that of its most toxic window, less ``slope`` a log of its number of windows, less ``cut``.

    The highest of many windows is higher by chance, which the slope takes off. Of a toxic passage amid ever more clean text it would
    take ever more, so windows are counted up to ``most_windows``; None counts them all."""

    def __init__(self, network: Network, ratios: tuple[np.ndarray, np.ndarray], cut: float, slope: float, prior: float, most_windows: int | None = MOST_WINDOWS) -> None:
        self.network, self.ratios, self.cut, self.slope, self.prior, self.most_windows = network, ratios, cut, slope, prior, most_windows

    def rows(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        seen = shapes(words)
        return self.network.rows(self.network.inputs(fixed_inputs(seen, self.ratios), *seen.take(np.arange(len(words)))))


def _weight(words: Sequence[str]) -> int:
    """Bytes that words and their rows take in the memo, at most."""
    return sum(4 * len(w) for w in words) + (200 + 2 * 3 * HIDDEN * 4) * len(words)


class Scorer:
    """Scores texts, with the memo of words."""

    def __init__(self, model: Model, memo_bytes: int = MEMO_BYTES) -> None:
        self.model, self.limit = model, memo_bytes
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {"": 0}
        self.bytes = 0
        self.tables = [np.zeros((1 << 16, 3 * HIDDEN), "f4") for _ in range(2)]

    def _learn(self, words: set[str]) -> None:
        """Rows for all words of a call, beside those of earlier calls while the memo has room."""
        new = [w for w in words if w not in self.at]
        if self.bytes + _weight(new) > self.limit and self.bytes:
            self._clear()
            new = list(words)
        self.bytes += _weight(new)
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            n = len(self.at)
            for side, rows in enumerate(self.model.rows(part)):
                while len(self.tables[side]) < n + len(part):
                    self.tables[side] = np.concatenate([self.tables[side], np.zeros_like(self.tables[side])])
                self.tables[side][n : n + len(part)] = rows
            self.at.update(zip(part, range(n, n + len(part)), strict=True))

    def logits(self, texts: Sequence[str | None], batch: int = 2048) -> np.ndarray:
        """The highest logit over a text's windows, less the slope's part; minus infinity without a word."""
        out, many = np.full(len(texts), -np.inf), np.ones(len(texts))
        indexes, windows = [], []
        words = [words_of(t) for t in texts]
        self._learn(set().union(*words))
        base = 0
        for i, own in enumerate(words):
            indexes.append(np.fromiter(map(self.at.__getitem__, own), "i4", len(own)))
            begin = starts(len(own))
            many[i] = weighing(len(begin), self.model.most_windows)
            windows += [(min(len(own), WINDOW), i, base + s) for s in begin]
            base += len(own)
        if not windows:
            return out
        flat = np.concatenate(indexes)
        size, doc, first = np.array(sorted(windows)).T
        for a in range(0, len(size), batch):
            n, d, s = size[a : a + batch], doc[a : a + batch], first[a : a + batch]
            place = np.arange(n.max())
            mask = place < n[:, None]
            index = np.where(mask, flat[np.minimum(s[:, None] + place, len(flat) - 1)], 0)
            mask = None if mask.all() else mask
            logit = self.model.network.pool(self.model.network.states(index, mask, self.tables), mask)[0]
            np.maximum.at(out, d, logit)
        return out - self.model.slope * np.log(many)

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        logit = self.logits(texts)
        shifted = np.where(np.isfinite(logit), logit - self.model.cut, self.model.prior)
        return 1 / (1 + np.exp(-np.clip(shifted, -30, 30)))


class _Corpus:
    """Training texts as word numbers, the words' shapes, and their inputs as each part of the documents meets them."""

    def __init__(self, texts: Sequence[str], y: np.ndarray) -> None:
        words = [words_of(t) for t in texts]
        number: dict[str, int] = {}
        self.docs = [np.array([number.setdefault(w, len(number)) for w in own], "i8") for own in words]
        self.shapes = shapes(list(number))
        parts = [Odds() for _ in range(PARTS)]
        for i, own in enumerate(self.docs):
            parts[i % PARTS].add(self._of(np.unique(own)), int(y[i]))
        self.whole = Odds()
        for p in parts:
            self.whole = Odds(self.whole.docs + p.docs, self.whole.word + p.word, self.whole.gram + p.gram)
        self.ratios = [(self.whole - p).ratios() for p in parts]
        self.fixed = [fixed_inputs(self.shapes, r) for r in self.ratios]

    def _of(self, which: np.ndarray) -> Shapes:
        grams = []
        for ids, owner in self.shapes.grams:
            first = np.searchsorted(owner, which)
            count = np.searchsorted(owner, which, "right") - first
            upto = np.cumsum(count)
            picked = np.repeat(first - (upto - count), count) + np.arange(upto[-1] if len(upto) else 0)
            grams.append((ids[picked], owner[picked]))
        return Shapes(self.shapes.word[which], grams)

    def batch(self, windows: list[tuple[int, int]]) -> tuple:
        """Index and mask of the windows, and for the words in them fixed inputs and embedding rows; one part's windows."""
        cut = [self.docs[i][a : a + WINDOW] for i, a in windows]
        width = max(map(len, cut))
        mask = np.arange(width) < np.array([len(c) for c in cut])[:, None]
        index = np.zeros(mask.shape, "i8")
        which, index[mask] = np.unique(np.concatenate(cut), return_inverse=True)
        return index, mask, self.fixed[windows[0][0] % PARTS][which], *self.shapes.take(which)


def _by_part(windows: list[tuple[int, int]], size: int) -> Iterator[list[tuple[int, int]]]:
    for part in range(PARTS):
        own = [w for w in windows if w[0] % PARTS == part]
        for a in range(0, len(own), size):
            yield own[a : a + size]


def train(texts: Sequence[str], labels: Sequence[int], seed: int = 7, most_windows: int | None = MOST_WINDOWS) -> Model:
    """A model from labelled texts. Word and n-gram ratios that a training document meets come from the other parts of the
    documents, so the network learns how far they carry over; scoring uses those of all."""
    y = np.array(labels, "i8")
    network, rng, adam = Network(seed), np.random.default_rng(seed), _Adam()
    corpus = _Corpus(texts, y)
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 9)))
    if len(set(labels)) < 2:
        return Model(network, corpus.whole.ratios(), -np.inf if y.any() else np.inf, 0.0, -2.0, most_windows)
    windows = []
    for i, own in enumerate(corpus.docs):
        windows += [(i, s) for s in starts(len(own))]
    positive, negative = [w for w in windows if y[w[0]]], [w for w in windows if not y[w[0]]]
    best: dict[int, int] = {}
    for epoch in range(EPOCHS):
        # A toxic document teaches by the window that looks most toxic so far, clean ones by all of their windows.
        chosen = [w for w in positive if best.get(w[0], w[1]) == w[1]]
        chosen += negative
        batches = list(_by_part([chosen[k] for k in rng.permutation(len(chosen))], BATCH))
        for k in rng.permutation(len(batches)):
            _descend(network, adam, corpus, batches[k], y, RATE / (1 + epoch))
        top: dict[int, float] = {}
        for part in _by_part(positive, 1024):
            index, mask, *words = corpus.batch(part)
            logit = network.pool(network.states(index, mask, network.rows(network.inputs(*words))), mask)[0]
            for (i, a), v in zip(part, logit.tolist(), strict=True):
                if v > top.get(i, -np.inf):
                    top[i], best[i] = v, a
    return Model(network, corpus.whole.ratios(), *_cut(network, corpus.ratios, texts, y, most_windows), min(-0.5, prior), most_windows)


def _descend(network: Network, adam: _Adam, corpus: _Corpus, windows: list[tuple[int, int]], y: np.ndarray, rate: float) -> float:
    """One descent step on a batch of windows; the loss before it."""
    index, mask, fixed, at_word, at_char, owner = corpus.batch(windows)
    x = network.inputs(fixed, at_word, at_char, owner)
    loss, g, dx = network.gradients(index, mask, y[[i for i, _ in windows]].astype("f4"), x)
    adam.update(network.p, g, rate)
    count = np.maximum(np.bincount(owner, minlength=len(x)), 1)[:, None]
    adam.rows(network.p, "word", at_word, dx[:, N_FIXED : N_FIXED + EMBED], VECTOR_RATE)
    adam.rows(network.p, "char", at_char, (dx[:, N_FIXED + EMBED :] / count)[owner], VECTOR_RATE)
    return loss


def _cut(network: Network, ratios: list, texts: Sequence[str], y: np.ndarray, most_windows: int | None) -> tuple[float, float]:
    """Cut and slope that part the classes best over whole documents, each scored with the other parts' ratios: the cut is
    midway between the neighbours where the mean of both classes' accuracies is highest."""
    logit, many = np.empty(len(y)), np.array([weighing(len(starts(len(words_of(t)))), most_windows) for t in texts])
    for part in range(PARTS):
        own = np.arange(part, len(y), PARTS)
        logit[own] = Scorer(Model(network, ratios[part], 0.0, 0.0, 0.0, most_windows)).logits([texts[i] for i in own])
    seen = np.isfinite(logit)
    best = (-1.0, 0.0, 0.0)
    for slope in SLOPES if seen.any() else ():
        value = (logit - slope * np.log(many))[seen]
        order = np.argsort(value, kind="stable")
        v, t = value[order], y[seen][order]
        below_toxic, below_clean = np.concatenate([[0], np.cumsum(t)]), np.concatenate([[0], np.cumsum(1 - t)])
        gain = (t.sum() - below_toxic) / max(1, t.sum()) + below_clean / max(1, len(t) - t.sum())
        edges = np.concatenate([[v[0] - 1], (v[1:] + v[:-1]) / 2, [v[-1] + 1]])
        if gain.max() > best[0] + 1e-9:
            best = float(gain.max()), float(edges[np.flatnonzero(gain >= gain.max() - 1e-12)].mean()), slope
    return best[1:]


def fold(doc_id: str) -> Column:
    return F.pmod(F.crc32(col(doc_id).cast("string")), F.lit(FOLDS))


def _chosen(rows: list, sample: int, sample_bytes: int) -> list[str]:
    """Keys of the first rows of either class, in their order, that fit the bytes; one of either class at least."""
    out, room = [], sample_bytes // 2
    for toxic in (0, 1):
        left = room
        for i, r in enumerate(r for r in rows if r["toxic"] == toxic):
            if i < sample and (not i or r["bytes"] <= left):
                out.append(r["key"])
                left -= r["bytes"]
    return out


def learn(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", sample_bytes: int = SAMPLE_BYTES, most_windows: int | None = MOST_WINDOWS,
) -> Model:
    """A model from up to ``sample`` labelled documents of each class, chosen by a hash of the id outside the held-out
    fold, whose texts have ``sample_bytes`` at most, half of it a class: a text that no longer fits is passed over. ``most_windows`` is the model's.

    Null labels and ids are left out; an id with several labels counts as toxic if one says so, an id with several texts teaches by the
    least of them, so that a repeated id brings one row to the driver. Without labels or documents, as in empty tables, the model gives
    every text the score of its prior."""
    known = labels.where(col("toxic").isNotNull() & col(doc_id).isNotNull() & (fold(doc_id) != HELD_OUT))
    one = known.groupBy(col(doc_id).alias("id")).agg(F.max("toxic").alias("toxic"))
    ordered = [one.where(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(sample) for k in (0, 1)]
    picked = F.broadcast(ordered[0].unionByName(ordered[1]))  # 2 * sample rows
    bare = docs.where(fold(doc_id) != HELD_OUT).select(col(doc_id).alias("id"), col(text).alias("text")).where("text is not null")
    least = bare.join(picked, "id").groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    key = F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("key")
    sizes = least.select(key, F.xxhash64("id").alias("turn"), "toxic", F.octet_length("text").alias("bytes")).collect()  # no texts yet
    wanted = _chosen(sorted(sizes, key=lambda r: (r["turn"], r["key"])), sample, sample_bytes)
    kept = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in wanted], "key string"))  # 2 * sample rows
    rows = sorted((r["id"], r["text"], r["toxic"]) for r in least.withColumn("key", key).join(kept, "key", "left_semi").collect())
    return train([t for _, t, _ in rows], [int(y) for *_, y in rows], most_windows=most_windows)


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", score: str = "score") -> DataFrame:
    """docs with the score of each whole text. A text without a word (null, empty) gets the prior's score, below 0.5. Repeated
    rows score alike; very long texts are scored over all their windows; an empty table stays empty, other columns stay."""
    arrow_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = batch.column(at)
            found = [scorer.scores(texts.slice(a, b - a).to_pylist()) for a, b in slices(texts)]
            yield batch, [pa.array(np.concatenate(found) if found else np.zeros(0))]

    return append_columns(docs, run, [T.StructField(score, T.DoubleType())])


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document, repeated rows each on its own.

    A null id is in no fold (held_out is null) and teaches nothing; a null text scores as an empty one. An empty table gives
    no rows, one without labels scores of the prior; very long texts are scored whole; other columns are not read.
    """
    scored = score_documents(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select("doc_id", (fold("doc_id") == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
