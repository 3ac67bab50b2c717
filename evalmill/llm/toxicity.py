"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A word enters the network as two vectors: one for the word itself and one that
averages its character n-grams.  Texts are cut into overlapping windows; each
window's states are pooled by attention and give one logit, and a text scores as
its worst window does.  Everything is numpy: training (on a bounded sample) and
scoring (inside Spark's tasks), which caches the gate inputs of words met lately.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_sample, logistic
from .shared import written

WINDOW, STRIDE = 24, 18
DIM, HIDDEN = 8, 8
GRAMS, GRAM_SPACE = (3, 4, 5), 1 << 22
LEAST_TEXTS = 12  # a word or n-gram in fewer texts has no vector of its own; less where there are few texts
PER_CLASS, CALIBRATE, EPOCHS = 1500, 2500, 6  # labelled rows of a class to learn from, more of the clean ones to calibrate on
LEARN_BYTES = 64 << 20  # text to train on, half of it for each class
CACHED_WORDS = 200_000
LONGEST = 40  # bytes of a word; a longer run between ASCII white space becomes several words
PIECE = 12  # bytes of the pieces of what is still longer, each half over the one before, so about as many words as ordinary text has

#: What parts the words of a long run beside white space: ASCII and general punctuation, that of wide scripts, and the commonest of others.
_PARTED = re.compile(r"[\s\x00-/:-@\[-`{-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\u055a-\u055f\u0589\u05be\u060c\u061b\u061f\u066a-\u066d\u06d4\u0964\u0965\u104a\u104b\u1361-\u1368\u200b\u200e-\u206f\u2e00-\u2e7f\u3000-\u3003\u3008-\u3020\u3030\u30fb\ufe30-\ufe6b\ufeff\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]+")


def _pieces(run: bytes) -> list[bytes]:
    """``run``, or overlapping pieces of it where it is longer than ``LONGEST``; each n-gram is whole in one of them."""
    if len(run) <= LONGEST:
        return [run]
    return [run[i : i + PIECE] for i in range(0, len(run) - PIECE, PIECE // 2)] + [run[-PIECE:]]


def _words_of_run(run: bytes) -> list[bytes]:
    """Words of a long run: those between its Unicode spaces; where one is still long, those between
    its punctuation, and then pieces of it with the punctuation, so that no bytes go unseen."""
    out = []
    for word in run.decode("utf-8", "surrogatepass").split():
        whole = word.encode("utf-8", "surrogatepass")
        parts = [w.encode("utf-8", "surrogatepass") for w in _PARTED.split(word) if w]
        if len(whole) > LONGEST and parts != [whole]:
            out += [piece for part in parts for piece in _pieces(part)]
        out += _pieces(whole)
    return out


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words between white space, none longer than ``LONGEST`` bytes."""
    words = text.lower().encode("utf-8", "surrogatepass").split() if text else []
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [w for word in words for w in (_words_of_run(word) if len(word) > LONGEST else (word,))]


def gram_codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams of ``<word>`` in bytes, which of them are there), both (words, places)."""
    shown = [b"<" + w + b">" for w in words]
    sizes = np.fromiter(map(len, shown), np.int64, len(shown))
    wide = int(sizes.max(initial=0)) + max(GRAMS)
    codes = np.frombuffer(b"".join(s.ljust(wide, b"\0") for s in shown), np.uint8).reshape(len(shown), wide).astype(np.uint64)
    out, there = [], []
    for n in GRAMS:
        h = np.full((len(shown), wide - max(GRAMS)), np.uint64(n * 0x9E3779B1), np.uint64)
        for j in range(n):
            h = (h ^ codes[:, j : j + h.shape[1]]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(23)
        out.append((h % np.uint64(GRAM_SPACE)).astype(np.int32))
        there.append(np.arange(h.shape[1])[None, :] + n <= sizes[:, None])
    return np.concatenate(out, axis=1), np.concatenate(there, axis=1)


class Vocabulary:
    """The words and character n-grams that have vectors; number 0 is the null vector of all others."""

    def __init__(self, words: list[bytes], grams: np.ndarray):
        self.words = {w: i + 1 for i, w in enumerate(words)}
        self.grams = grams
        self._map: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_map": None}

    def word_numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((self.words.get(w, 0) for w in words), np.int64, len(words))

    def gram_numbers(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ends, numbers, weights): the known n-grams of each word, one after the other."""
        if self._map is None:
            self._map = np.zeros(GRAM_SPACE, np.int32)
            self._map[self.grams] = np.arange(1, len(self.grams) + 1)
        codes, there = gram_codes(words)
        numbers = np.where(there, self._map[codes], 0)
        known = numbers > 0
        count = known.sum(axis=1)
        weight = (1 / np.maximum(there.sum(axis=1), 1)).astype(np.float32)
        return np.cumsum(count), numbers[known], np.repeat(weight, count)


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows up to each end."""
    total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)])
    return (total[ends] - total[np.concatenate([[0], ends[:-1]])]).astype(np.float32)


def _by_number(numbers: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct numbers, sums of their rows)."""
    order = np.argsort(numbers, kind="stable")
    numbers = numbers[order]
    first = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
    return numbers[first], np.add.reduceat(values[order], first, axis=0)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Network:
    vocabulary: Vocabulary
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, vocabulary: Vocabulary, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        r = lambda *s, k=0.3: rng.normal(0, k, s).astype(np.float32)
        p = {"word": r(len(vocabulary.words) + 1, DIM, k=0.1), "gram": r(len(vocabulary.grams) + 1, DIM), "att": r(2 * HIDDEN, HIDDEN), "pick": r(HIDDEN), "out": r(2 * HIDDEN), "bias": np.array([-1.0], np.float32)}
        p["word"][0] = p["gram"][0] = 0
        for d in "fb":
            p |= {f"W{d}": r(2 * DIM, 3 * HIDDEN), f"U{d}": r(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        return cls(vocabulary, p)

    def vectors(self, words: list[bytes]) -> np.ndarray:
        ends, numbers, weights = self.vocabulary.gram_numbers(words)
        grams = _sums(self.p["gram"][numbers] * weights[:, None], ends)
        return np.concatenate([self.p["word"][self.vocabulary.word_numbers(words)], grams], axis=1)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What both directions' gates get from a word, whatever the state."""
        return np.concatenate([x @ self.p["Wf"] + self.p["cf"], x @ self.p["Wb"] + self.p["cb"]], axis=-1)

    def _direction(self, g: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (T, N, H) of one direction; padded places leave the state as it is."""
        T, N, H = *g.shape[:2], HIDDEN
        U, h = self.p[f"U{d}"], np.zeros((g.shape[1], HIDDEN), np.float32)
        states = np.empty((T, N, H), np.float32)
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            zr = _sigmoid(g[t, :, : 2 * H] + h @ U[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            cand = np.tanh(g[t, :, 2 * H :] + (r * h) @ U[:, 2 * H :])
            step = mask[t, :, None] * z
            if keep is not None:
                keep.append((t, h, z, r, cand, step))
            h = h + step * (cand - h)
            states[t] = h
        return states

    def logits(self, g: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """One logit for each window; g (T, N, 6H), mask (T, N)."""
        s = np.concatenate([self._direction(g[..., : 3 * HIDDEN], mask, "f"), self._direction(g[..., 3 * HIDDEN :], mask, "b")], axis=2)
        e = np.where(mask > 0, np.tanh(s @ self.p["att"]) @ self.p["pick"], -1e9)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        return np.einsum("tn,tnh,h->n", a, s, self.p["out"], optimize=True) + self.p["bias"][0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of the weighted log-loss: for the parameters, and for the inputs x (T, N, 2D)."""
        p, H, g = self.p, HIDDEN, {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("word", "gram")}
        kept: dict[str, list] = {"f": [], "b": []}
        gate = {d: x @ p[f"W{d}"] + p[f"c{d}"] for d in "fb"}
        s = np.concatenate([self._direction(gate[d], mask, d, kept[d]) for d in "fb"], axis=2)
        u = np.tanh(s @ p["att"])
        e = np.where(mask > 0, u @ p["pick"], -1e9)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        v = s @ p["out"]
        logit = (a * v).sum(axis=0) + p["bias"][0]
        dl = (_sigmoid(logit) - y) * weight
        g["bias"][0] = dl.sum()
        g["out"] = np.einsum("tn,tnh,n->h", a, s, dl, optimize=True)
        de = a * (v - (a * v).sum(axis=0)) * dl
        du = de[..., None] * p["pick"] * (1 - u * u)
        g["pick"] = np.einsum("tn,tnh->h", de, u)
        g["att"] = np.einsum("tni,tnj->ij", s, du)
        ds = (a * dl)[..., None] * p["out"] + du @ p["att"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            U, dh = p[f"U{d}"], np.zeros((x.shape[1], H), np.float32)
            dgate = np.zeros(gate[d].shape, np.float32)
            for t, h, z, r, cand, step in reversed(kept[d]):
                dh = dh + ds[t, :, k * H : (k + 1) * H]
                dcand = dh * step * (1 - cand * cand)
                dz = dh * (cand - h) * mask[t, :, None] * z * (1 - z)
                drh = dcand @ U[:, 2 * H :].T
                dr = drh * h * r * (1 - r)
                dzr = np.concatenate([dz, dr], axis=1)
                g[f"U{d}"][:, : 2 * H] += h.T @ dzr
                g[f"U{d}"][:, 2 * H :] += (r * h).T @ dcand
                dh = dh * (1 - step) + drh * r + dzr @ U[:, : 2 * H].T
                dgate[t] = np.concatenate([dzr, dcand], axis=1)
            g[f"W{d}"] = np.einsum("tni,tnj->ij", x, dgate)
            g[f"c{d}"] = dgate.sum(axis=(0, 1))
            dx += dgate @ p[f"W{d}"].T
        return g, dx


def windows(n: int, width: int = WINDOW, stride: int = STRIDE) -> np.ndarray:
    """Places (windows, width) of all overlapping windows over ``n`` words; -1 pads the last."""
    starts = np.arange(0, max(1, n - width + stride), stride)
    at = starts[:, None] + np.arange(width)
    return np.where(at < n, at, -1)


class Trainer:
    """Adam on all windows of whole texts, with documents' labels: a toxic text needs one window that shows it."""

    def __init__(self, texts: list[str], labels: list[int], seed: int = 7):
        self.rng = np.random.default_rng(seed)
        index: dict[bytes, int] = {}
        places, owners, texts_of = [], [], []
        for i, text in enumerate(texts):
            words = words_of(text)
            at = windows(len(words))
            ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int32, len(words))
            texts_of.append(np.unique(ids))
            places.append(np.where(at >= 0, np.concatenate([ids, [0]])[at], -1).astype(np.int32))
            owners.append(np.full(len(at), i))
        self.words = list(index)
        self.at, self.owner, self.y = np.concatenate(places), np.concatenate(owners), np.array(labels, np.float32)
        in_texts = np.bincount(np.concatenate(texts_of), minlength=len(self.words))
        seen = np.zeros(GRAM_SPACE, np.int32)
        for i in range(0, len(self.words), 8192):
            codes, there = gram_codes(self.words[i : i + 8192])
            np.add.at(seen, codes[there], np.repeat(in_texts[i : i + 8192], there.sum(axis=1)).astype(np.int32))
        least = int(np.clip(sum(labels) // 100, 3, LEAST_TEXTS))
        self.vocabulary = Vocabulary([w for w, n in zip(self.words, in_texts) if n >= least], np.flatnonzero(seen >= least))
        self.net = Network.fresh(self.vocabulary, seed)
        self.word = self.vocabulary.word_numbers(self.words)
        ends, numbers, weights, base = [], [], [], 0
        for i in range(0, len(self.words), 8192):
            e, n, w = self.vocabulary.gram_numbers(self.words[i : i + 8192])
            ends.append(e + base)
            numbers.append(n.astype(np.int32))
            weights.append(w)
            base += len(n)
        self.ends, self.gram, self.weight = np.concatenate(ends), np.concatenate(numbers), np.concatenate(weights)
        self.moments: dict[str, list] = {}

    def _grams(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start = np.where(ids > 0, self.ends[ids - 1], 0)
        count = self.ends[ids] - start
        ends = np.cumsum(count)
        at = np.arange(ends[-1]) + np.repeat(start - (ends - count), count)
        return ends, self.gram[at], self.weight[at]

    def _inputs(self, ids: np.ndarray) -> np.ndarray:
        ends, numbers, weights = self._grams(ids)
        return np.concatenate([self.net.p["word"][self.word[ids]], _sums(self.net.p["gram"][numbers] * weights[:, None], ends)], axis=1)

    def _adam(self, name: str, grad: np.ndarray, rate: float, rows=None) -> None:
        m, v = self.moments.setdefault(name, [np.zeros_like(self.net.p[name]), np.zeros_like(self.net.p[name])])
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.99 * v[at] + 0.01 * grad * grad
        self.net.p[name][at] -= rate * m[at] / (np.sqrt(v[at]) + 1e-8)

    def step(self, picked: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float) -> None:
        at = self.at[picked].T
        mask = (at >= 0).astype(np.float32)
        ids, inverse = np.unique(at[at >= 0], return_inverse=True)
        if not len(ids):
            return
        x0 = self._inputs(ids)
        whole = self.rng.random(len(ids)) < 0.5  # half of the words show only their characters
        x0[~whole, :DIM] = 0
        x = np.zeros((*at.shape, 2 * DIM), np.float32)
        x[at >= 0] = x0[inverse]
        grads, dx = self.net.gradients(x, mask, y, weight)
        for name, grad in grads.items():
            self._adam(name, grad, rate)
        rows, flat = _by_number(inverse, dx[at >= 0])
        known = whole & (self.word[ids] > 0)
        if known.any():
            numbers, to = _by_number(self.word[ids][known], flat[known, :DIM])
            self._adam("word", to + 1e-4 * self.net.p["word"][numbers], rate, numbers)
        ends, numbers, weights = self._grams(ids)
        if len(numbers):
            owner = np.repeat(np.arange(len(ids)), np.diff(ends, prepend=0))
            numbers, to = _by_number(numbers, weights[:, None] * flat[owner, DIM:])
            self._adam("gram", to + 1e-5 * self.net.p["gram"][numbers], rate, numbers)

    def scores(self) -> np.ndarray:
        """The logit of each window as the network stands."""
        gates = np.concatenate([self.net.gates(self._inputs(np.arange(i, min(i + 8192, len(self.words))))) for i in range(0, len(self.words), 8192)] + [np.zeros((1, 6 * HIDDEN), np.float32)])
        return np.concatenate([self.net.logits(gates[a], (a >= 0).astype(np.float32)) for a in (self.at[i : i + 2048].T for i in range(0, len(self.at), 2048))])

    def fit(self) -> Network:
        toxic = self.y[self.owner] > 0
        batch = 256 if len(self.at) > 20_000 else 64
        epochs = int(np.clip(300_000 // len(self.at), EPOCHS, 40))
        for epoch in range(epochs):
            weight = np.ones(len(self.owner), np.float32)
            if epoch == 0:
                count = np.bincount(self.owner, minlength=len(self.y))
                picked, weight = np.arange(len(self.owner)), np.where(toxic, 1 / count[self.owner], 0.3).astype(np.float32)
            else:
                got = self.scores()
                worst = np.full(len(self.y), -np.inf)
                np.maximum.at(worst, self.owner, got)
                shows = toxic & (got >= worst[self.owner])
                clean = ~toxic & ((got > -5) | (self.rng.random(len(got)) < 0.15))
                picked = np.flatnonzero(shows | clean)
            self.rng.shuffle(picked)
            for i in range(0, len(picked), batch):
                part = picked[i : i + batch]
                self.step(part, self.y[self.owner[part]], weight[part] / len(part), 0.02 if epoch < epochs // 2 else 0.006)
        return self.net


@dataclass
class ToxicityModel:
    net: Network
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None


def _over(rows: list[tuple[int, int]], last: int, most: int) -> list[int]:
    """Of rows (place, bytes) up to the place ``last``, those that do not fit into ``most`` bytes beside the ones before."""
    held, over = 0, []
    for place, size in rows:
        if place > last:
            break
        if held + size > most:
            over.append(place)
        else:
            held += size
    return over


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, eligible: F.Column | None = None, per_class: int = PER_CLASS, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", learn_bytes: int = LEARN_BYTES
) -> ToxicityModel:
    """Trains on at most ``per_class`` labelled rows of either class, with their whole texts.

    A sixth of them and up to ``CALIBRATE`` more rows that are not toxic turn
    logits into probabilities; they are scored in Spark's tasks.  Without rows of
    both classes every score is the share of toxic rows, or 0.  An id with two
    labels counts as toxic; null and empty texts are one empty window.  The rows
    to train on hold ``learn_bytes`` of text at most: in the order of their
    hashes, one that no longer fits is passed over.
    """
    eligible = F.lit(True) if eligible is None else eligible
    sample = written(labelled_sample(docs, labels, label, eligible, (per_class + CALIBRATE, per_class), id_col, text_col), "sample")
    sizes = {c: sorted((r.place, r.size) for r in sample.where(F.col("y") == c).select("place", F.octet_length("text").alias("size")).collect()) for c in (0, 1)}
    places = {c: [place for place, _ in of] for c, of in sizes.items()}
    if not places[0] or not places[1]:
        return ToxicityModel(Network.fresh(Vocabulary([], np.empty(0, np.int64))), constant=float(bool(places[1])))
    last = {c: of[max(min(per_class, len(of)) * 5 // 6, 1) - 1] for c, of in places.items()}
    over = [place for c, of in sizes.items() for place in _over(of, last[c], learn_bytes // 2)]
    learns = (F.col("place") <= F.when(F.col("y") == 0, last[0]).otherwise(last[1])) & ~F.col("place").isin(over)
    learn = sample.where(learns).select("text", "y", "place").orderBy("place", "y").collect()
    if len({r.y for r in learn}) < 2:
        return ToxicityModel(Network.fresh(Vocabulary([], np.empty(0, np.int64))), constant=len(places[1]) / len(places[0] + places[1]))
    net = Trainer([r.text for r in learn], [r.y for r in learn]).fit()
    rest = sample.where(~learns).select(F.col("y").cast("long").alias("id"), "text").mapInArrow(_score_rows(ToxicityModel(net), True), "id long, score double").toPandas()
    worst, held = rest["score"].to_numpy(float), rest["id"].to_numpy(float)
    if not 0 < held.sum() < len(held):
        return ToxicityModel(net)
    slope, offset, _ = logistic(np.clip(worst, -12, 12), held)
    # the sample holds the classes in other shares than the labels do
    totals = {r.y: r["count"] for r in labels.where(eligible & F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("y")).count().collect()}
    offset += float(np.log(max(totals.get(1, 1), 1) / max(totals.get(0, 1), 1)) - np.log(held.sum() / (len(held) - held.sum())))
    return ToxicityModel(net, slope, offset) if slope > 0 else ToxicityModel(net)


class Scorer:
    """Worst window of texts; keeps the gate inputs of words met lately."""

    def __init__(self, net: Network):
        self.net = net
        self._clear()

    def _clear(self) -> None:
        outer = self

        class Places(dict):
            def __missing__(self, word: bytes) -> int:
                place = self[word] = len(self)
                outer.fresh.append(word)
                return place

        self.places, self.fresh = Places(), []
        self.table, self.held = np.zeros((1024, 6 * HIDDEN), np.float32), 0

    def _learn(self) -> None:
        need = self.held + len(self.fresh)
        if need > len(self.table):
            grown = np.zeros((max(need, 2 * len(self.table)), 6 * HIDDEN), np.float32)
            grown[: self.held] = self.table[: self.held]
            self.table = grown
        for i in range(0, len(self.fresh), 4096):
            part = self.fresh[i : i + 4096]
            self.table[self.held : self.held + len(part)] = self.net.gates(self.net.vectors(part))
            self.held += len(part)
        self.fresh = []

    def worst(self, texts: list[str | None]) -> np.ndarray:
        """The largest window logit of each text."""
        if len(self.places) > CACHED_WORDS:
            self._clear()
        at, owner, base = [], [], 0
        ids = []
        for i, text in enumerate(texts):
            w = words_of(text)
            ids.append(np.fromiter(map(self.places.__getitem__, w), np.int64, len(w)))
            places = windows(len(w))
            at.append(np.where(places >= 0, places + base, -1))
            owner.append(np.full(len(places), i))
            base += len(w)
        if self.fresh:
            self._learn()
        ids, at, owner = np.concatenate([*ids, [0]]).astype(np.int64), np.concatenate(at), np.concatenate(owner)
        out = np.full(len(texts), -np.inf)
        for i in range(0, len(at), 2048):
            a = at[i : i + 2048].T
            got = self.net.logits(self.table[ids[a]], (a >= 0).astype(np.float32))
            np.maximum.at(out, owner[i : i + 2048], got)
        return out


def _score_rows(model: ToxicityModel, as_logits: bool = False):
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.net)
        for batch in batches:
            out, texts, held = [], [], 0
            column = batch.column("text")
            for k, text in enumerate(column):
                texts.append(text.as_py())
                held += len(texts[-1] or "")
                if held > 1 << 20 or k == len(column) - 1:
                    if model.constant is None:
                        worst = scorer.worst(texts)
                        out.append(worst if as_logits else _sigmoid(np.clip(model.slope * np.clip(worst, -12, 12) + model.offset, -30, 30)))
                    else:
                        out.append(np.full(len(texts), model.constant))
                    texts, held = [], 0
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(out) if out else np.empty(0))], schema=schema)

    return run


def toxicity_scores(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row: the probability that its worst window shows.

    Every word of every text is scored, in overlapping windows; runs of more
    than ``LONGEST`` bytes without white space are scored as several words.  Defined
    cases: null and empty texts are one empty window; repeated and null ids each
    keep their row; other columns are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_score_rows(model), "id long, score double").withColumnRenamed("id", id_col)
