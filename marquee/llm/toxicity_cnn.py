"""Toxicity classifier: hashed word embeddings, filters of several widths and max pooling, trained in numpy.

A word (a run of letters, A-Z as a-z) is the sum of the vectors of its hash and of the hashes of its first bytes, so
inflected forms share strength. The first coordinate of a vector starts as the log-odds of its hash in one half of the
training texts, 0 where fewer than three hold it; all coordinates, filters and weights learn on the other half. Then the
log-odds are those of all texts, with what was learned added. Thresholds come from the half that did not train; they are
calibrated by the text's language, as byte context trees learned from the sample's texts tell it: each language's cut is
moved to 0.3. A language with fewer than LEAST_TEXTS texts or LEAST_TOXIC toxic ones among them has the cut of all texts.

Nulls: a null text is an empty one; a text without words gets the network's bias. Labels other than 0 and 1 train
nothing; with one class or none in the sample every score is that class's share (0 without rows). Repeated rows stay; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches
from .langid_ppm import Scorer, counted
from .textvec import _LOWER, U64, in_chunks, mix, span_hashes
from .training import Adam, best_cut, calibrated, logistic, sample

TABLE, DIM = 1 << 18, 6
WIDTHS, FILTERS = (1, 2, 3), 8
BEGINNINGS = (5, 6, 7)  # bytes of a word that are hashed besides the whole
EPOCHS, BATCH, PRIOR, FOLDS = 6, 16, 4.0, 5
EMBED_RATE = 0.5  # of a plain step, falling with Adam's rate
CUT = 0.3

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
LEAST_TEXTS, LEAST_TOXIC = 40, 8
#: Blocks of UTF-8 without letters: (lead byte, second bytes, bytes of a character): U+0080-00BF, U+2000-207F, U+3000-303F
NO_LETTERS = ((0xC2, range(0x80, 0xC0), 2), (0xE2, (0x80, 0x81), 3), (0xE3, (0x80,), 3))


def word_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers in the table of each word: whole and beginnings, words before each text)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b"\0".join([b"", *raw, b""]), dtype=np.uint8)
    edges = np.cumsum([1, *(len(t) + 1 for t in raw)])
    letter = _LETTER[b]
    for lead, seconds, n in NO_LETTERS:
        at = np.flatnonzero(b == lead)
        at = at[np.isin(b[at + 1], seconds)]  # a lead byte is never the last
        for i in range(n):
            letter[at + i] = False
    start, end = np.flatnonzero(~letter[:-1] & letter[1:]) + 1, np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
    low = _LOWER[b]
    ids = np.stack([(mix(span_hashes(low, start, np.minimum(end, start + n)) + U64(n)) >> U64(46)).astype(np.int64) for n in (64, *BEGINNINGS)], axis=1)
    return ids, np.searchsorted(start, edges)


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {"embed": rng.normal(0, 0.05, (TABLE, DIM)), "out": np.abs(rng.normal(0, 0.3, FILTERS * len(WIDTHS))), "bias": np.zeros(1)}
        for w in WIDTHS:
            f = rng.normal(0, 0.3, (w * DIM, FILTERS))
            f[::DIM] = np.abs(f[::DIM])  # log-odds speak for the label at first
            self.p[f"filters{w}"], self.p[f"offset{w}"] = f, np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.constant: float | None = None
        self.trees = counted([], [])
        self.cuts = np.full(1, 0.5)  # of all texts, then of each language

    def _vectors(self, ids: np.ndarray) -> np.ndarray:
        """A word's vector; a row of zeros after a text's last words lets wide filters see its end."""
        x = self.p["embed"][ids[:, 0]]
        for j in range(1, ids.shape[1]):
            x = x + self.p["embed"][ids[:, j]]
        return np.concatenate([x, np.zeros((max(WIDTHS), DIM), np.float32)])

    def _pooled(self, x: np.ndarray, n: int):
        """(pooled filters before the rectifier, words they stood at) of one text."""
        top, at = [], []
        for w in WIDTHS:
            f = self.p[f"filters{w}"]
            h = sum(x[j : j + max(n, 1)] @ f[j * DIM : (j + 1) * DIM] for j in range(w)) + self.p[f"offset{w}"]
            best = h.argmax(0)
            top.append(h[best, np.arange(FILTERS)])
            at.append(best)
        return np.concatenate(top), at

    def raw(self, texts: list[str]) -> np.ndarray:
        ids, cut = word_ids(texts)
        z = np.stack([self._pooled(self._vectors(ids[a:b]), b - a)[0] for a, b in zip(cut[:-1], cut[1:], strict=True)]) if texts else np.zeros((0, FILTERS * len(WIDTHS)))
        return logistic(np.maximum(z, 0) @ self.p["out"] + self.p["bias"])

    def groups(self, texts: list[str], scorer: Scorer | None = None) -> np.ndarray:
        """The number of each text's language, from 1; 0 where none is learned."""
        if not self.trees.languages:
            return np.zeros(len(texts), dtype=np.int64)
        scorer = scorer or Scorer(self.trees)
        return np.concatenate([1 + scorer.bits(texts[a:b])[0].argmin(1) for a, b in in_chunks(texts)] or [np.empty(0, np.int64)])

    def score(self, texts: list[str], scorer: Scorer | None = None) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return np.clip(calibrated(self.raw(texts).astype(np.float64), self.cuts[self.groups(texts, scorer)], CUT), 0, 1)

    def fit(self, texts: list[str], y: np.ndarray, seed: int = 3, weight: np.ndarray | None = None, langs: list[str | None] | None = None):
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.0
            return self
        weight = np.ones(len(y)) if weight is None else weight
        share = np.average(y, weights=weight)
        rng = np.random.default_rng(seed)
        parts = [word_ids(texts[a:b]) for a, b in in_chunks(texts)]
        ids = np.concatenate([p[0].astype(np.int32) for p in parts])
        cut = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))])
        self.trees = counted(texts, langs or [None] * len(texts))
        group = self.groups(texts)
        half = rng.permutation(len(y)) % 2 == 0
        half = half if 0 < y[half].sum() < y.sum() else np.ones(len(y), bool)
        self._start(ids, cut, y, half)
        start = self.p["embed"].copy()
        learn = np.flatnonzero(~half) if not half.all() else np.arange(len(y))
        adam = Adam({k: v for k, v in self.p.items() if k != "embed"}, 0.02)
        self.p["bias"][0] = np.log(max(share, 1e-3) / (1 - share))
        epochs = max(EPOCHS, min(40, 12_000 // len(learn)))
        for epoch in range(epochs):
            adam.rate = 0.02 * (1 - epoch / epochs) + 0.001
            order = rng.permutation(learn)
            for a in range(0, len(order), BATCH):
                self._learn(adam, order[a : a + BATCH], ids, cut, y, weight, share)
        learned = self.p["embed"][:, 0] - start[:, 0]
        self._start(ids, cut, y, np.ones(len(y), bool))  # with the network learned, all texts' odds count
        self.p["embed"][:, 0] += learned
        # Cuts come from texts whose own words the odds leave out, a fifth of them at a time, and that embeddings did not learn from.
        final, got, part = self.p["embed"], np.empty(len(y)), rng.permutation(len(y)) % FOLDS
        judged = half
        for k in range(FOLDS):
            self._start(ids, cut, y, part != k)
            self.p["embed"][:, 0] += learned
            rest = np.flatnonzero((part == k) & judged)
            if len(rest):
                got[rest] = self.raw([texts[i] for i in rest])
        self.p["embed"] = final
        whole = best_cut(got[judged], y[judged], weight_false=2.0, weight=weight[judged])
        self.cuts = np.full(1 + len(self.trees.languages), whole)
        for g in range(1, len(self.cuts)):
            own = (group == g) & judged
            if own.sum() >= LEAST_TEXTS and y[own].sum() >= LEAST_TOXIC:
                self.cuts[g] = best_cut(got[own], y[own], weight_false=2.0, default=whole, weight=weight[own])
        return self

    def _start(self, ids, cut, y, rows):
        """First coordinates: log-odds of each hash among the texts of rows; 0 for what fewer than three of them hold."""
        pos, neg = np.zeros(TABLE, np.int64), np.zeros(TABLE, np.int64)
        for i in np.flatnonzero(rows):
            (pos if y[i] == 1 else neg)[np.unique(ids[cut[i] : cut[i + 1]])] += 1
        n_pos, n_neg = max((y[rows] == 1).sum(), 1), max((y[rows] == 0).sum(), 1)
        # Odds are relative to the sample's share, and so is the prior: class weights would cancel out.
        share = n_pos / (n_pos + n_neg)  # as PRIOR texts more of the usual share: what few texts hold says little
        odds = np.log((pos + PRIOR * share) / (neg + PRIOR * (1 - share))) - np.log(share / (1 - share))
        self.p["embed"] = self.p["embed"].copy()
        self.p["embed"][:, 0] = np.where(pos + neg >= 3, np.clip(odds, -4, 6), 0) / 4

    def _learn(self, adam, rows, ids, cut, y, weight, share):
        grads = {k: np.zeros_like(v) for k, v in self.p.items() if k != "embed"}
        touched, steps = [], []
        for i in rows:
            own_ids = ids[cut[i] : cut[i + 1]]
            x = self._vectors(own_ids)
            z, at = self._pooled(x, int(cut[i + 1] - cut[i]))
            live = np.maximum(z, 0)
            error = (logistic(live @ self.p["out"] + self.p["bias"][0]) - y[i]) * weight[i] * (0.5 / share) ** (0.5 * y[i]) / len(rows)
            grads["out"] += error * live
            grads["bias"] += error
            dz = error * self.p["out"] * (z > 0)
            for k, w in enumerate(WIDTHS):
                own = dz[k * FILTERS : (k + 1) * FILTERS]
                grads[f"offset{w}"] += own
                window = x[at[k][:, None] + np.arange(w)].reshape(FILTERS, -1)
                grads[f"filters{w}"] += (own[:, None] * window).T
                back = (own[:, None] * self.p[f"filters{w}"].T).reshape(-1, DIM)
                word = (at[k][:, None] + np.arange(w)).ravel()
                real = word < len(own_ids)
                touched.append(own_ids[word[real]])
                steps.append(back[real])
        adam.step(grads)
        # Plain steps for the rows that the pooled windows stood on: a word's vector is a sum, so each part gets its gradient.
        rows_at, back = np.concatenate(touched), np.concatenate(steps)
        for j in range(rows_at.shape[1]):
            np.add.at(self.p["embed"], rows_at[:, j], (-EMBED_RATE * adam.rate / 0.02 * back).astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Network:
    """A network from labels(doc_id, label) and docs(doc_id, text): a bounded sample of them."""
    rows = sample(docs, labels, label)
    return Network().fit(rows["text"].tolist(), rows["y"].to_numpy(np.int64), weight=rows["weight"].to_numpy(), langs=rows["lang"].tolist())


def predict(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, score for docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def make():
        network = shared.value
        scorer = Scorer(network.trees)

        def step(batch):
            yield {"doc_id": batch["doc_id"], "score": network.score([x or "" for x in batch["text"].to_pylist()], scorer).astype(float)}

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, score double")
