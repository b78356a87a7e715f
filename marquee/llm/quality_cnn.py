"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, with one channel that marks whether the four bytes here stood here a few bytes ago. Learned filters
run over the whole text; overlapping chunks of it are max-pooled, and a text's chunks are combined by mean and maximum
into one probability. The share of the label 1 among all labels sets the start; the cut for a text's class is 0.5.

Nulls: a null text is an empty one; an empty text gets the network's bias. Labels other than 0 and 1 train nothing; with
one class or none in the sample every score is that class's share (0.5 without rows). Repeated rows stay; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches
from .textvec import in_chunks
from .training import Adam, balanced, best_cut, calibrated, logistic, sample

EMBED, FILTERS, WIDTH, STRIDE = 8, 24, 8, 2
CHUNK, HOP, BLOCK = 64, 56, 8  # filter positions of a chunk, from one chunk to the next, and of what both are made of
LAGS = range(2, 40)
PAD = 48
EPOCHS, BATCH = 8, 32
CHUNKS = 32  # of a training text, about 4 KB; of a longer one, one from each of as many equal runs, drawn anew each epoch


def _bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with zeros before each text, repeat mark of each, first byte of each text, its length)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    flat = np.frombuffer(b"".join(bytes(PAD) + t for t in raw) + bytes(PAD), dtype=np.uint8)
    n = np.array([len(t) for t in raw], dtype=np.int64)
    gram = np.zeros(len(flat), dtype=np.uint32)
    for i in range(4):
        gram[: len(flat) - 3] = (gram[: len(flat) - 3] << np.uint32(8)) | flat[i : len(flat) - 3 + i]
    mark = np.zeros(len(flat), dtype=bool)
    for lag in LAGS:
        mark[lag:] |= gram[lag:] == gram[:-lag]
    return flat, mark, np.cumsum(n + PAD) - n, n


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)),
            "filters": rng.normal(0, 1 / np.sqrt(WIDTH * (EMBED + 1)), (WIDTH * (EMBED + 1), FILTERS)),
            "offset": np.zeros(FILTERS),
            "out": rng.normal(0, 0.1, 2 * FILTERS),
            "bias": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.constant: float | None = None
        self.cut = 0.5

    def _channels(self, flat: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return np.concatenate([self.p["embed"][flat], mark[..., None].astype(np.float32)], axis=-1)

    def score(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out = np.empty(len(texts))
        for a, b in in_chunks(texts):
            flat, mark, first, n = _bytes(texts[a:b])
            positions = np.maximum((n + STRIDE - 1) // STRIDE, 1)
            for i in range(b - a):
                own = slice(first[i], first[i] + positions[i] * STRIDE + WIDTH - STRIDE)
                out[a + i] = self._one(self._channels(flat[own], mark[own]), int(positions[i]))
        return calibrated(logistic(out), np.float64(self.cut), 0.5)

    def _one(self, x: np.ndarray, n: int) -> float:
        """The logit of one text of n positions, in runs of chunks so that memory stays bounded for any length."""
        units = WIDTH // STRIDE  # a filter sees so many steps of STRIDE bytes
        taps = self.p["filters"].reshape(units, -1, FILTERS).transpose(1, 0, 2).reshape(-1, units * FILTERS)
        total, most, chunks, run = np.zeros(FILTERS), np.zeros(FILTERS), 0, HOP * 400
        for a in range(0, n, run):
            m = min(n - a, run + CHUNK - HOP)
            part = x[a * STRIDE : (a + m + units - 1) * STRIDE]
            seen = part.reshape(m + units - 1, -1) @ taps
            h = sum(seen[j : j + m, j * FILTERS : (j + 1) * FILTERS] for j in range(units))
            blocks = -(-m // BLOCK)
            if m % BLOCK:
                h = np.concatenate([h, np.repeat(h[-1:], blocks * BLOCK - m, axis=0)])
            h = h.reshape(blocks, BLOCK, FILTERS).max(1)
            starts = np.arange(0, min(run, n - a), HOP) // BLOCK
            pooled = h[np.minimum(starts[:, None] + np.arange(CHUNK // BLOCK), blocks - 1)].max(1)
            pooled = np.maximum(pooled + self.p["offset"], 0)
            total += pooled.sum(0)
            most = np.maximum(most, pooled.max(0))
            chunks += len(pooled)
        return float(np.concatenate([total / chunks, most]) @ self.p["out"] + self.p["bias"][0])

    def fit(self, texts: list[str], y: np.ndarray, seed: int = 11, weight: np.ndarray | None = None):
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        own = np.ones(len(y)) if weight is None else weight
        rng, weight, share = np.random.default_rng(seed), balanced(y, own), np.average(y, weights=own)
        self.p["bias"][0] = np.log(share / (1 - share))
        flat, mark, first, n = _bytes(texts)
        positions = np.maximum((n + STRIDE - 1) // STRIDE, 1)
        adam = Adam(self.p, 0.01)
        epochs = max(EPOCHS, min(30, 12_000 // len(y)))  # small samples take more turns
        for epoch in range(epochs):
            adam.rate = 0.01 * (1 - epoch / epochs) + 0.0005
            order = rng.permutation(len(y))
            for a in range(0, len(order), BATCH):
                self._learn(adam, order[a : a + BATCH], flat, mark, first, positions, y, weight, rng)
        self.cut = best_cut(logistic(np.array([self._logit(t) for t in texts])), y, weight=own)
        return self

    def _logit(self, text: str) -> float:
        flat, mark, first, n = _bytes([text])
        k = int(max((n[0] + STRIDE - 1) // STRIDE, 1))
        return self._one(self._channels(flat, mark)[first[0] : first[0] + k * STRIDE + WIDTH - STRIDE], k)

    def _learn(self, adam, rows, flat, mark, first, positions, y, weight, rng):
        at, owner, valid = [], [], []
        for k, i in enumerate(rows):
            starts = np.arange(0, positions[i], HOP)
            if len(starts) > CHUNKS:  # chunks from all over the text
                edges = np.linspace(0, len(starts), CHUNKS + 1)
                starts = starts[(edges[:-1] + rng.random(CHUNKS) * np.diff(edges)).astype(int)]
            at.append(first[i] + starts * STRIDE)
            owner.append(np.full(len(starts), k))
            valid.append(np.minimum(positions[i] - starts, CHUNK))
        at, owner, valid = np.concatenate(at), np.concatenate(owner), np.concatenate(valid)
        span = np.arange((CHUNK - 1) * STRIDE + WIDTH)
        where = np.minimum(at[:, None] + span, len(flat) - 1)
        b = flat[where]
        x = self._channels(b, mark[where])
        view = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)[:, ::STRIDE].transpose(0, 1, 3, 2)
        view = view.reshape(len(at), CHUNK, -1)
        h = view @ self.p["filters"]
        h[np.arange(CHUNK) >= valid[:, None]] = -np.inf
        best = h.argmax(1)
        c, f = np.arange(len(at))[:, None], np.arange(FILTERS)
        top = h[c, best, f] + self.p["offset"]
        pooled = np.maximum(top, 0)
        n = np.bincount(owner).astype(np.float32)
        mean = np.stack([np.bincount(owner, pooled[:, j]) for j in range(FILTERS)], axis=1) / n[:, None]
        edge = np.flatnonzero(np.diff(owner, prepend=-1))
        most = np.maximum.reduceat(pooled, edge, axis=0)
        z = np.concatenate([mean, most], axis=1)
        error = ((logistic(z @ self.p["out"] + self.p["bias"]) - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
        dz = error[:, None] * self.p["out"]
        is_most = pooled == most[owner]
        dh = (dz[owner, :FILTERS] / n[owner, None] + dz[owner, FILTERS:] * is_most) * (top > 0)
        windows = view[c, best]  # chunk, filter, what the filter saw
        grads = {"out": z.T @ error + 1e-4 * self.p["out"], "bias": np.array([error.sum()]), "offset": dh.sum(0), "filters": np.einsum("cf,cfk->kf", dh, windows)}
        back = (dh[:, :, None] * self.p["filters"].T[None]).reshape(len(at), FILTERS, WIDTH, EMBED + 1)[..., :EMBED]
        seen = b[c[..., None], best[..., None] * STRIDE + np.arange(WIDTH)].ravel()
        back = back.reshape(-1, EMBED)
        grads["embed"] = np.stack([np.bincount(seen, back[:, j], minlength=256) for j in range(EMBED)], axis=1)
        adam.step({k: v.astype(np.float32) for k, v in grads.items()})


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Network:
    """A network from labels(doc_id, label) and docs(doc_id, text): a bounded sample of them."""
    rows = sample(docs, labels, label)
    return Network().fit(rows["text"].tolist(), rows["y"].to_numpy(np.int64), weight=rows["weight"].to_numpy())


def score(docs: DataFrame, network: Network, name: str = "score") -> DataFrame:
    """docs' columns and one of that name, the probability of label 1, for docs with a text column."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def make():
        network = shared.value

        def step(batch):
            cols = {c: batch[c] for c in batch.schema.names}
            yield cols | {name: network.score([x or "" for x in batch["text"].to_pylist()]).astype(float)}

        return step

    return map_batches(docs, make, f"{schema}, `{name}` double")


def predict(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, score for docs(doc_id, text)."""
    return score(docs.select(F.col("doc_id").cast("long"), "text"), network).select("doc_id", "score")
