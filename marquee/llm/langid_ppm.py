"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of up to ORDER bytes with counts from its training texts. A byte costs -log2 of its
share in the longest context that the tree holds, or that context's escape (distinct symbols over count plus distinct
symbols) and its cost in the next shorter one; at last 8 bits. Statistics are frozen, so a text's code length is a sum
over its (ORDER + 1)-grams, and the language of the least length is predicted.

Training takes a bounded sample: about `per_language` texts of each language, chosen by a hash of doc_id.
Nulls: a null text, or one without a letter, is `und` with score 0; a null lang or text trains nothing. Without training
rows all is `und`. Equal costs go to the language that sorts first. Repeated rows stay; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import on_workers
from .arrow import map_batches

ORDER = 3
PER_LANGUAGE = 400
MOST_GRAMS = 1_000_000
UND = "und"
_LETTER = re.compile(r"[^\W\d_]")


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """((ORDER + 1)-byte codes, codes before each text): one for each byte, zeros before the first."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    flat = np.frombuffer(b"".join(bytes(ORDER) + t for t in raw), dtype=np.uint8).astype(np.int64)
    n = np.array([len(t) for t in raw], dtype=np.int64)
    starts = np.cumsum(n + ORDER) - n
    at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    code = np.zeros(len(at), dtype=np.int64)
    for back in range(ORDER, -1, -1):
        code = (code << 8) | flat[at - back]
    return code, np.concatenate([[0], np.cumsum(n)])


class Trees:
    """All languages' trees: by order, counts of (context, symbol) and of contexts, as arrays with a column for each language."""

    def __init__(self, languages: list[str], language: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.languages, self.orders = languages, []
        size = len(languages)
        for order in range(ORDER, -1, -1) if size else ():
            keys, at = np.unique(gram & ((1 << (8 * (order + 1))) - 1), return_inverse=True)
            counts = np.bincount(at * size + language, n, minlength=len(keys) * size).reshape(-1, size)
            contexts, c = np.unique(keys >> 8, return_inverse=True)
            total, kinds = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
            np.add.at(total, c, counts)
            np.add.at(kinds, c, counts > 0)
            self.orders.append((order, keys, counts, contexts, total, kinds))

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """Bits of each gram's last byte after its others, for each language."""
        bits, open_ = np.zeros((len(grams), len(self.languages))), np.ones((len(grams), len(self.languages)), dtype=bool)
        for order, keys, counts, contexts, total, kinds in self.orders:
            low = grams & ((1 << (8 * (order + 1))) - 1)
            n, t, d = _rows(keys, counts, low), _rows(contexts, total, low >> 8), _rows(contexts, kinds, low >> 8)
            live = open_ & (t > 0)
            share = np.where(n > 0, n, d) / np.maximum(t + d, 1)
            bits[live] -= np.log2(share[live])
            open_ &= ~(live & (n > 0))
        return bits + 8.0 * open_


class Scorer:
    """Code lengths of texts under trees; a gram's cost is worked out once, for up to MOST_GRAMS grams."""

    def __init__(self, trees: Trees):
        self.trees = trees
        self._clear()

    def _clear(self):
        self.keys, self.cost = np.empty(0, np.int64), np.empty((0, len(self.trees.languages)))

    def _costs(self, grams: np.ndarray) -> np.ndarray:
        if len(self.keys) > MOST_GRAMS:
            self._clear()
        at = np.searchsorted(self.keys, grams)
        new = np.ones(len(grams), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != grams[inside]
        if new.any():
            fresh = np.sort(grams[new])
            where = np.searchsorted(self.keys, fresh)
            self.keys, self.cost = np.insert(self.keys, where, fresh), np.insert(self.cost, where, self.trees.costs(fresh), axis=0)
            at = np.searchsorted(self.keys, grams)
        return self.cost[at]

    def bits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bits of each text for each language, its bytes). Texts are summed apart: equal texts have equal bits in any batch."""
        code, cut = _grams(texts)
        codes, distinct = pd.factorize(code)
        table = self._costs(distinct)
        filled = np.flatnonzero(np.diff(cut))
        bits = np.zeros((len(texts), len(self.trees.languages)))
        for k in range(len(self.trees.languages)) if len(filled) else ():
            bits[filled, k] = np.add.reduceat(table[:, k][codes], cut[filled])
        return bits, np.diff(cut)


def counted(texts: list[str], langs: list[str | None]) -> Trees:
    """Trees from texts with languages (null: left out)."""
    languages = sorted({x for x in langs if x is not None})
    parts = []
    for k, lang in enumerate(languages):
        gram, n = np.unique(_grams([t for t, x in zip(texts, langs, strict=True) if x == lang])[0], return_counts=True)
        parts.append((np.full(len(gram), k), gram, n.astype(np.float64)))
    if not parts:
        return Trees([], *(np.empty(0, np.int64) for _ in range(3)))
    return Trees(languages, *(np.concatenate(x) for x in zip(*parts, strict=True)))


def _rows(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], values[at], 0.0)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Trees:
    """Trees from docs(doc_id, text, lang)."""
    on_workers(docs.sparkSession)
    known = docs.where("lang is not null and text is not null").select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    languages = sorted(sizes)
    if not languages:
        return Trees([], *(np.empty(0, np.int64) for _ in range(3)))
    share = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, per_language / sizes[k]))))
    drawn = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    sample = known.where((F.pmod(drawn, F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)))

    def make():
        def step(batch):
            langs = np.array(batch["lang"].to_pylist(), dtype=object)
            texts = batch["text"].to_pylist()
            for lang in set(langs):
                code, _ = _grams([t for t, x in zip(texts, langs, strict=True) if x == lang])
                got, n = np.unique(code, return_counts=True)
                yield {"lang": [lang] * len(got), "gram": got, "n": n}

        return step

    got = map_batches(sample, make, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return Trees(languages, np.searchsorted(languages, got["lang"].to_numpy(dtype=str)), got["gram"].to_numpy(np.int64), got["n"].to_numpy(np.float64))


def predict(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, lang_pred, score for docs(doc_id, text); score: the posterior at the cost per byte of at most 64 bytes."""
    on_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the training sample

    def make():
        trees = shared.value
        scorer = Scorer(trees)

        def step(batch):
            raw = batch["text"].to_pylist()
            texts = [t or "" for t in raw]
            lang, score = [UND] * len(texts), np.zeros(len(texts))
            if trees.languages:
                bits, n = scorer.bits(texts)
                n = np.maximum(n, 1)[:, None]
                best = bits.argmin(1)
                gap = (bits - bits.min(1, keepdims=True)) / n * np.minimum(n, 64)
                top = 1 / np.exp2(-np.minimum(gap, 1000)).sum(1)
                for i, t in enumerate(texts):
                    if _LETTER.search(t):
                        lang[i], score[i] = trees.languages[best[i]], top[i]
            yield {"doc_id": batch["doc_id"], "lang_pred": lang, "score": score}

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, lang_pred string, score double")


def remainder(doc_id: Column, by: int) -> Column:
    """crc32(doc_id as text) mod by; of a null id that of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % by
