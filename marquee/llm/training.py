"""What the two numpy classifiers share: a bounded labelled sample, Adam, and logistic helpers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import on_workers

#: Bounds of the labelled sample: rows of each class, and bytes of all their texts together.
PER_CLASS, CLASS_BYTES = 2000, 16_000_000


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> pd.DataFrame:
    """text, y, weight (and lang, where docs have it) of a sample of each class of labels(doc_id, label).

    The sample is the run of least hashes of doc_id with at most per_class rows and class_bytes of whole texts (one text
    at least); no text is left out for its own size. Of different texts under one doc_id the least counts.

    A class's weights add up to its share of all labels (1 on average), however many of its texts are in the sample.
    """
    on_workers(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").distinct()
    by = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("y = 0").orderBy(*by).limit(per_class).union(known.where("y = 1").orderBy(*by).limit(per_class))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang")).join(F.broadcast(chosen), "doc_id")
    before = Window.partitionBy("y").orderBy(*by, "text").rowsBetween(Window.unboundedPreceding, -1)  # over the sample's rows only
    sized = texts.withColumn("before", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)))
    got = sized.where((F.col("before") == 0) | (F.col("before") + F.octet_length("text") <= class_bytes)).select("doc_id", "text", "lang", "y").toPandas()
    got = got.sort_values(["doc_id", "text"], ignore_index=True).drop_duplicates("doc_id", ignore_index=True)
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    weight = got["y"].map(counts) / got.groupby("y")["y"].transform("size")
    return got.assign(weight=weight / weight.mean())[["text", "lang", "y", "weight"]]


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]):
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def balanced(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights that make both classes weigh as much, 1 on average; gently, by the square root of their weighted shares."""
    one = np.average(y, weights=weight)
    w = weight * np.where(y == 1, max(one, 1e-3), max(1 - one, 1e-3)) ** -0.5
    return w / w.mean()


def calibrated(score: np.ndarray, cut: np.ndarray, to: float) -> np.ndarray:
    """Scores with cut moved to `to`, in proportion on either side."""
    return np.where(score < cut, to * score / np.maximum(cut, 1e-9), to + (1 - to) * (score - cut) / np.maximum(1 - cut, 1e-9))


def best_cut(score: np.ndarray, y: np.ndarray, weight_false: float = 1.0, default: float = 0.5, weight: np.ndarray | None = None) -> float:
    """The threshold with the fewest errors by weight; a false positive counts weight_false besides. In the middle of the gap."""
    if not len(y) or y.min() == y.max():
        return default
    order = np.argsort(score)
    s, t, w = score[order], y[order], np.ones(len(y)) if weight is None else weight[order]
    missed, false = np.cumsum(w * (t == 1)), np.cumsum(w * (t == 0))
    wrong = np.concatenate([[0], missed]) + weight_false * np.concatenate([[false[-1]], false[-1] - false])
    edges = np.concatenate([[0.0], (s[1:] + s[:-1]) / 2, [1.0]])
    least = np.flatnonzero(wrong <= wrong.min() + 1e-6)
    return float(np.clip(edges[least[len(least) // 2]], 0.02, 0.98))
