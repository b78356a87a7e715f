"""Hard negatives against brute force, the index's elimination, and awkward rows."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from marquee.llm import hard_negatives, queries

SMALL = "/root/testdata/sf0.001"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
SCHEMA = "vec_id long, label int, embedding array<float>, codes string, leaf long, score double, sid long"


def plain(rows, positives=5, negatives=10):
    """rows: (vec_id, label, codes), one for each id."""
    out = []

    def score(x, y):
        return sum(a * b for a, b in zip(x, y, strict=False))

    for i, label, codes in rows:
        if i % 100:
            continue
        others = sorted(((score(codes, c), j, m) for j, m, c in rows if j != i), key=lambda r: (-r[0], r[1]))
        for s, j, _ in [r for r in others if r[2] == label][:positives]:
            far = [r for r in others if r[2] != label and 30 * s <= 100 * r[0] <= 90 * s][:negatives]
            out += [(i, j, k + 1, n, s, t) for k, (t, n, _) in enumerate(far)]
    return sorted(out)


def codes_of(v):
    return [math.floor(256 * float(x)) for x in v]


def taking_part(rows):
    best = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        best[i] = min(best.get(i, (label, codes_of(v))), (label, codes_of(v)))
    return [(i, *x) for i, x in best.items()]


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 1.0, 2) for r in rows], SCHEMA).repartition(3)


def test_query_is_brute_force(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, list(r.embedding)) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert got(queries.op11_hard_negatives(spark, SMALL)) == plain(taking_part(rows))


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i * 20, i % 3, [((i * 7 + j * 3) % 11 - 4) / 8 for j in range(6)]) for i in range(60)]
    rows += [(None, 1, [1.0] * 6), (7, None, [1.0] * 6), (8, 1, None), (9, 1, [nan] * 6), (11, 1, [inf] + [0.0] * 5), (13, 1, [1.0, None, 0.0]), (15, 2, []), (17, 1, [0.5, 0.25]), (18, 2, [0.5] * 8)]
    rows += rows[:4] + [(100, 2, [-1.0] * 6)]  # repeated rows, and one id with two vectors
    assert got(hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 100 == 0)) == plain(taking_part(rows))
    assert hard_negatives.mine(frame(spark, rows[:0]), F.col("vec_id") % 100 == 0).collect() == []
    assert hard_negatives.mine(frame(spark, [(1, 1, [1.0]), (2, 2, [0.5])]), F.col("vec_id") % 100 == 0).collect() == []
    assert hard_negatives.mine(frame(spark, [(100, 1, [1.0])]), F.col("vec_id") % 100 == 0).collect() == []


def test_a_third_of_all_rows_are_one_vector_and_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CHUNK", 4)
    monkeypatch.setattr(hard_negatives, "SAMPLE", 150)
    rng = random.Random(1)
    rows = [(i * 5, rng.randrange(4), [0.5, 0.25, 0.0, -0.25] if i % 3 == 0 else [rng.gauss(0, 0.5) for _ in range(4)]) for i in range(700)]
    assert got(hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 100 == 0)) == plain(taking_part(rows))


def test_clusters_are_passed_over_without_loss(spark, monkeypatch):
    """On vectors in clusters the ranges rule most leaves out; every row within an annulus is in a leaf that stays."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 8))
    rows = [(i, int(i % 4), (centres[i % 40] + 0.02 * rng.normal(size=8)).tolist()) for i in range(4000)]
    index = hard_negatives.Index(hard_negatives.coded(frame(spark, rows)))
    tree = index.tree.value
    x = np.array([codes_of(np.float32(r[2])) for r in rows], dtype=float)
    leaf, q = tree.leaves(x), x[::100]
    high = np.einsum("ij,ij->i", q, q).astype(np.int64)
    low = (high * 0.8).astype(np.int64)
    cols = {"label": np.zeros(len(q), np.int64), "low": low, "high": high, "low_id": np.full(len(q), 1 << 62)}
    s = hard_negatives.Searches(tree, cols, q, 10, True)
    reach = np.zeros((len(q), len(tree.way)), dtype=bool)
    for k in range(len(tree.way)):
        reach[s.reaching(k), k] = True
    score = q @ x.T
    inside = (score >= low[:, None]) & (score <= high[:, None])
    assert reach[np.nonzero(inside)[0], leaf[np.nonzero(inside)[1]]].all()
    assert reach.mean() < 0.5
    assert sorted(r.vec_id for r in index.rows.collect()) == sorted(r[0] for r in rows)
