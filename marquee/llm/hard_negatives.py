"""Hard negatives by a multiway hyperplane tree with distance ranges between siblings.

A vector's components become whole numbers, floor(256 x), and a row's score is its inner product with the anchor. One more
component lifts all vectors to the length of the longest, so that a score is a distance and a window of scores an annulus
around the anchor. Every node of the tree has up to FAN split points; a row goes to the nearest one's subtree. For each pair
of siblings the node stores the range of distances from one's split point to all rows below the other; a subtree is passed
over when no distance in its ranges can lie in a search's annulus. Leaves are searched exactly, and the best so far narrow
the annulus.

The split points are fitted to a sample of about SAMPLE rows (all, where a table has fewer), chosen by hash; the ranges
cover every row, and every row is in the index, a table sorted by leaf. The sample also bounds each search's result from
below at the start. Searches are sent to the index's tasks in chunks of about CHUNK; a task keeps the best of each search
and sends only those that the sample doesn't beat. Equal vectors are rows like others: no task gathers them.

Rows with a null id, label or vector, or with any null or non-finite component, take no part. A shorter vector counts as if
zeros followed it. Of rows with one id the one of least label, then vector, counts. Ties in score go to the smaller id. An
empty table, or one without anchors, gives an empty result; an anchor without positives or negatives gives no rows. Extra
columns are ignored, whatever their names. Scores are exact up to 2^53.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import on_workers
from .arrow import drop, shared_folder, written

SCALE = 256
FAN, LEAST_LEAF, LEVELS = 16, 128, 3  # split points of a node; sample rows that are worth a split; levels of nodes
SAMPLE, CHUNK, CELLS = 20_000, 16_384, 2_000_000
PART_BYTES = 16_000_000
LOWEST, HIGHEST = -(1 << 62), 1 << 62


def coded(vectors: DataFrame) -> DataFrame:
    """vec_id, label, codes: the rows that take part, one for each vec_id."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    rows = vectors.where("vec_id is not null and label is not null and embedding is not null").where(fine)
    out = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.transform(x, lambda v: F.floor(v * SCALE)).alias("codes"))
    n, ids = out.agg(F.count("*"), F.count_distinct("vec_id")).first()
    if n == ids:
        return out
    least = out.groupBy("vec_id").agg(F.min(F.struct("label", "codes")).alias("x"))
    return least.select("vec_id", "x.label", "x.codes")


def matrix(codes: pa.Array, width: int) -> np.ndarray:
    """Rows of codes as doubles, shorter ones filled up with zeros."""
    n = np.diff(np.asarray(codes.offsets)).astype(np.int64)
    flat = np.asarray(codes.flatten(), dtype=np.float64)
    if len(n) and (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width))
    out[np.repeat(np.arange(len(n)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


class Tree:
    """Split points fitted to a sample; node 0 is the root. children[node][j] is the node below split point j, or -1 - leaf."""

    def __init__(self, sample: np.ndarray, longest: float):
        self.longest = longest  # the greatest squared length of any row
        self.points: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.way: list[list[tuple[int, int]]] = []  # of each leaf: its nodes and split points from the root on
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        rows = self.lifted(sample) if len(sample) else np.zeros((1, 2))
        self._grow(rows, np.random.default_rng(7), [], 1)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.longest - np.einsum("ij,ij->i", x, x), 0)
        return np.concatenate([x, np.sqrt(rest)[:, None]], axis=1)

    def _grow(self, rows, rng, way, level) -> int:
        points = self._spread(rows, rng) if level <= LEVELS and (len(rows) >= LEAST_LEAF or level == 1) else rows[:0]
        if len(points) < 2 and level > 1:
            self.way.append(way)
            return -len(self.way)
        node = len(self.points)
        self.points.append(points)
        self.children.append([])
        near = (rows @ points.T).argmax(1)  # all are of one length: the greatest product is the least distance
        for j in range(len(points)):
            self.children[node].append(self._grow(rows[near == j], rng, [*way, (node, j)], level + 1))
        return node

    @staticmethod
    def _spread(rows, rng):
        """Up to FAN different rows, each the farthest from those before it, of some drawn by chance."""
        some = rows[rng.permutation(len(rows))[: FAN * 40]]
        chosen, gap = [0], 2 * ((some[0] ** 2).sum() - some @ some[0])
        while len(chosen) < FAN and gap.max() > 1e-6 * max(1, (some[0] ** 2).sum()):
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, 2 * ((some[0] ** 2).sum() - some @ some[chosen[-1]]))
        return some[chosen]

    @property
    def slack(self) -> float:
        return 1e-5 * max(1.0, self.longest**0.5)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        out, todo, rows = np.zeros(len(x), dtype=np.int64), [(0, np.arange(len(x)))], self.lifted(x)
        while todo:
            node, at = todo.pop()
            near = (rows[at] @ self.points[node].T).argmax(1)
            for j, child in enumerate(self.children[node]):
                of = at[near == j]
                if child < 0:
                    out[of] = -1 - child
                elif len(of):
                    todo.append((child, of))
        return out

    def distances(self, rows: np.ndarray, node: int, squared: np.ndarray | None = None) -> np.ndarray:
        """From lifted rows (squared: their squared lengths, else all are the longest) to a node's split points."""
        own = self.longest if squared is None else squared[:, None]
        return np.sqrt(np.maximum(own + self.longest - 2 * (rows @ self.points[node].T), 0))

    def with_ranges(self, found) -> Tree:
        """found: (node, sibling, split point, least distance, greatest) over all rows."""
        self.low = [np.full((len(p), len(p)), np.inf) for p in self.points]
        self.high = [np.full((len(p), len(p)), -np.inf) for p in self.points]
        for node, j, i, low, high in found:
            self.low[node][j, i], self.high[node][j, i] = low - self.slack, high + self.slack
        return self


class Searches:
    """A chunk of searches in a task: question rows, windows, and the best found so far of each."""

    def __init__(self, tree: Tree, cols: dict[str, np.ndarray], codes: np.ndarray, k: int, same: bool):
        self.tree, self.codes, self.k, self.same = tree, codes, k, same
        self.label, self.low, self.high = (cols[c].copy() for c in ("label", "low", "high"))
        self.low_id = cols["low_id"].copy()  # rows of the lowest score count up to this id
        self.squared = np.einsum("ij,ij->i", codes, codes)
        self.lifted = np.concatenate([codes, np.zeros((len(codes), 1))], axis=1)
        self.nearest = self.radius(self.high)
        self.best = np.empty((0, 3), dtype=np.int64)  # search, score, id
        self._to: dict[int, np.ndarray] = {}

    def radius(self, score: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.squared + self.tree.longest - 2.0 * score, 0))

    def reaching(self, leaf: int) -> np.ndarray:
        """Searches whose annulus may hold a row of the leaf."""
        live = np.ones(len(self.low), dtype=bool)
        farthest = self.radius(self.low)
        for node, j in self.tree.way[leaf]:
            if node not in self._to:
                self._to[node] = self.tree.distances(self.lifted, node, self.squared)
            d, low, high = self._to[node], self.tree.low[node][j], self.tree.high[node][j]
            live &= (np.maximum(low - d, d - high).max(1) <= farthest + self.tree.slack) & ((d + high).min(1) >= self.nearest - self.tree.slack)
        return np.flatnonzero(live)

    def scan(self, at: np.ndarray, x: np.ndarray, label: np.ndarray, ids: np.ndarray) -> None:
        """Take rows x into the searches at."""
        step = max(1, CELLS // max(1, len(at)))
        for a in range(0, len(x), step):
            part = slice(a, a + step)
            score = (self.codes[at] @ x[part].T).astype(np.int64)
            low = self.low[at, None]
            good = ((self.label[at, None] == label[None, part]) == self.same) & (score <= self.high[at, None])
            good &= (score > low) | ((score == low) & (ids[None, part] <= self.low_id[at, None]))
            q, r = np.nonzero(good)
            if len(q):
                self._merge(np.stack([at[q], score[q, r], ids[part][r]], axis=1))

    def _merge(self, found: np.ndarray) -> None:
        both = np.concatenate([self.best, found])
        both = both[np.lexsort((both[:, 2], -both[:, 1], both[:, 0]))]
        first = np.searchsorted(both[:, 0], both[:, 0])
        place = np.arange(len(both)) - first
        self.best = both[place < self.k]
        last = both[place == self.k - 1]
        self.low[last[:, 0]], self.low_id[last[:, 0]] = last[:, 1], last[:, 2]


class Index:
    """The vectors as a table sorted by leaf (vec_id, label, codes, leaf), with the tree over it."""

    def __init__(self, vectors: DataFrame):
        spark = vectors.sparkSession
        on_workers(spark)
        self.spark = spark
        path = shared_folder(spark)
        rows = written(vectors, path=path)
        squared = F.aggregate("codes", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
        n, width, longest = rows.agg(F.count("*"), F.max(F.size("codes")), F.max(squared)).first()
        self.n, self.width, self.longest = n, max(width or 0, 1), longest or 0.0
        share = min(1.0, SAMPLE / max(1, n))
        sample = rows.where((F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)))).limit(2 * SAMPLE).toArrow()
        order = np.argsort(np.asarray(sample["vec_id"]), kind="stable")  # whatever order they arrived in
        x = matrix(sample["codes"].combine_chunks(), self.width)[order] if len(order) else np.zeros((0, self.width))
        tree = Tree(x, self.longest)
        self.sample = spark.sparkContext.broadcast((x, np.asarray(sample["label"])[order], np.asarray(sample["vec_id"])[order]))
        self.rows = self._sorted(rows, spark.sparkContext.broadcast(tree))
        drop(spark, path)
        self.tree = spark.sparkContext.broadcast(tree.with_ranges(self._ranges(spark.sparkContext.broadcast(tree))))

    def _sorted(self, rows: DataFrame, tree) -> DataFrame:
        width = self.width

        def assign(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.value.leaves(matrix(b["codes"], width)))], names=["vec_id", "label", "codes", "leaf"])

        placed = rows.mapInArrow(assign, "vec_id long, label long, codes array<long>, leaf long")
        parts = max(self.spark.sparkContext.defaultParallelism, -(-self.n * self.width * 4 // PART_BYTES))
        return written(placed.repartitionByRange(parts, "leaf", F.xxhash64("vec_id")).sortWithinPartitions("leaf"))

    def _ranges(self, tree) -> list[tuple]:
        """Least and greatest distances from each split point to the rows below each sibling: a bounded number of rows."""
        width = self.width

        def measure(batches):
            t, low, high = tree.value, {}, {}
            for b in batches:
                x, leaf = t.lifted(matrix(b["codes"], width)), np.asarray(b["leaf"])
                for k in np.unique(leaf):
                    for node, j in t.way[k]:
                        d = t.distances(x[leaf == k], node)
                        low[node, j] = np.minimum(low.get((node, j), np.inf), d.min(0))
                        high[node, j] = np.maximum(high.get((node, j), -np.inf), d.max(0))
            out = [(node, j, i, a, b) for (node, j), v in low.items() for i, (a, b) in enumerate(zip(v, high[node, j], strict=True))]
            yield pa.RecordBatch.from_pylist([dict(zip(("node", "j", "i", "low", "high"), x, strict=True)) for x in out], schema=schema)

        schema = pa.schema([("node", pa.int64()), ("j", pa.int64()), ("i", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])
        found = self.rows.mapInArrow(measure, "node long, j long, i long, low double, high double")
        return [tuple(r) for r in found.groupBy("node", "j", "i").agg(F.min("low"), F.max("high")).collect()]

    def _bounded(self, searches: DataFrame, k: int, same: bool) -> DataFrame:
        """searches with low and low_id raised to the sample's k-th best in the window, where it has so many."""
        width, sample, tree = self.width, self.sample, self.tree

        def bound(batches):
            x, label, ids = sample.value
            for b in batches:
                for a in range(0, b.num_rows, 256):
                    part = b.slice(a, 256)
                    s = Searches(tree.value, {c: np.asarray(part[c]) for c in ("label", "low", "high", "low_id")}, matrix(part["codes"], width), k, same)
                    s.scan(np.arange(part.num_rows), x, label, ids)
                    yield pa.RecordBatch.from_arrays([pa.array(s.low) if n == "low" else pa.array(s.low_id) if n == "low_id" else part[n] for n in part.schema.names], names=part.schema.names)

        return searches.mapInArrow(bound, searches.schema)

    def search(self, searches: DataFrame, k: int, same: bool) -> DataFrame:
        """sid, window, vec_id, score, rank: the first k rows of each of searches(sid, window, label, codes, low, high).

        same: rows of the search's own label, else of other ones; scores from low to high, greater first, then smaller ids.
        """
        width, tree, spark = self.width, self.tree, self.spark
        path, found = shared_folder(spark), shared_folder(spark)
        chunks = max(1, -(-searches.count() // CHUNK))
        todo = searches.withColumn("low_id", F.lit(HIGHEST))
        self._bounded(todo, k, same).withColumn("chunk", F.pmod(F.xxhash64("sid", "window"), F.lit(chunks))).write.partitionBy("chunk").parquet(path)
        bounded = spark.read.schema(f"{_ddl(todo)}, chunk long").parquet(path)
        for chunk in range(chunks):
            table = bounded.where(F.col("chunk") == chunk).drop("chunk").toArrow()
            cols = {c: np.asarray(table[c]) for c in ("sid", "window", "label", "low", "high", "low_id")}
            sent = spark.sparkContext.broadcast((cols, matrix(table["codes"].combine_chunks(), width) if table.num_rows else np.zeros((0, width))))

            def scan(batches, sent=sent):
                cols, codes = sent.value
                s = Searches(tree.value, cols, codes, k, same)
                for b in batches:
                    x, leaf, label, ids = matrix(b["codes"], width), *(np.asarray(b[c]) for c in ("leaf", "label", "vec_id"))
                    for of in np.split(np.arange(len(leaf)), np.flatnonzero(np.diff(leaf)) + 1):
                        if len(of):
                            s.scan(s.reaching(int(leaf[of[0]])), x[of], label[of], ids[of])
                at, score, ids = s.best.T
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cols["sid"][at], cols["window"][at], ids, score)], names=["sid", "window", "vec_id", "score"])

            self.rows.mapInArrow(scan, "sid long, window long, vec_id long, score long").write.mode("append").parquet(found)
            sent.destroy()
        drop(spark, path)
        best = Window.partitionBy("sid", "window").orderBy(F.desc("score"), "vec_id")
        got = spark.read.schema("sid long, window long, vec_id long, score long").parquet(found)
        return got.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _floor_hundredth(x: F.Column) -> F.Column:
    """The greatest whole number that is at most x / 100, without rounding."""
    return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def mine(vectors: DataFrame, anchor: F.Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for vectors(vec_id, label, embedding).

    Anchors are the rows of the condition anchor on vec_id. An anchor's positives are the first rows of its label besides it;
    a positive's negatives the first rows of other labels with scores from window[0] to window[1] hundredths of its own.
    """
    rows = written(coded(vectors))
    index = Index(rows)
    anchors = rows.where(anchor)
    questions = written(anchors.groupBy("label", "codes").agg(F.min("vec_id").alias("sid")))  # equal anchors ask once
    asked = written(anchors.join(questions, ["label", "codes"]).select(F.col("vec_id").alias("anchor_id"), "sid"))
    whole = questions.select("sid", F.lit(0).cast("long").alias("window"), "label", "codes", F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("high"))
    near = index.search(whole, positives + 1, True).select("sid", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    in_order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    others = asked.join(near, "sid").where("anchor_id <> positive_id")
    pairs = written(others.withColumn("place", F.row_number().over(in_order)).where(F.col("place") <= positives).drop("place"))
    score = F.col("positive_score")
    low, high = -_floor_hundredth(-score * window[0]), _floor_hundredth(score * window[1])
    windows = pairs.select("sid", "positive_score").distinct().select("sid", score.alias("window"), low.alias("low"), high.alias("high")).where("low <= high")
    inside = index.search(written(windows.join(questions, "sid").select("sid", "window", "label", "codes", "low", "high")), negatives, False)
    far = inside.select("sid", F.col("window").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(far, ["sid", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
