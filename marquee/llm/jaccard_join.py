"""Exact Jaccard self-join of documents on word shingles, as components, with adaptive multi-match prefixes.

1. Every document's shingles are counted: sorted hashes go out in blocks, one for each slice of documents and bucket of
   hashes; a bucket finds the hashes that several documents hold and sends them back to their slices with that number.
2. A slice orders each document's shingles by (documents that hold it, hash), rare ones first. Two linked documents
   share a shingle within their first n - ceil(t n) + 1. Lengthening a document's prefix by k lets it ask for k + 1
   shared shingles; k is the one of least estimated cost: postings to read, and candidates to verify.
3. Documents with equal sets become one. Those that share a prefix shingle fall into candidate groups, found through one
   link for each posting. Within groups pairs are verified on whole sets; groups too large for one task are cut into
   blocks and all pairs of blocks are visited that still hold documents of different components.

Sets are of 64-bit hashes. Nulls: a null or wordless text has an empty set, linked with nothing; a null doc_id is
nobody's link and its component is null. Rows with one doc_id are one node. Repeated rows each return a row. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches, written
from .components import components
from .textvec import shingle_sets

LOCAL = 8  # documents of one slice that hold a shingle, beyond which the slice sends it once, with their number
MOST_SHARED = 4  # most shared prefix shingles that a document asks for
BROADCAST_ROWS = 1_000_000  # candidates (24 bytes each) up to which they are broadcast; beyond, a shuffled join
BLOCK_DOCS, BLOCK_SHINGLES = 4096, 8_000_000  # of one block of a candidate group
BUCKETS = 4  # of hashes, for each partition: a bucket is in memory at once
PART_BYTES = 16_000_000  # of text for each partition, where that makes more of them than spark.sql.shuffle.partitions
COPIES = 100  # rows with equal sets from which on their class is broadcast to them
MANY = np.uint32(0xFFFFFFFF)

DOCS = "doc_id long, n int, h1 long, h2 long, need int, prefix array<long>"
_BLOBS = "to long, unit long, kind int, hashes binary, docs binary, counts binary"


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, which compress well in sorted arrays."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplanes(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(b, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def _ranges(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, ..."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def _spread(width: int, buckets: int):
    """Slices of documents to blobs for the buckets."""

    def make():
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0

        def step(batch):
            nonlocal number
            unit = (part << 24) + number
            number += 1
            sets = shingle_sets(batch["text"].to_pylist(), width)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            flat, doc = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint32), n)
            order = np.argsort(flat, kind="stable")
            flat, doc = flat[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.empty(0, np.int64)
            held = np.diff(np.append(first, len(flat)))
            often = held > LOCAL
            single = ~np.repeat(often, held)
            hashes = np.concatenate([flat[single], flat[first[often]]])
            docs = np.concatenate([doc[single], np.full(int(often.sum()), MANY, np.uint32)])
            counts = np.concatenate([np.ones(int(single.sum()), np.uint32), held[often].astype(np.uint32)])
            to = (hashes >> np.uint64(32)).astype(np.int64) * buckets >> 32
            order = np.lexsort((hashes, to))
            hashes, docs, counts, to = hashes[order], docs[order], counts[order], to[order]
            cut = np.searchsorted(to, np.arange(buckets + 1))
            cols = {k: [] for k in ("to", "unit", "kind", "hashes", "docs", "counts")}

            def add(*row):
                for c, x in zip(cols.values(), row, strict=True):
                    c.append(x)

            for b in np.flatnonzero(np.diff(cut)):
                s = slice(cut[b], cut[b + 1])
                add(int(b), unit, 0, _planes(hashes[s]), _planes(docs[s]), _planes(counts[s]))
            ids = batch["doc_id"].fill_null(0).to_numpy().astype(np.int64)
            empty = np.asarray(batch["doc_id"].is_null())
            pairs = np.array([_set_hash(s) for s in sets], dtype=np.int64).reshape(-1, 2)
            add(unit % buckets, unit, 1, np.stack([ids, n, pairs[:, 0], pairs[:, 1], empty.astype(np.int64)]).tobytes(), _planes(doc[~single]), _planes(flat[~single]))
            yield cols

        return step

    return make


def _shared(group: pd.DataFrame) -> pd.DataFrame:
    """A bucket: the hashes that two documents or more hold, back to their slices with that number."""
    keep = group[group.kind == 1].assign(to=0)
    blobs = group[group.kind == 0]
    if not len(blobs):
        return keep
    hashes, docs, counts = (np.concatenate([_unplanes(x, kind) for x in blobs[c]]) for c, kind in (("hashes", np.uint64), ("docs", np.uint32), ("counts", np.uint32)))
    unit = np.repeat(blobs.unit.to_numpy(), [len(x) // 8 for x in blobs.hashes])
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.append(first, len(h)))
    total = np.repeat(np.add.reduceat(counts[order].astype(np.int64), first), size)
    order, total = order[total > 1], np.minimum(total[total > 1], 0xFFFFFFFE).astype(np.uint32)
    if not len(order):
        return keep
    by = np.argsort(unit[order], kind="stable")
    order, total = order[by], total[by]
    units, at = np.unique(unit[order], return_index=True)
    rows = [(0, int(u), 0, _planes(hashes[o]), _planes(docs[o]), _planes(t)) for u, o, t in zip(units, np.split(order, at[1:]), np.split(total, at[1:]), strict=True)]
    return pd.concat([keep, pd.DataFrame(rows, columns=list(group.columns))])


def _prefixes(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """A slice: its documents with their prefixes."""
        own = group[group.kind == 1].iloc[0]
        ids, n, h1, h2, empty = np.frombuffer(own.hashes, np.int64).reshape(5, -1)
        blobs = group[group.kind == 0]
        h, d, c = (np.concatenate([np.empty(0, kind), *(_unplanes(x, kind) for x in blobs[col])]) for col, kind in (("hashes", np.uint64), ("docs", np.uint32), ("counts", np.uint32)))
        if (many := d == MANY).any():  # the slice kept who holds these
            lh, ld = _unplanes(own.counts, np.uint64), _unplanes(own.docs, np.uint32)
            a, b = np.searchsorted(lh, h[many]), np.searchsorted(lh, h[many], side="right")
            at = np.repeat(a, b - a) + _ranges(b - a)
            h, d, c = np.concatenate([h[~many], lh[at]]), np.concatenate([d[~many], ld[at]]), np.concatenate([c[~many], np.repeat(c[many], b - a)])
        order = np.lexsort((h, c, d))
        h, d, c = h[order], d[order].astype(np.int64), c[order].astype(np.int64)
        held = np.bincount(d, minlength=len(n))
        slots = n - -(-n * percent // 100) + 1 - (n - held)  # shared shingles in the shortest prefix: unique ones come first
        start = np.cumsum(held) - held
        reads = np.concatenate([[0], np.cumsum(c - 1)])
        cost = np.full((MOST_SHARED, len(n)), np.inf)
        for k in range(MOST_SHARED):
            scan = reads[start + np.clip(slots + k, 0, held)] - reads[start]
            cost[k] = scan + scan / (k + 1) * np.maximum(n, 1) / 16
        need = 1 + np.argmin(cost, axis=0)
        take = np.where(slots > 0, np.clip(slots + need - 1, 0, held), 0)
        flat = h[np.repeat(start, take) + _ranges(take)].view(np.int64)
        return pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64").copy() if not empty.any() else pd.Series(ids, dtype="Int64").mask(empty.astype(bool)), "n": n.astype(np.int32), "h1": h1, "h2": h2, "need": need.astype(np.int32), "prefix": np.split(flat, np.cumsum(take)[:-1])})

    return run


def _parts(docs: DataFrame) -> int:
    """Partitions by the bytes of all texts."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def document_prefixes(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """DOCS: each document's set size, set hash, shared shingles to ask for, and prefix."""
    parts = _parts(docs)
    buckets = BUCKETS * parts
    blobs = map_batches(docs.select(F.col("doc_id").cast("long"), "text"), _spread(width, buckets), _BLOBS)
    shared = blobs.repartition(parts, "to").groupBy("to").applyInPandas(_shared, _BLOBS)
    return shared.repartition(parts, "unit").groupBy("unit").applyInPandas(_prefixes(percent), DOCS)


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def link(sets: list[np.ndarray], prefix: list[np.ndarray], need: np.ndarray, label: np.ndarray, percent: int, across: np.ndarray | None = None) -> np.ndarray:
    """Index of each document's component, of those that start with equal labels and those that links join.

    across: only pairs with different values of it are looked at.
    """
    m = len(sets)
    forest = _Forest(m)
    _, first, same = np.unique(label, return_index=True, return_inverse=True)
    for i in range(m):
        forest.up[i] = int(first[same[i]])
    n = np.array([len(s) for s in sets], dtype=np.int64)

    def postings(parts: list[np.ndarray]):
        token = np.unique(np.concatenate(parts), return_inverse=True)[1]
        owner = np.repeat(np.arange(m), [len(p) for p in parts])
        order = np.argsort(token, kind="stable")
        at = np.searchsorted(token[order], np.arange(int(token.max()) + 2 if len(token) else 1))
        return np.split(token, np.cumsum([len(p) for p in parts])[:-1]), owner[order], at

    by_prefix = postings(prefix)
    whole = None
    for r in range(1, m):
        shared = _seen(by_prefix, r, m)[:r]
        ok = (shared >= np.minimum(need[:r], need[r])) & (shared > 0) & (100 * np.minimum(n[:r], n[r]) >= percent * np.maximum(n[:r], n[r]))
        if across is not None:
            ok &= across[:r] != across[r]
        near = [int(s) for s in np.flatnonzero(ok) if forest.root(int(s)) != forest.root(r)]
        if not near:
            continue
        if len(near) > 8:
            whole = whole or postings(sets)
            both = _seen(whole, r, m)[near]
        else:
            both = np.array([len(np.intersect1d(sets[s], sets[r], assume_unique=True)) for s in near])
        for s in np.asarray(near)[100 * both >= percent * (n[near] + n[r] - both)]:
            a, b = sorted((forest.root(int(s)), forest.root(r)))
            forest.up[b] = a
    return np.array([forest.root(i) for i in range(m)])


def _seen(postings, r: int, m: int) -> np.ndarray:
    """Of how many of r's tokens each document is a holder."""
    tokens, owner, at = postings
    a, b = at[tokens[r]], at[tokens[r] + 1]
    return np.bincount(owner[np.repeat(a, b - a) + _ranges(b - a)], minlength=m)


def _linked(rows: DataFrame, keys: list[str], width: int, percent: int) -> DataFrame:
    """node, root: rows(keys, doc_id, h1, h2, need, prefix, label, across, text) linked within the keys' groups."""

    def run(batches):
        held, key = [], None
        for pdf in batches:
            for k, part in pdf.groupby(keys, sort=False):
                if k != key and held:
                    yield group(pd.concat(held))
                    held = []
                key = k
                held.append(part)
        if held:
            yield group(pd.concat(held))

    def group(g):
        sets = shingle_sets(g.text.tolist(), width)
        g = g.assign(set=sets)[[_set_hash(s) == (a, b) for s, a, b in zip(sets, g.h1, g.h2, strict=True)]].drop_duplicates(["doc_id", "h1", "h2"])
        g = g.assign(n=g.set.map(len)).sort_values(["doc_id", "n"])
        _, by_id = np.unique(g.label.to_numpy(), return_inverse=True)
        across = g.across.to_numpy() if (g.across >= 0).all() else None
        got = link(g.set.tolist(), g.prefix.tolist(), g.need.to_numpy(), by_id, percent, across)
        ids = g.doc_id.to_numpy()
        return pd.DataFrame({"node": ids, "root": ids[got]})

    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys).mapInPandas(run, "node long, root long")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 75, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links, itself included) for docs(doc_id, text)."""
    table = written(document_prefixes(docs, width, percent))
    key = ["h1", "h2", "n"]
    classes = table.where("n > 0 and doc_id is not null").groupBy(*key).agg(F.min(F.struct("doc_id", "need", "prefix")).alias("rep"), F.count("*").alias("members")).select(*key, "rep.*", "members")
    postings = classes.where(F.size("prefix") > 0).select("doc_id", F.explode("prefix").alias("token"))
    hubs = postings.groupBy("token").agg(F.min("doc_id").alias("hub"), F.count("*").alias("held")).where("held > 1").select("token", "hub")
    groups = components(postings.join(hubs, "token").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")))
    groups = groups.union(groups.select("root", "root").distinct()).toDF("doc_id", "comp")

    member = classes.join(groups, "doc_id")
    sizes = member.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("blocks"))
    member = written(member.join(sizes, "comp").withColumn("block", F.pmod(F.xxhash64("h1", "h2"), F.col("blocks")).cast("int")))

    def with_text(chosen: DataFrame) -> DataFrame:
        ids = chosen.select("doc_id").distinct()
        if ids.count() <= BROADCAST_ROWS:
            ids = F.broadcast(ids)
        texts = docs.select(F.col("doc_id").cast("long"), "text").join(ids, "doc_id", "left_semi")
        return chosen.join(texts, "doc_id")

    blank = [F.col("doc_id").alias("label"), F.lit(-1).alias("across")]
    first = written(_linked(with_text(member).select("*", *blank), ["comp", "block"], width, percent))
    large = member.where("blocks > 1")
    if large.limit(1).count():
        links = first.join(large.select(F.col("doc_id").alias("node")).distinct(), "node", "left_semi")
        label = large.join(links.withColumnsRenamed({"node": "doc_id", "root": "label"}), "doc_id")
        # One document of each component of each block: groups of copies that blocks parted meet here.
        heads = label.where("doc_id = label").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("blocks") / 2)).cast("int"))
        met = _linked(with_text(heads).withColumn("across", F.lit(-1)), ["comp", "block"], width, percent)
        links = written(links.union(met))
        label = large.join(components(links.toDF("a", "b")).withColumnsRenamed({"node": "doc_id", "root": "label"}), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
        still = label.groupBy("comp").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("comp")
        # All pairs of blocks, for groups that still are several components.
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        pairs = with_text(label.join(still, "comp", "left_semi")).select("*", F.col("block").alias("across"), other).where("other <> block")
        pairs = pairs.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
        crossed = _linked(pairs, ["comp", "lo", "hi"], width, percent)
        roots = components(links.union(crossed).toDF("a", "b"))
        single = first.join(large.select(F.col("doc_id").alias("node")).distinct(), "node", "left_anti")
        first = single.union(roots)
    roots = first.groupBy(F.col("node").alias("doc_id")).agg(F.min("root").alias("root"))
    of_class = written(classes.select(*key, "doc_id", "members").join(roots, "doc_id", "left").select(*key, "members", F.coalesce("root", "doc_id").alias("component")))
    # A class that many rows share would meet them all in one task: such classes go to their rows. There are fewer than BROADCAST_ROWS.
    copies = max(COPIES, table.count() // BROADCAST_ROWS)
    met = table.drop("need", "prefix").join(F.broadcast(of_class.where(F.col("members") > copies).drop("members")), key, "left")
    others = met.where("component is null").drop("component").join(of_class.where(F.col("members") <= copies).drop("members"), key, "left")
    return met.where("component is not null").unionByName(others).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
