"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment.

Items are partitioned by size: class c holds those of 2^c to 2^(c+1) - 1 shingles. An item of n shingles keeps its m
least hashes, m = k + max(1, k/2) of n at most, k = n - ceil(t n) + 1: a document that holds the share t of the item
misses k - 1 at most, so it holds m - k + 1 of the sketch or more. A class's limit is the greatest hash in its sketches,
its floor the fewest shingles that a document must share with one of its items. A document's sketch is its hashes up to
the limit of the classes whose floor it reaches: a MinHash sketch that grows with the document, so that a short item shows
inside a long one, where sketches of fixed size would not. No document is lost (recall is 1 for any t); exact containment
on the shingles' words follows for those found. Items of fewer than `width` words are shingled by their own length.

Only DataFrame functions. Nulls: a null or wordless text or item has no shingle and matches nothing; rows with a null
doc_id are never reported, those with a null item_id neither. Rows with one doc_id count as one document if either holds
the item. An empty table on either side gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import written

BROADCAST_ROWS = 1_000_000  # rows of two longs up to which a side is broadcast; beyond, a shuffled join
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z as a-z; none of a null text."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "[\\x20\\x09-\\x0D]+"), "")


def _windows(w: Column, width: int, of) -> Column:
    """of(the words of each window), an array."""
    at = F.when(F.size(w) >= width, F.sequence(F.lit(0), F.size(w) - width)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: of([F.get(w, i + j) for j in range(width)])))


def _bound(w: Column, use) -> Column:
    """use(w), with w worked out once."""
    return F.get(F.transform(F.array(w), use), F.lit(0))


def hashed(w: Column, width: int) -> Column:
    return _bound(w, lambda v: _windows(v, width, lambda x: F.xxhash64(*x)))


def spelled(w: Column, width: int) -> Column:
    return _bound(w, lambda v: _windows(v, width, lambda x: F.concat_ws(" ", *x)))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def find_contained(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, item_id, n_item (the item's shingles), n_shared (of them in the document), where 100 n_shared >= percent n_item."""
    docs = docs.select(F.col("doc_id").cast("long"), "text").where(F.col("doc_id").isNotNull())
    items = items.select("item_id", words(F.col("text")).alias("w")).where("item_id is not null").distinct()
    items = items.withColumn("width", F.least(F.size("w"), F.lit(width))).where("width > 0").withColumn("version", F.xxhash64("w"))
    found = None
    for row in items.select("width").distinct().orderBy("width").collect():  # as many as `width` at most
        k = row["width"]
        got = _of_width(docs, items.where(F.col("width") == k), k, percent)
        found = got if found is None else found.union(got)
    return found if found is not None else docs.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("n_item"), F.lit(0).alias("n_shared")).where("false")


def sketches(items: DataFrame, width: int, percent: int) -> DataFrame:
    """item_id, version, size_class, floor, need, sketch (sorted hashes) for items(item_id, version, w)."""
    n, k = F.size("h"), F.col("k")
    sized = items.withColumn("h", F.array_sort(hashed(F.col("w"), width))).withColumn("floor", F.ceil(n * percent / 100).cast("int")).withColumn("k", n - F.col("floor") + 1)
    sized = sized.withColumn("m", F.least(n, k + F.greatest(F.lit(1), F.floor(k / 2).cast("int"))))
    return sized.select("item_id", "version", F.floor(F.log2(n)).cast("int").alias("size_class"), "floor", (F.col("m") - k + 1).alias("need"), F.slice("h", 1, F.col("m")).alias("sketch"))


def document_sketch(text: Column, width: int, classes: list) -> Column:
    """A document's hashes up to the limit of the size classes that it is large enough for."""

    def limit(h: Column) -> Column:
        lowest = F.lit(-(1 << 63))
        return F.greatest(lowest, lowest, *(F.when(F.size(h) >= c["floor"], F.lit(c["limit"])).otherwise(lowest) for c in classes))

    return _bound(hashed(words(text), width), lambda h: _bound(limit(h), lambda most: F.filter(h, lambda x: x <= most)))


def _of_width(docs: DataFrame, items: DataFrame, width: int, percent: int) -> DataFrame:
    sized = sketches(items, width, percent)
    classes = sized.groupBy("size_class").agg(F.min("floor").alias("floor"), F.max(F.element_at("sketch", -1)).alias("limit")).collect()  # one for each power of two
    sketch = sized.select("item_id", "version", "need", F.explode("sketch").alias("hash"))

    seen = docs.select("doc_id", F.explode(document_sketch(F.col("text"), width, classes)).alias("hash"))
    hits = seen.join(_small(sketch), "hash").groupBy("doc_id", "item_id", "version").agg(F.count("*").alias("hits"), F.first("need").alias("need"))
    pairs = written(hits.where("hits >= need").select("doc_id", "item_id", "version"))

    texts = docs.join(_small(pairs.select("doc_id").distinct()), "doc_id", "left_semi")
    full = texts.select("doc_id", spelled(words(F.col("text")), width).alias("s"))
    exact = pairs.join(full, "doc_id").join(items.select("item_id", "version", spelled(F.col("w"), width).alias("t")), ["item_id", "version"])
    exact = exact.select("doc_id", "item_id", F.size("t").alias("n_item"), F.size(F.array_intersect("t", "s")).alias("n_shared"))
    return exact.where(100 * F.col("n_shared") >= percent * F.col("n_item")).groupBy("doc_id", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared"))
