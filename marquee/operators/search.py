"""Search through a stored index: a query reads the postings of its own trigrams, not every listing.

Titles and venue names are indexed once each, as distinct lower-cased texts. Three tables in hash buckets, in a shared folder:
postings (gram, text), texts, and occurrences (text, listing). A text shares a gram with the query or is as unlike as 0, and
a text that holds the query holds all whole trigrams inside the query's words; so the postings find every match. Only a query
without a word of three characters has to look through the distinct texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trigrams
from .feed import LEAST_RELEVANCE, SHORTEST_SIMILAR

BUCKETS = 64


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _bucket(c: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def _inner(text: Column) -> Column:
    """Trigrams inside the words, without blanks at their ends."""
    return F.filter(trigrams(text), lambda g: ~F.contains(g, F.lit(" ")))


@dataclass(frozen=True)
class SearchIndex:
    """An index under `path`, as `build` leaves it; `id_type` is the type of the listings' id."""

    spark: SparkSession
    path: str
    id_type: str = "bigint"
    buckets: int = BUCKETS

    @classmethod
    def build(cls, listings: DataFrame, path: str, buckets: int = BUCKETS) -> SearchIndex:
        """Indexes listings(id, title, venue_name) into a new folder. Frequent grams and texts are split over files by Spark's rebalancing.

        Null titles and names are not indexed. Texts are written last, so a folder that has them is whole.
        """
        index = cls(listings.sparkSession, path.rstrip("/"), listings.schema["id"].dataType.simpleString(), buckets)
        rows = listings.select("id", F.lower("title").alias("title"), F.lower("venue_name").alias("venue"))
        sides = [(F.col("title"), F.col("venue")), (F.col("venue"), F.col("title"))]
        occurs = F.explode(F.array(*(F.struct(_key(a).alias("key"), _key(b).alias("other")) for a, b in sides))).alias("at")
        occurrences = rows.select("id", occurs).where("at.key is not null").select("at.key", "id", "at.other")
        index._write(occurrences, "occurrences", "key")
        texts = rows.select(F.explode(F.array("title", "venue")).alias("text")).where("text is not null").distinct()
        texts = texts.select(_key(F.col("text")).alias("key"), "text", trigrams(F.col("text")).alias("grams"))
        postings = texts.select("key", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
        index._write(postings.select("gram", "key", "n"), "postings", "gram")
        index._write(texts.select("key", "text"), "texts", "key")
        return index

    def _write(self, rows: DataFrame, name: str, by: str) -> None:
        rows = rows.withColumn("bucket", _bucket(F.col(by), self.buckets)).hint("rebalance", F.col("bucket"))
        rows.sortWithinPartitions("bucket", by).write.partitionBy("bucket").parquet(f"{self.path}/{name}")

    def _read(self, name: str) -> DataFrame:
        fields = {"postings": "gram string, key binary, n int", "texts": "key binary, text string", "occurrences": f"key binary, id {self.id_type}, other binary"}
        return self.spark.read.schema(f"{fields[name]}, bucket int").parquet(f"{self.path}/{name}")

    def postings(self, grams: list[str] | None = None) -> DataFrame:
        """gram, key, n (the text's grams): all, or those of some grams, from their buckets alone."""
        rows = self._read("postings")
        if grams is None:
            return rows
        q = self.spark.range(1).select(F.transform(F.lit(grams).cast("array<string>"), lambda g: _bucket(g, self.buckets))).first()
        return rows.where(F.col("bucket").isin(q[0]) & F.col("gram").isin(grams))

    def search(self, search: str) -> DataFrame:
        """id, relevance of the listings that `feed.search_matches` allows, once each."""
        text = F.lit(search)
        q = self.spark.range(1).select(F.lower(text).alias("text"), trigrams(text).alias("grams"), _inner(text).alias("inner")).first()
        shared = self.postings(q.grams).groupBy("key").agg(F.count("*").alias("shared"), F.count_if(F.col("gram").isin(q.inner)).alias("inside"), F.first("n").alias("n"))
        scored = shared.select("key", "inside", (F.col("shared") / (F.col("n") + len(q.grams) - F.col("shared"))).alias("relevance"))
        texts = self._read("texts")
        if q.inner:
            whole = scored.where(F.col("inside") == len(q.inner)).select("key", _bucket(F.col("key"), self.buckets).alias("bucket"))
            texts = texts.join(whole, ["bucket", "key"], "left_semi")
        hits = texts.where(F.contains("text", F.lit(q.text))).select("key")
        if len(search) >= SHORTEST_SIMILAR:
            hits = hits.union(scored.where(F.col("relevance") > LEAST_RELEVANCE).select("key")).distinct()
        found = self._read("occurrences").join(hits.withColumn("bucket", _bucket(F.col("key"), self.buckets)), ["bucket", "key"], "left_semi")
        sides = found.select("id", F.explode(F.array("key", "other")).alias("key")).distinct()
        best = sides.join(scored.select("key", "relevance"), "key", "left").groupBy("id").agg(F.max("relevance").alias("relevance"))
        return best.select("id", F.coalesce("relevance", F.lit(0.0)).alias("relevance"))
