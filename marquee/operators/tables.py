"""Upserts and set operations on keyed tables: new snapshots from joins, never row-by-row updates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def latest(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row for each key: the first in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], changed: list[str] | None = None) -> DataFrame:
    """old with new's rows put in by key; of rows in both, new's columns (or only `changed`) replace the old ones."""
    o, n = old.withColumn("_old", F.lit(True)).alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    both = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    take = set(old.columns if changed is None else changed)

    def column(c: str):
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c not in new.columns:
            return a.alias(c)
        use_new = F.col("n._new").isNotNull() & (F.lit(c in take) | F.col("o._old").isNull())
        return F.when(use_new, b).otherwise(a).alias(c)

    return both.select(*(column(c) for c in old.columns))


@dataclass(frozen=True)
class BucketedTable:
    """A table in hash buckets of its keys, under a shared folder. An upsert reads and writes the buckets that its rows fall in.

    A batch's buckets go to data/batch=N/bucket=B; then the ledger, a table of (batch, bucket), gets its rows in one file. A
    bucket's content is that of its last batch in the ledger. So files of other buckets stay as they are, a batch that broke
    off before its ledger entry was never there and is written anew, and a replayed batch changes nothing. Files that no longer
    count are left in place. One writer at a time; batches come in ascending order.
    """

    spark: SparkSession
    path: str
    schema: StructType
    keys: tuple[str, ...]
    buckets: int = 256

    def ledger(self) -> DataFrame:
        """batch, bucket (-1 in a batch without rows)."""
        fields = "batch long, bucket int"
        try:
            return self.spark.read.schema(fields).parquet(f"{self.path}/ledger")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], fields)

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets."""
        last = self.ledger().where("bucket >= 0").groupBy("bucket").agg(F.max("batch").alias("batch"))
        folders = [f"{self.path}/data/batch={r.batch}/bucket={r.bucket}" for r in last.collect() if only is None or r.bucket in only]  # as many as buckets
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def upsert(self, new: DataFrame, batch: int, changed: list[str] | None = None) -> bool:
        """Puts new's rows (one for each key) in by key, as `upsert`; False, and nothing done, if the batch is in already."""
        seen = self.ledger().agg(F.max("batch"), F.max((F.col("batch") == batch).cast("int"))).first()
        if seen[1]:
            return False
        if seen[0] is not None and batch < seen[0]:
            raise ValueError(f"batch {batch} comes after {seen[0]}")
        bucket = F.pmod(F.xxhash64(*(F.col(k).cast(self.schema[k].dataType) for k in self.keys)), F.lit(self.buckets)).cast("int")
        touched = [r[0] for r in new.select(bucket).distinct().collect()]
        if touched:
            rows = upsert(self.read(touched), new, list(self.keys), changed).withColumn("bucket", bucket)
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={batch}")
        self._record(batch, touched or [-1])
        return True

    def _record(self, batch: int, touched: list[int]) -> None:
        rows = self.spark.createDataFrame([(batch, b) for b in touched], "batch long, bucket int")
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")


def split_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of new whose key is in old, those whose key is not)."""
    known = old.select(*keys).distinct()
    return new.join(known, keys, "left_semi"), new.join(known, keys, "left_anti")


def minus(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def first_alias(aliases: DataFrame, *order) -> DataFrame:
    """The first alias of each normalized form."""
    return latest(aliases, ["normalized_alias"], *order)
