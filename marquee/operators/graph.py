"""Over match pairs: connected components, greedy passes as rounds, ordered walks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import on_workers


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where it is unset and the master local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (root or f"file://{tempfile.gettempdir()}/marquee-checkpoints").rstrip("/")


SMALL = 200_000  # rows of a written table up to which Spark may broadcast it


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again. Of more than SMALL rows it is joined by shuffles."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/pairs-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return shuffled(out) if out.count() > SMALL else out


def shuffled(df: DataFrame) -> DataFrame:
    """df, of which a join shuffles both sides, however small it looks.

    Spark broadcasts by the size of files. Tables of repeated values take many times that in memory, and a broadcast is put
    together in the driver.
    """
    return df.hint("merge")


def sorted_walk(rows: DataFrame, key: str, columns: list[str], order: list, make: Callable, schema: str) -> DataFrame:
    """Each key's rows in order through a walker of its own: make() has row(*columns) and end(), which return output tuples.

    Rows are streamed, so a key with any number of them takes the memory of a batch and of its walker; output goes by batches,
    however many keys a batch holds.
    """
    on_workers(rows.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        now, walker = None, None
        for pdf in batches:
            out = []
            for k, *row in zip(*(pdf[c].tolist() for c in (key, *columns)), strict=True):
                if walker is None or k != now:
                    out += walker.end() if walker else []
                    now, walker = k, make()
                out += walker.row(*row)
            yield pd.DataFrame(out, columns=names)
        if walker:
            yield pd.DataFrame(walker.end(), columns=names)

    return rows.select(key, *columns, *(o for o in order if o not in (key, *columns))).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


OPEN, HEAD, FOLDED = 0, 1, 2


class _Heads:
    """Heads among rows in order: a row is one if no earlier neighbour and no earlier row of its group is."""

    def __init__(self):
        self.heads, self.groups = set(), set()

    def row(self, i, group, earlier):
        if (group is not None and group in self.groups) or any(u in self.heads for u in (earlier if earlier is not None else ())):
            return [(i, FOLDED)]
        self.heads.add(i)
        self.groups.add(group)
        return [(i, HEAD)]

    def end(self):
        return []


def greedy_heads(nodes: DataFrame, edges: DataFrame, rounds: int = 12) -> DataFrame:
    """id, head of nodes(id, place, group): what a loop over nodes in order of place does, where each folds into the first
    head before it that it has an edge with, or that is of its group (null: of none), and else is a head.

    edges(u, v): u comes before v. In each round every open node without an open neighbour before it is decided, all over
    the table at once; the states are written. Rounds grow with the longest chain of open nodes; what is open after `rounds`
    of them is walked in order, component by component.
    """
    edges = checkpointed(edges.distinct())
    status = checkpointed(nodes.select("id", "place", "group", F.lit(OPEN).alias("state")))
    for n in range(rounds + 1):
        open_ = status.where(F.col("state") == OPEN)
        if open_.isEmpty():
            break
        before = edges.join(open_.select(F.col("id").alias("v")), "v").join(status.select(F.col("id").alias("u"), "state"), "u")
        seen = before.groupBy(F.col("v").alias("id")).agg(F.max(F.col("state") == HEAD).alias("hit"), F.max(F.col("state") == OPEN).alias("wait"))
        grouped = status.where("group is not null").groupBy("group").agg(F.min(F.when(F.col("state") == OPEN, F.struct("place", "id"))).alias("least"), F.max(F.col("state") == HEAD).alias("led"))
        both = open_.drop("state").join(seen, "id", "left").join(grouped, "group", "left")
        state = F.when(F.coalesce("hit", F.lit(False)) | F.coalesce("led", F.lit(False)), FOLDED).when(F.coalesce("wait", F.lit(False)) | F.coalesce(F.col("least.id") != F.col("id"), F.lit(False)), OPEN).otherwise(HEAD)
        decided = both.select("id", "place", "group", state.alias("state"))
        if n == rounds:
            decided = checkpointed(decided)
            decided = decided.where(F.col("state") == FOLDED).unionByName(_walked(decided.where(F.col("state") != FOLDED), edges))
        status = checkpointed(status.where(F.col("state") != OPEN).unionByName(decided))
    heads, folded = status.where(F.col("state") == HEAD), status.where(F.col("state") == FOLDED)
    first = F.struct("place", F.col("id").alias("head"))
    by_edge = edges.join(heads.select(F.col("id").alias("u"), first.alias("x")), "u").select(F.col("v").alias("id"), "x")
    by_group = folded.select("id", "group").join(heads.where("group is not null").select("group", first.alias("x")), "group").select("id", "x")
    into = by_edge.join(folded.select("id"), "id", "left_semi").unionByName(by_group).groupBy("id").agg(F.min("x").alias("x"))
    return into.select("id", F.col("x.head").alias("head")).unionByName(heads.select("id", F.col("id").alias("head")))


def _walked(open_: DataFrame, edges: DataFrame) -> DataFrame:
    """The open nodes with their states, by walks over components of what is open."""
    ids = open_.select("id")
    inner = edges.join(ids.toDF("u"), "u", "left_semi").join(ids.toDF("v"), "v", "left_semi")
    least = open_.where("group is not null").groupBy("group").agg(F.min("id").alias("a"))
    star = open_.join(least, "group").select("a", F.col("id").alias("b"))
    roots = components(inner.toDF("a", "b").unionByName(star)).withColumnRenamed("node", "id")
    earlier = inner.groupBy(F.col("v").alias("id")).agg(F.collect_set("u").alias("earlier"))
    rows = open_.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")).join(earlier, "id", "left")
    got = sorted_walk(rows, "root", ["id", "group", "earlier"], ["place"], _Heads, f"id {open_.schema['id'].dataType.simpleString()}, state int")
    return open_.drop("state").join(got, "id")


def components(pairs: DataFrame, rounds: int = 50) -> DataFrame:
    """node, root (the least node of its component) of pairs(a, b).

    Labels spread along pairs and then jump to their label's label, until none changes.
    """
    both = checkpointed(pairs.select("a", "b").union(pairs.select("b", "a")).where("a <> b").distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    for _ in range(rounds):
        near = both.join(labels.toDF("b", "r"), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        spread = labels.join(near, "node").select("node", F.least("root", "r").alias("root"), F.col("root").alias("was"))
        jump = spread.join(labels.toDF("root", "next"), "root").select("node", F.least("root", "next").alias("root"), "was")
        new = checkpointed(jump)
        changed = new.where("root <> was").limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")
