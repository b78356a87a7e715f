"""Small helpers that operators share: Arrow batches in and out, and tables in the shared folder."""

from __future__ import annotations

import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .. import on_workers


_loaded: list = []
_stage: int | None = None


def kept_for_stage(load):
    """functools.cache for what a worker loads or learns; the next Spark stage that runs in the worker starts without it."""
    cached = functools.cache(load)
    _loaded.append(cached)
    return cached


def enter_stage(number: int) -> None:
    global _stage
    if number != _stage:
        for f in _loaded:
            f.cache_clear()
        gc.collect()
        _stage = number


SLICE_BYTES = 2_000_000


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about SLICE_BYTES each, so that working arrays stay small whatever a row's size is."""
    if batch.nbytes <= SLICE_BYTES or batch.num_rows < 2:
        if batch.num_rows:
            yield batch
        return
    half = batch.num_rows // 2
    yield from slices(batch.slice(0, half))
    yield from slices(batch.slice(half))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]], schema: str) -> DataFrame:
    """df.mapInArrow with one state for each task: make() returns a function of a batch that yields dicts of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    on_workers(df.sparkSession)
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        from pyspark import TaskContext

        enter_stage(TaskContext.get().stageId())
        step = make()
        for batch in (x for whole in batches for x in slices(whole)):
            for cols in step(batch):
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in ((f, cols[f.name]) for f in kinds)], schema=kinds)

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, or a temporary one where that is unset and the master local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/marquee-checkpoints"
    return f"{root.rstrip('/')}/marquee-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table of ours that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, codec: str = "zstd", path: str | None = None) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends here, and a lost executor loses nothing."""
    path = path or shared_folder(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
