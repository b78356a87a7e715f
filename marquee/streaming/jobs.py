"""Time-driven work as Structured Streaming jobs; each has a batch form of the same meaning."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import AtomicType
from pyspark.sql.window import Window

from .. import on_workers
from ..functions.dates import overdue
from ..operators.tables import BucketedTable, latest, upsert

WINDOW_SECONDS, MOST_IN_WINDOW = 600, 5
DEFAULT_LIMIT = 100
DAY_SECONDS = 86_400


# T1: landed payload files


def upsert_each(keys: list[str], read: Callable[[], DataFrame], write: Callable[[DataFrame], None], changed: list[str] | None = None):
    """A foreachBatch function: of a batch the last pull of each key goes into the table that read() gives."""

    def batch(df: DataFrame, _: int) -> None:
        write(upsert(read(), last_pulls(df, keys), keys, changed))

    return batch


def last_pulls(df: DataFrame, keys: list[str]) -> DataFrame:
    """The last pull of each key, without its time."""
    ties = [F.col(c) for c in df.columns if c not in (*keys, "pulled_at") and isinstance(df.schema[c].dataType, AtomicType)]
    return latest(df, keys, F.desc("pulled_at"), *ties).drop("pulled_at")


def upsert_buckets(table: BucketedTable, changed: list[str] | None = None):
    """A foreachBatch function: the last pull of each key goes into the buckets of the table that it falls in, once a batch."""

    def batch(df: DataFrame, n: int) -> None:
        table.upsert(last_pulls(df, list(table.keys)), n, changed)

    return batch


# T2: late and repeated pulls


def fresh(stream: DataFrame, keys: list[str], hours: int = 24) -> DataFrame:
    """Pulls whose listing did not start more than `hours` before the pull, each key once within the watermark."""
    limit = F.col("pulled_at") - F.expr(f"INTERVAL {hours} HOURS")
    kept = stream.where(F.col("start_at") >= limit)
    return kept.withWatermark("pulled_at", f"{hours} hours").dropDuplicatesWithinWatermark(keys) if stream.isStreaming else latest(kept, keys, F.col("pulled_at"))


# T3: calls of API keys


def calls_by_day(calls: DataFrame, keys: DataFrame) -> DataFrame:
    """api_key, day, calls, over: calls(api_key, ts) of active keys(api_key, call_limit, is_active) by UTC day."""
    known = keys.where("is_active").select("api_key", F.coalesce("call_limit", F.lit(DEFAULT_LIMIT)).alias("call_limit"))
    rows = calls.withWatermark("ts", "1 day") if calls.isStreaming else calls
    counted = rows.groupBy(F.window("ts", "1 day").alias("w"), "api_key").agg(F.count("*").alias("calls"))
    joined = counted.join(known, "api_key")
    return joined.select("api_key", F.col("w.start").alias("day"), "calls", (F.col("calls") > F.col("call_limit")).alias("over"))


def judged_calls(calls: DataFrame, keys: DataFrame) -> DataFrame:
    """request_id, verdict: unauthorized, blocked (the limit of the UTC day is used up) or ok; in (ts, request_id) order."""
    n = F.row_number().over(Window.partitionBy("api_key", F.to_date("ts")).orderBy("ts", "request_id"))
    rows = calls.join(keys, "api_key", "left").withColumn("n", n)
    known = F.coalesce("is_active", F.lit(False))
    return rows.select("request_id", F.when(~known, "unauthorized").when(F.col("n") > F.coalesce("call_limit", F.lit(DEFAULT_LIMIT)), "blocked").otherwise("ok").alias("verdict"))


class CallLimit(StatefulProcessor):
    """How many calls of a key and UTC day were let through; a timer at the day's end drops the count.

    Of a trigger's calls those that may still pass are held, the first ones in (ts, request_id) order and as many as the limit
    leaves; the others are blocked as they come. So a key with any number of calls takes a batch and its limit of memory.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.passed = handle.getValueState("passed", "calls int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        passed = self.passed.get()[0] if self.passed.exists() else 0
        held = None
        for part in rows:
            part = part[["ts", "request_id", "call_limit"]]
            part = (part if held is None else pd.concat([held, part])).sort_values(["ts", "request_id"])
            left = max(0, int(part.call_limit.iloc[0]) - passed)
            held = part[:left]
            yield pd.DataFrame({"request_id": part.request_id[left:], "verdict": "blocked"})
        self.passed.update((passed + len(held),))
        if key[1] is not None:
            self.handle.registerTimer((int(key[1]) + 1) * DAY_SECONDS * 1000)
        yield pd.DataFrame({"request_id": held.request_id, "verdict": "ok"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.passed.clear()
        yield from ()

    def close(self) -> None:
        pass


def judged_stream(calls: DataFrame, keys: DataFrame, late: str = "1 hour") -> DataFrame:
    """`judged_calls` of a stream of calls(request_id, ts timestamp, api_key): each call is judged as its trigger comes.

    Equal to the batch form where triggers come in the order of ts. A call that comes more than `late` behind the latest one is
    dropped; calls without a time count as one day that never ends. Calls of unknown and inactive keys are judged without
    state. Needs the RocksDB state store.
    """
    on_workers(calls.sparkSession)
    known = F.coalesce("is_active", F.lit(False))
    rows = calls.withWatermark("ts", late).join(keys.select("api_key", "call_limit", "is_active"), "api_key", "left")
    limited = rows.where(known).select("request_id", "ts", "api_key", F.coalesce("call_limit", F.lit(DEFAULT_LIMIT)).alias("call_limit"), F.floor(F.unix_seconds("ts") / DAY_SECONDS).alias("day"))
    judged = limited.groupBy("api_key", "day").transformWithStateInPandas(CallLimit(), "request_id long, verdict string", "Append", "EventTime")
    return judged.union(rows.where(~known).select("request_id", F.lit("unauthorized")))


# T4: submissions of a client


def _next(state: tuple[float, int] | None, at: float) -> tuple[tuple[float, int], bool]:
    """(next state, allowed) of (window end, calls in it): the first call opens a window, the next one after its end a new one."""
    if state is None or at > state[0]:
        return (at + WINDOW_SECONDS, 1), True
    return (state, False) if state[1] >= MOST_IN_WINDOW else ((state[0], state[1] + 1), True)


class SubmissionLimit(StatefulProcessor):
    """The limit as state for each client; an hour without a call drops it.

    A trigger's calls of one client are put in order, their times and ids alone; the source's trigger options bound them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "ends double, calls int", ttlDurationMs=3_600_000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        state = self.window.get() if self.window.exists() else None
        state = tuple(state) if state else None
        calls = pd.concat([part[["ts", "request_id"]] for part in rows]).sort_values(["ts", "request_id"])
        verdicts = []
        for ts in calls.ts:
            state, allowed = _next(state, ts.timestamp())
            verdicts.append(allowed)
        self.window.update(state)
        yield pd.DataFrame({"request_id": calls.request_id, "allowed": verdicts})

    def close(self) -> None:
        pass


def limited_stream(calls: DataFrame) -> DataFrame:
    """request_id, allowed of a stream of calls(request_id, ts, client_ip). Needs the RocksDB state store."""
    on_workers(calls.sparkSession)
    return calls.groupBy("client_ip").transformWithStateInPandas(SubmissionLimit(), "request_id long, allowed boolean", "Append", "ProcessingTime")


def limited(calls: DataFrame) -> DataFrame:
    """The same of a table, without collecting a client's calls: sorted partitions are folded a batch at a time.

    Only the open window is carried from row to row, so a client with any number of calls takes constant memory.
    """
    on_workers(calls.sparkSession)

    def fold(batches):
        key, state = None, None
        for pdf in batches:
            allowed = []
            for ip, ts in zip(pdf.client_ip, pdf.ts, strict=True):
                if ip != key:
                    key, state = ip, None
                state, ok = _next(state, ts.timestamp())
                allowed.append(ok)
            yield pd.DataFrame({"request_id": pdf.request_id, "allowed": allowed})

    rows = calls.select("client_ip", F.col("ts").cast("timestamp").alias("ts"), "request_id")
    return rows.repartition("client_ip").sortWithinPartitions("client_ip", "ts", "request_id").mapInPandas(fold, "request_id long, allowed boolean")


# T5: expiry at each trigger


def expire_each(as_of: Callable[[], str], write: Callable[[DataFrame], None]):
    """A foreachBatch function that writes the ids to expire."""

    def batch(df: DataFrame, _: int) -> None:
        write(df.where(overdue(as_of())).select("id", F.lit("expired").alias("status")))

    return batch


# T6: errors of sources over time


def errors_by_window(log: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, type, total, errors of log(ts, type, status) in tumbling windows."""
    rows = log.withWatermark("ts", late) if log.isStreaming else log
    g = rows.groupBy(F.window("ts", length).alias("w"), "type").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "error").alias("errors"))
    return g.select(F.col("w.start").alias("start"), "type", "total", "errors")
