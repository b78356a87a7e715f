"""Streams give what their batch forms give."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marquee.operators import tables
from marquee.plans.testviews import AS_OF, view
from marquee.streaming import jobs

SMALL = "/root/testdata/sf0.001"


def streamed(spark, df, path, tmp_path, name, job, mode="append"):
    df.coalesce(1).write.mode("overwrite").parquet(str(path))
    q = job(spark.readStream.schema(df.schema).parquet(str(path))).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def requests(spark):
    return view(spark, SMALL, "requests_v").withColumn("ts", F.col("ts").cast("timestamp"))


def test_source_errors(spark, tmp_path):
    log = requests(spark).select("ts", (F.col("request_id") % 3).alias("type"), F.when(F.col("request_id") % 5 == 0, "error").otherwise("active").alias("status"))
    got = streamed(spark, log, tmp_path / "a", tmp_path, "t6", jobs.errors_by_window, "update")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in jobs.errors_by_window(log).collect()}


def test_calls_by_day(spark, tmp_path):
    keys = requests(spark).select("api_key").distinct().select("api_key", F.lit(2).alias("call_limit"), F.lit(True).alias("is_active"))
    got = streamed(spark, requests(spark), tmp_path / "b", tmp_path, "t3", lambda s: jobs.calls_by_day(s, keys), "update")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in jobs.calls_by_day(requests(spark), keys).collect()}


def test_fresh_pulls(spark, tmp_path):
    e = requests(spark).select("api_key", F.col("ts").alias("pulled_at"), F.when(F.col("request_id") % 4 == 0, F.col("ts") - F.expr("INTERVAL 25 HOURS")).otherwise(F.col("ts")).alias("start_at"))
    one_day = e.where("date(pulled_at) = '2024-01-10'")
    got = streamed(spark, one_day.orderBy("pulled_at"), tmp_path / "c", tmp_path, "t2", lambda s: jobs.fresh(s, ["api_key"]))
    assert {r.api_key for r in got.collect()} == {r.api_key for r in jobs.fresh(one_day, ["api_key"]).collect()}


def test_upsert_and_expiry_batches(spark, tmp_path):
    state = {"table": spark.createDataFrame([(1, "a"), (2, "b")], "id long, status string")}
    batch = jobs.upsert_each(["id"], lambda: state["table"], lambda df: state.update(table=spark.createDataFrame(df.collect(), df.schema)))
    batch(spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id long, status string, pulled_at int"), 0)
    assert {tuple(r) for r in state["table"].collect()} == {(1, "a"), (2, "d"), (3, "e")}
    rows, out = view(spark, SMALL, "listings_v"), []
    jobs.expire_each(lambda: AS_OF, lambda df: out.extend(df.collect()))(rows, 0)
    assert len(out) == rows.where("status = 'active'").where(F.expr(f"end_at < timestamp_ntz '{AS_OF}' or (end_at is null and start_at < timestamp_ntz '{AS_OF}' - interval 6 hours)")).count()


def files(path):
    return {str(p) for p in (path / "data").rglob("*.parquet")}


def test_bucketed_upserts_touch_their_buckets_alone(spark, tmp_path):
    schema = "id long, kind string, n int, note string"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    table = tables.BucketedTable(spark, str(tmp_path / "t"), frame([]).schema, ("id", "kind"), 16)
    assert table.read().count() == 0
    rows = {(i, "k"): (i, "k", i, "old") for i in range(200)} | {(None, None): (None, None, 0, "old")}
    assert table.upsert(frame(list(rows.values())), 0)
    before = files(tmp_path / "t")
    new = [(7, "k", -7, "new"), (900, "k", 9, "new"), (None, None, 1, "new")]
    assert table.upsert(frame(new), 1) and not table.upsert(frame([(7, "k", 5, "again")]), 1)
    rows |= {r[:2]: r for r in new}
    assert {tuple(r) for r in table.read().collect()} == set(rows.values())
    assert before <= files(tmp_path / "t") and len({p.split("bucket=")[1].split("/")[0] for p in files(tmp_path / "t") - before}) <= 3
    untouched = {p.split("/data/")[1] for p in before} & {p.split("/data/")[1] for p in table.read().inputFiles()}
    assert len(untouched) >= 13  # of 16 buckets
    assert table.upsert(frame([(8, "k", -8, "part")]), 2, ["n"]) and table.upsert(frame([]), 3) and not table.upsert(frame(new), 3)
    assert {tuple(r) for r in table.read().where("id = 8").collect()} == {(8, "k", -8, "old")}
    with pytest.raises(ValueError):
        table.upsert(frame(new), -1)


def test_bucketed_ingest_restarts_after_a_broken_batch(spark, tmp_path, monkeypatch):
    """A batch breaks off between its data and its ledger entry: readers see the state before, the restarted stream the whole."""
    pulls = "id long, note string, pulled_at int"
    table = tables.BucketedTable(spark, str(tmp_path / "t"), spark.createDataFrame([], "id long, note string").schema, ("id",), 4)

    def land(rows):
        spark.createDataFrame(rows, pulls).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(pulls).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(jobs.upsert_buckets(table)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(90)

    def broken(*_):
        raise RuntimeError("lost")

    land([(1, "a", 1), (1, "b", 2), (2, "c", 1)])
    run()
    land([(2, "d", 3), (3, "e", 3)])
    with monkeypatch.context() as m:
        m.setattr(tables.BucketedTable, "_record", broken)
        with pytest.raises(Exception, match="lost"):
            run()
    assert {tuple(r) for r in table.read().collect()} == {(1, "b"), (2, "c")}
    run()
    assert {tuple(r) for r in table.read().collect()} == {(1, "b"), (2, "d"), (3, "e")}


def test_submission_limit_as_a_stream(spark, tmp_path):
    """Three runs from one checkpoint, a micro-batch each, give what the batch form gives of all calls.

    Timers by processing time ask for a next batch without end, so batches without data are off here.
    """
    at, schema = datetime(2024, 1, 1), "request_id long, ts timestamp, client_ip string"
    calls = [[(100 * k + i, at + timedelta(seconds=300 * k + i), f"c{i % 2}") for i in range(12)] for k in range(3)]
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        for rows in calls:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = jobs.limited_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
            q = stream.writeStream.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            try:
                assert q.awaitTermination(60)
            finally:
                q.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.request_id, r.allowed) for r in jobs.limited(spark.createDataFrame([r for rows in calls for r in rows], schema)).collect()}
    assert got == want and len({a for _, a in got}) == 2


def test_submission_limit_by_hand(spark):
    at = datetime(2024, 1, 1)
    seconds = [0, 1, 2, 3, 4, 5, 600, 601, 602]
    calls = spark.createDataFrame([(i, at + timedelta(seconds=s), "c") for i, s in enumerate(seconds)] + [(99, at, None)], "request_id long, ts timestamp, client_ip string")
    got = {r.request_id: r.allowed for r in jobs.limited(calls).collect()}
    assert [got[i] for i in range(9)] == [True] * 5 + [False, False, True, True] and got[99]


def test_calls_are_judged_as_a_stream(spark, tmp_path):
    """Three runs from one checkpoint over two days equal the batch form; counts of days gone by are dropped."""
    at, schema = datetime(2024, 1, 1, 12), "request_id long, ts timestamp, api_key string"
    keys = spark.createDataFrame([("a", 3, True), ("b", 0, True), ("c", None, True), ("d", 5, False)], "api_key string, call_limit int, is_active boolean")
    runs = [[(1000 * k + i, at + timedelta(hours=8 * (k // 2) + 24 * (k // 2) + 3 * (k % 2), seconds=30 * (i // 2)), "abcde"[i % 5] if i % 11 else None) for i in range(60 if k else 600)] for k in range(4)]
    for rows in (runs[0], runs[1], runs[2] + runs[3]):
        spark.createDataFrame(rows[::-1], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.judged_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), keys)
        q = stream.writeStream.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        try:
            assert q.awaitTermination(120)
        finally:
            q.stop()
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    calls = spark.createDataFrame([r for rows in runs for r in rows], schema)
    want = {(r.request_id, r.verdict) for r in jobs.judged_calls(calls, keys).collect()}
    assert len(got) == len(want) and set(got) == want and {v for _, v in got} == {"ok", "blocked", "unauthorized"}
    state = spark.read.format("statestore").option("stateVarName", "passed").load(str(tmp_path / "c"))
    first = at.timestamp() // 86400
    assert {r.key.day for r in state.select("key").collect()} == {first + 1}


def test_judging_holds_no_more_than_the_limit():
    """Parts of a trigger in any order: the first calls by (ts, request_id) pass, over all parts and triggers."""
    import pandas as pd

    class Value:
        kept = None

        def exists(self):
            return self.kept is not None

        def get(self):
            return self.kept

        def update(self, v):
            self.kept = v

    class Handle:
        timers: list = []

        def getValueState(self, *_):  # noqa: N802
            return Value()

        def registerTimer(self, ms):  # noqa: N802
            self.timers.append(ms)

    limit = jobs.CallLimit()
    limit.init(Handle())
    part = lambda rows: pd.DataFrame([(t, i, 3) for t, i in rows], columns=["ts", "request_id", "call_limit"])
    said = lambda parts: {i: v for out in limit.handleInputRows(("k", 2), iter(parts), None) for i, v in zip(out.request_id, out.verdict, strict=True)}
    assert said([part([(5, 1), (1, 9)]), part([(1, 8), (7, 2)])]) == {8: "ok", 9: "ok", 1: "ok", 2: "blocked"}
    assert said([part([(8, 3)])]) == {3: "blocked"} and Handle.timers == [3 * 86_400_000] * 2
