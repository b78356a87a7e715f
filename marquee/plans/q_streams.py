"""Batch forms of the streaming jobs: T. tests/ holds that the streams give the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import jobs
from .registry import query
from .testviews import AS_OF, view


def api_keys(spark, sf_dir):
    k = view(spark, sf_dir, "requests_v").select("api_key").distinct().withColumn("n", F.expr("cast(substring(api_key, 5) as long)"))
    return k.where("n % 7 <> 0").select("api_key", (F.col("n") % 3 + 1).cast("int").alias("call_limit"), (F.col("n") % 5 != 0).alias("is_active"))


_KEYS = "(SELECT DISTINCT api_key, CAST(substring(api_key, 5) AS BIGINT) AS n FROM requests_v)"


@query("t1_ingest", "SELECT user_id, arg_max(event_type, (ts, -event_id)) AS event_type FROM events GROUP BY user_id")
def t1(spark, sf_dir):
    from ..operators.tables import latest

    return latest(view(spark, sf_dir, "events"), ["user_id"], F.desc("ts"), F.col("event_id")).select("user_id", "event_type")


@query("t1_upserted_batch", "SELECT user_id, coalesce(max(event_type) FILTER (WHERE k = 1 AND NOT old), max(event_type) FILTER (WHERE k = 1 AND old)) AS event_type, coalesce(max(event_id) FILTER (WHERE k = 1 AND old), max(event_id) FILTER (WHERE k = 1 AND NOT old)) AS event_id FROM (SELECT *, event_id % 3 = 0 AS old, row_number() OVER (PARTITION BY user_id, event_id % 3 = 0 ORDER BY ts DESC, event_id) AS k FROM events) GROUP BY user_id")
def t1_batch(spark, sf_dir):
    """One batch of the ingest job over a table of earlier pulls: the type follows the last pull, the id stays."""
    from ..operators.tables import latest

    e = view(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.col("ts").alias("pulled_at"))
    old = latest(e.where("event_id % 3 = 0"), ["user_id"], F.desc("pulled_at"), F.col("event_id")).drop("pulled_at")
    out: list = []
    jobs.upsert_each(["user_id"], lambda: old, out.append, changed=["event_type"])(e.where("event_id % 3 <> 0"), 0)
    return out[0]


@query("t2_fresh_pulls", "SELECT user_id, min(ts) AS pulled_at FROM events WHERE event_id % 4 <> 0 GROUP BY user_id")
def t2(spark, sf_dir):
    e = view(spark, sf_dir, "events")
    start = F.when(F.col("event_id") % 4 == 0, F.col("ts") - F.expr("INTERVAL 25 HOURS")).otherwise(F.col("ts") - F.expr("INTERVAL 23 HOURS"))
    return jobs.fresh(e.select("user_id", F.col("ts").alias("pulled_at"), start.alias("start_at")), ["user_id"]).select("user_id", "pulled_at")


@query("t3_calls_by_day", f"SELECT api_key, date_trunc('day', ts) AS day, count(*) AS calls, count(*) > max(n % 3 + 1) AS over FROM requests_v JOIN {_KEYS} USING (api_key) WHERE n % 7 <> 0 AND n % 5 <> 0 GROUP BY 1, 2")
def t3(spark, sf_dir):
    out = jobs.calls_by_day(view(spark, sf_dir, "requests_v"), api_keys(spark, sf_dir))
    return out.withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("t3_judged_calls", f"SELECT request_id, CASE WHEN n % 7 = 0 OR n % 5 = 0 THEN 'unauthorized' WHEN row_number() OVER (PARTITION BY api_key, CAST(ts AS DATE) ORDER BY ts, request_id) > n % 3 + 1 THEN 'blocked' ELSE 'ok' END AS verdict FROM requests_v JOIN {_KEYS} USING (api_key)")
def t3_judged(spark, sf_dir):
    return jobs.judged_calls(view(spark, sf_dir, "requests_v"), api_keys(spark, sf_dir))


@query("t4_submission_limit", """WITH RECURSIVE w(client_ip, opens) AS (SELECT client_ip, min(ts) FROM requests_v GROUP BY client_ip
UNION ALL SELECT * FROM (SELECT w.client_ip, (SELECT min(c.ts) FROM requests_v c WHERE c.client_ip = w.client_ip AND c.ts > w.opens + INTERVAL 10 MINUTE) AS opens FROM w) WHERE opens IS NOT NULL),
c AS (SELECT r.request_id, r.client_ip, r.ts, max(w.opens) AS opens FROM requests_v r JOIN w ON w.client_ip = r.client_ip AND w.opens <= r.ts GROUP BY ALL)
SELECT request_id, row_number() OVER (PARTITION BY client_ip, opens ORDER BY ts, request_id) <= 5 AS allowed FROM c""")
def t4(spark, sf_dir):
    return jobs.limited(view(spark, sf_dir, "requests_v").withColumn("ts", F.col("ts").cast("timestamp")))


@query("t5_expiry", f"SELECT id FROM listings_v WHERE status = 'active' AND (end_at < TIMESTAMP '{AS_OF}' OR (end_at IS NULL AND start_at < TIMESTAMP '{AS_OF}' - INTERVAL 6 HOUR))")
def t5(spark, sf_dir):
    from ..functions.dates import overdue

    return view(spark, sf_dir, "listings_v").where(overdue(AS_OF)).select("id")


@query("t6_source_errors", "SELECT date_trunc('hour', ts) AS start, CAST(user_id % 4 AS BIGINT) AS type, count(*) AS total, CAST(count_if(event_type = 'error') AS BIGINT) AS errors FROM events GROUP BY 1, 2")
def t6(spark, sf_dir):
    log = view(spark, sf_dir, "events").select("ts", (F.col("user_id") % 4).alias("type"), F.col("event_type").alias("status"))
    return jobs.errors_by_window(log).withColumn("start", F.col("start").cast("timestamp_ntz"))
