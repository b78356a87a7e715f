"""Views over the given tables that the catalogued queries read: the same text for Spark and for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-15 20:00:00"

VIEWS = {
    "venues_v": """
SELECT s_suppkey AS venue_id,
       CASE s_suppkey % 3
         WHEN 0 THEN concat('Hall ', CAST(100 + CAST(floor(s_suppkey / 3) AS BIGINT) AS STRING))
         WHEN 1 THEN concat('The Hall ', CAST(100 + CAST(floor(s_suppkey / 3) AS BIGINT) AS STRING), ' - Zone One')
         ELSE concat('HALL ', CAST(100 + CAST(floor(s_suppkey / 3) AS BIGINT) AS STRING), ' & Bar') END AS name,
       CASE WHEN s_suppkey % 8 = 7 THEN NULL ELSE
         CAST(40.55 AS DOUBLE) + CAST((CAST(floor(s_suppkey / 3) AS BIGINT) * 7919) % 300 AS DOUBLE) / 1000
         + CAST(s_suppkey % 3 AS DOUBLE) * CAST(0.0005 AS DOUBLE) END AS lat,
       CASE WHEN s_suppkey % 8 = 7 THEN NULL ELSE
         CAST(-74.20 AS DOUBLE) + CAST((CAST(floor(s_suppkey / 3) AS BIGINT) * 104729) % 400 AS DOUBLE) / 1000 END AS lng
FROM supplier
""",
    "listings_v": """
SELECT e.event_id AS id,
       concat('x', CAST(e.event_id AS STRING)) AS external_id,
       CASE e.event_id % 6 WHEN 0 THEN 'ticketmaster_api' WHEN 1 THEN 'eventbrite_api' WHEN 2 THEN 'songkick_scrape'
            WHEN 3 THEN 'dice_scrape' WHEN 4 THEN 'ical' ELSE 'direct_submission' END AS source_type,
       concat(p.p_name, CASE WHEN e.event_id % 4 = 0 THEN ': Live Tour' ELSE '' END) AS title,
       CASE WHEN e.event_id % 7 = 0 THEN NULL ELSE concat('About ', p.p_name) END AS description,
       CASE e.event_type WHEN 'signup' THEN 'music' WHEN 'click' THEN 'comedy' WHEN 'view' THEN 'art'
            WHEN 'purchase' THEN 'film' ELSE 'other' END AS category,
       CASE WHEN e.event_id % 17 = 0 THEN '' WHEN e.event_id % 5 = 0 THEN NULL
            ELSE concat('https://img.example.com/', CAST(e.event_id AS STRING)) END AS image_url,
       e.ts AS start_at,
       CASE WHEN e.event_id % 3 = 0 THEN NULL ELSE e.ts + INTERVAL '3' HOUR END AS end_at,
       CASE WHEN e.event_id % 2 = 0 THEN v.venue_id ELSE NULL END AS venue_id,
       v.name AS venue_name, v.lat AS lat, v.lng AS lng,
       e.event_type = 'signup' AS is_free,
       CASE WHEN e.event_id % 29 = 0 THEN -e.value ELSE e.value END AS price_min,
       CASE WHEN e.event_id % 10 = 0 THEN NULL ELSE e.value * (1 + e.event_id % 3) END AS price_max,
       concat('https://tickets.example.com/', CAST(e.event_id AS STRING)) AS ticket_url,
       CASE e.event_id % 6 WHEN 0 THEN 'Ticketmaster' WHEN 1 THEN 'Eventbrite' WHEN 2 THEN 'songkick'
            WHEN 3 THEN 'Dice' WHEN 4 THEN 'Feed' ELSE NULL END AS platform,
       CASE e.event_id % 6 WHEN 0 THEN CAST(0.95 AS DOUBLE) WHEN 1 THEN CAST(0.9 AS DOUBLE) WHEN 2 THEN CAST(0.85 AS DOUBLE)
            WHEN 3 THEN CAST(0.7 AS DOUBLE) WHEN 4 THEN CAST(0.5 AS DOUBLE) ELSE NULL END AS confidence_score,
       CASE WHEN e.event_id % 11 = 0 THEN 'draft' WHEN e.event_id % 13 = 0 THEN 'cancelled' ELSE 'active' END AS status
FROM events e
JOIN part p ON p.p_partkey = (e.user_id * 13 + day(e.ts) % 13) % (SELECT count(*) FROM part)
JOIN venues_v v ON v.venue_id = e.user_id % (SELECT count(*) FROM supplier)
""",
    "verification_v": """
SELECT e.event_id AS event_id, e.ts + INTERVAL '24' HOUR AS checked_at,
       CASE CAST(floor(e.event_id / 4) AS BIGINT) % 6 WHEN 0 THEN 'verified' WHEN 1 THEN 'flagged_content'
            WHEN 2 THEN 'flagged_coordinates' WHEN 3 THEN 'flagged_both' WHEN 4 THEN 'skipped' ELSE 'error' END AS status,
       e.value * 20 AS coord_delta_meters
FROM events e WHERE e.event_id % 4 = 0
""",
    "sources_v": """
SELECT n_nationkey AS id,
       CASE WHEN n_nationkey % 4 = 3 THEN NULL ELSE CAST(n_nationkey % 9 AS BIGINT) END AS venue_id,
       CASE n_nationkey % 3 WHEN 0 THEN 'ical' WHEN 1 THEN 'eventbrite_api' ELSE 'ra_scrape' END AS type,
       CASE n_nationkey % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'paused' ELSE 'active' END AS sync_status,
       CASE WHEN n_nationkey % 5 = 0 THEN concat('HTTP 50', CAST(n_nationkey % 4 AS STRING)) ELSE NULL END AS error_message,
       CASE WHEN n_nationkey % 10 = 0 THEN NULL
            ELSE TIMESTAMP '2024-01-10 00:00:00' + INTERVAL '1' HOUR * n_nationkey END AS last_synced_at,
       concat('{"feedUrl":"https://v', CAST(n_nationkey AS STRING), '.example.com/events.ics"}') AS config
FROM nation
""",
    "requests_v": """
SELECT event_id AS request_id, ts, concat('key-', CAST(user_id AS STRING)) AS api_key,
       concat('10.0.0.', CAST(user_id % 20 AS STRING)) AS client_ip
FROM events
""",
}

#: Tables and views that each view reads.
_READS = {"venues_v": ("supplier",), "listings_v": ("events", "part", "supplier", "venues_v"), "verification_v": ("events",), "sources_v": ("nation",), "requests_v": ("events",)}


def _register(spark: SparkSession, sf_dir: str, name: str) -> None:
    if name in VIEWS:
        for x in _READS[name]:
            _register(spark, sf_dir, x)
        spark.sql(VIEWS[name]).createOrReplaceTempView(name)
    else:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS, or a given table. Parts of listings' parent tables that are small are broadcast by Spark's own size check."""
    _register(spark, sf_dir, name)
    return spark.table(name)


def with_views(sql: str) -> str:
    """Oracle SQL that may read VIEWS."""
    body = ", ".join(f"{name} AS ({text})" for name, text in VIEWS.items())
    if sql.lstrip().upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {body}, {sql.lstrip()[15:]}"
    return f"WITH {body} {sql}" if not sql.lstrip().upper().startswith("WITH ") else f"WITH {body}, {sql.lstrip()[5:]}"
