"""Validation, predicates, sorts and joins: V, J1-J6, J12-J15, O2-O6, S6-S13, U."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import dates, geo, text
from ..functions.classify import from_keywords
from ..operators import audit, tables
from ..operators.graph import shared_root
from ..schemas import NYC
from .registry import query
from .testviews import AS_OF, view

NOW = f"TIMESTAMP '{AS_OF}'"
LIVE = f"status = 'active' AND (end_at > {NOW} OR (end_at IS NULL AND start_at > {NOW} - INTERVAL 4 HOUR))"
BOX = "lat BETWEEN 40.4774 AND 40.9176 AND lng BETWEEN -74.2591 AND -73.7004"


def listings(spark, sf_dir):
    return view(spark, sf_dir, "listings_v")


@query("v1_dates", f"SELECT event_id, (ts >= {NOW} - INTERVAL 24 HOUR AND ts <= TIMESTAMP '2026-01-15 20:00:00') AS is_valid, CASE WHEN ts >= {NOW} - INTERVAL 24 HOUR AND event_id % 3 <> 0 AND event_id % 4 <> 0 THEN ts + INTERVAL 3 HOUR END AS end_at, CASE WHEN ts < {NOW} - INTERVAL 24 HOUR THEN 'past' END AS reason FROM events")
def v1(spark, sf_dir):
    e = view(spark, sf_dir, "events")
    end = F.when(F.col("event_id") % 3 == 0, None).when(F.col("event_id") % 4 == 0, F.col("ts") - dates.hours(1)).otherwise(F.col("ts") + dates.hours(3))
    return e.select("event_id", dates.validate(F.col("ts"), end, AS_OF).alias("v")).select("event_id", "v.*")


_HOURS = "CASE category WHEN 'music' THEN 180 WHEN 'comedy' THEN 90 WHEN 'art' THEN 180 WHEN 'film' THEN 120 ELSE 150 END"


@query("v2_end_estimate", f"SELECT id, coalesce(end_at, start_at + INTERVAL 1 MINUTE * ({_HOURS})) AS end_at FROM listings_v")
def v2(spark, sf_dir):
    return listings(spark, sf_dir).select("id", F.coalesce("end_at", dates.estimated_end(F.col("start_at"), F.col("category"))).alias("end_at"))


@query("v3_in_box", f"SELECT venue_id FROM venues_v WHERE {BOX}")
def v3(spark, sf_dir):
    return view(spark, sf_dir, "venues_v").where(geo.in_box(F.col("lat"), F.col("lng"))).select("venue_id")


_GENERIC = " OR ".join(f"(abs(lat - {a}) < 0.005 AND abs(lng - {b}) < 0.005)" for a, b in NYC.centroids)


@query("v4_valid_location", f"SELECT venue_id, coalesce({BOX} AND NOT ({_GENERIC}), FALSE) AS valid FROM venues_v")
def v4(spark, sf_dir):
    return view(spark, sf_dir, "venues_v").select("venue_id", geo.valid_location(F.col("lat"), F.col("lng")).alias("valid"))


def addressed(spark, sf_dir):
    """Supplier rows with addresses of several makes."""
    k = F.col("s_suppkey")
    places = ["Brooklyn, NY", "12 Main St, Floor 2, Queens, NY", "Pier 4, Hoboken, NJ", "Central Park", "New York, NY, US", "Great Lawn near the old reservoir", "88 Long Road Suite 5, Yonkers, NY", "", "Red Hook Warehouse (NYC), Room 4, Brooklyn, NY 11231"]
    chosen = F.get(F.array(*map(F.lit, places)), (k % len(places)).cast("int"))
    return view(spark, sf_dir, "supplier").select(k.alias("id"), chosen.alias("address"))


_ADDRESS = "list_extract(['Brooklyn, NY', '12 Main St, Floor 2, Queens, NY', 'Pier 4, Hoboken, NJ', 'Central Park', 'New York, NY, US', 'Great Lawn near the old reservoir', '88 Long Road Suite 5, Yonkers, NY', '', 'Red Hook Warehouse (NYC), Room 4, Brooklyn, NY 11231'], CAST(s_suppkey % 9 AS INTEGER) + 1)"


@query("v5_generic_address", f"SELECT s_suppkey AS id, {_ADDRESS} IN ('Brooklyn, NY', 'Central Park', 'New York, NY, US', '') AS generic FROM supplier")
def v5(spark, sf_dir):
    return addressed(spark, sf_dir).select("id", geo.generic_address(F.col("address")).alias("generic"))


@query("v6_outside_city", f"SELECT s_suppkey AS id, regexp_matches(lower({_ADDRESS}), ', nj|,\\s*(hoboken|yonkers)(\\s*,|\\s+ny\\b|$)') AS outside FROM supplier")
def v6(spark, sf_dir):
    return addressed(spark, sf_dir).select("id", geo.outside_city(F.col("address")).alias("outside"))


@query("v7_resolve_location", f"""WITH a AS (SELECT venue_id, lat, lng, {_ADDRESS} AS address, CASE WHEN venue_id % 5 <> 0 THEN lat + 0.001 END AS geo_lat, CASE WHEN venue_id % 5 <> 0 THEN lng END AS geo_lng FROM venues_v JOIN supplier ON s_suppkey = venue_id),
o AS (SELECT venue_id, coalesce({BOX} AND NOT ({_GENERIC}), FALSE) AS own FROM venues_v), g AS (SELECT venue_id, coalesce({BOX} AND NOT ({_GENERIC}), FALSE) AS there FROM (SELECT venue_id, geo_lat AS lat, geo_lng AS lng FROM a)),
c AS (SELECT a.*, CASE WHEN regexp_matches(lower(address), ', nj|,\\s*(hoboken|yonkers)(\\s*,|\\s+ny\\b|$)') THEN 'none' WHEN own AND address NOT IN ('Brooklyn, NY', 'Central Park', 'New York, NY, US', '') THEN 'own' WHEN there THEN 'geo' WHEN own THEN 'unsure' ELSE 'none' END AS how FROM a JOIN o USING (venue_id) JOIN g USING (venue_id))
SELECT venue_id, round(CASE how WHEN 'geo' THEN geo_lat WHEN 'none' THEN NULL ELSE lat END, 6) AS lat, round(CASE how WHEN 'geo' THEN geo_lng WHEN 'none' THEN NULL ELSE lng END, 6) AS lng, how IN ('own', 'geo') AS is_verified FROM c""")
def v7(spark, sf_dir):
    v = view(spark, sf_dir, "venues_v").join(addressed(spark, sf_dir), F.col("venue_id") == F.col("id"))
    geocoded = view(spark, sf_dir, "venues_v").where("venue_id % 5 <> 0").select(F.col("venue_id"), (F.col("lat") + 0.001).alias("geo_lat"), F.col("lng").alias("geo_lng"))
    place = geo.resolve_location(F.col("address"), F.col("lat"), F.col("lng"), F.col("geo_lat"), F.col("geo_lng"))
    return v.join(geocoded, "venue_id", "left").select("venue_id", place.alias("p")).select("venue_id", F.round("p.lat", 6).alias("lat"), F.round("p.lng", 6).alias("lng"), "p.is_verified")


@query("v8_sanitize_address", f"""SELECT s_suppkey AS id, CASE s_suppkey % 9 WHEN 1 THEN '12 Main St, Queens, NY' WHEN 6 THEN '88 Long Road, Yonkers, NY' WHEN 8 THEN 'Red Hook Warehouse, Brooklyn, NY 11231' ELSE {_ADDRESS} END AS address FROM supplier""")
def v8(spark, sf_dir):
    return addressed(spark, sf_dir).select("id", geo.sanitize_address(F.col("address")).alias("address"))


@query("v9_venue_geocode", f"SELECT l.id, min(v.lat) AS lat, min(v.lng) AS lng FROM listings_v l JOIN venues_v v ON lower(v.name) = lower(l.venue_name) AND v.lat <> 0 AND v.lng <> 0 AND {BOX.replace('lat', 'v.lat').replace('lng', 'v.lng')} GROUP BY l.id")
def v9(spark, sf_dir):
    cached = view(spark, sf_dir, "venues_v").where(geo.in_box(F.col("lat"), F.col("lng")) & (F.col("lat") != 0) & (F.col("lng") != 0))
    cached = cached.groupBy(F.lower("name").alias("name")).agg(F.min("lat").alias("lat"), F.min("lng").alias("lng"))
    return listings(spark, sf_dir).select("id", F.lower("venue_name").alias("name")).join(cached, "name").select("id", "lat", "lng")


@query("v10_price_issues", "SELECT id, concat_ws(',', CASE WHEN price_min < 0 THEN 'negative_min' END, CASE WHEN price_max < 0 THEN 'negative_max' END, CASE WHEN price_min > price_max THEN 'min_over_max' END, CASE WHEN price_max > 10000 THEN 'high_max' END, CASE WHEN is_free AND price_min > 0 THEN 'free_with_price' END) AS issues FROM listings_v")
def v10(spark, sf_dir):
    return listings(spark, sf_dir).select("id", F.array_join(audit.price_issues(), ",").alias("issues"))


@query("v11_live", f"SELECT id FROM listings_v WHERE {LIVE}")
def v11(spark, sf_dir):
    return listings(spark, sf_dir).where(dates.live(AS_OF)).select("id")


@query("v12_expire", f"SELECT source_type, count(*) AS expired FROM listings_v WHERE status = 'active' AND (end_at < {NOW} OR (end_at IS NULL AND start_at < {NOW} - INTERVAL 6 HOUR)) GROUP BY source_type")
def v12(spark, sf_dir):
    return audit.expire(listings(spark, sf_dir), AS_OF).where("status = 'expired'").groupBy("source_type").agg(F.count("*").alias("expired"))


@query("v13_stale", f"SELECT id, start_at FROM listings_v WHERE status = 'active' AND start_at < {NOW} AND (end_at IS NULL OR end_at < {NOW}) ORDER BY start_at DESC, id LIMIT 100")
def v13(spark, sf_dir):
    return listings(spark, sf_dir).where(dates.stale(AS_OF)).orderBy(F.desc("start_at"), "id").limit(100).select("id", "start_at")


@query("v14_missing_data", "SELECT id, title FROM listings_v WHERE status = 'active' AND (image_url IS NULL OR description IS NULL OR lat IS NULL OR lng IS NULL) ORDER BY title, id LIMIT 100")
def v14(spark, sf_dir):
    missing = F.col("image_url").isNull() | F.col("description").isNull() | audit.no_place()
    return listings(spark, sf_dir).where("status = 'active'").where(missing).orderBy("title", "id").limit(100).select("id", "title")


_BOX10 = geo.around(40.7128, -74.0060, 10)


@query("v15_radius_box", "SELECT id FROM listings_v WHERE lat BETWEEN {!r} AND {!r} AND lng BETWEEN {!r} AND {!r}".format(*_BOX10))
def v15(spark, sf_dir):
    a, b, c, d = geo.around(40.7128, -74.0060, 10)
    return listings(spark, sf_dir).where(F.col("lat").between(a, b) & F.col("lng").between(c, d)).select("id")


@query("v16_date_range", "SELECT id FROM listings_v WHERE start_at BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'")
def v16(spark, sf_dir):
    return listings(spark, sf_dir).where(F.col("start_at").between(dates.at("2024-01-10 00:00:00"), dates.at("2024-01-12 00:00:00"))).select("id")


@query("v17_timeframes", f"""SELECT CAST(count_if(start_at <= TIMESTAMP '2024-01-16 09:00:00') AS BIGINT) AS tonight, CAST(count_if(start_at <= TIMESTAMP '2024-01-17 04:59:59.999') AS BIGINT) AS next_2_days, CAST(count_if(start_at <= TIMESTAMP '2024-01-22 04:59:59.999') AS BIGINT) AS this_week FROM listings_v WHERE start_at >= {NOW}""")
def v17(spark, sf_dir):
    rows = listings(spark, sf_dir).where(F.col("start_at") >= dates.at(AS_OF))
    return rows.agg(*(F.count_if(F.col("start_at") <= dates.timeframe_end(t, AS_OF, NYC.zone)).alias(t) for t in ("tonight", "next_2_days", "this_week")))


def _grams(c):
    return f"list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


def sim(a, b):
    both = f"len(list_intersect({_grams(a)}, {_grams(b)}))"
    return f"({both} / greatest(len({_grams(a)}) + len({_grams(b)}) - {both}, 1.0))"


_SEARCH = f"SELECT id, round(greatest({sim('title', chr(39) + 'green lace' + chr(39))}, {sim('venue_name', chr(39) + 'green lace' + chr(39))}), 6) AS relevance FROM listings_v WHERE greatest({sim('title', chr(39) + 'green lace' + chr(39))}, {sim('venue_name', chr(39) + 'green lace' + chr(39))}) > 0.1 OR title ILIKE '%green lace%' OR venue_name ILIKE '%green lace%'"


@query("v18_search", _SEARCH)
def v18(spark, sf_dir):
    from ..operators.feed import relevance, search_matches

    rows = listings(spark, sf_dir)
    return rows.where(search_matches("green lace")).select("id", F.round(relevance("green lace"), 6).alias("relevance"))


@query("v18_indexed_search", _SEARCH)
def v18_indexed(spark, sf_dir):
    """The same through a stored index of postings."""
    from ..operators.search import SearchIndex

    index = SearchIndex.build(view(spark, sf_dir, "listings_v"), f"{shared_root(spark)}/search-{uuid.uuid4().hex}")
    return index.search("green lace").select("id", F.round("relevance", 6).alias("relevance"))


@query("v19_admin_filter", f"SELECT id FROM listings_v WHERE status IN ('active', 'draft') AND source_type = 'ical' AND start_at BETWEEN {NOW} AND {NOW} + INTERVAL 7 DAY AND title ILIKE '%a%'")
def v19(spark, sf_dir):
    week = F.col("start_at").between(dates.at(AS_OF), dates.at(AS_OF) + dates.hours(168))
    return listings(spark, sf_dir).where(F.col("status").isin("active", "draft") & (F.col("source_type") == "ical") & week & F.contains(F.lower("title"), F.lit("a"))).select("id")


@query("v20_to_verify", f"SELECT id, start_at FROM listings_v WHERE status = 'active' AND start_at > {NOW} AND source_type = 'dice_scrape' ORDER BY start_at, id LIMIT 50")
def v20(spark, sf_dir):
    rows = listings(spark, sf_dir).where((F.col("status") == "active") & (F.col("start_at") > dates.at(AS_OF)) & (F.col("source_type") == "dice_scrape"))
    return rows.orderBy("start_at", "id").limit(50).select("id", "start_at")


@query("v21_to_enrich", f"SELECT id, trim(string_split_regex(title, '(?i) at | @ ')[1]) AS artist FROM listings_v WHERE status = 'active' AND start_at > {NOW} AND image_url IS NULL AND category = 'music' AND length(trim(string_split_regex(title, '(?i) at | @ ')[1])) >= 2")
def v21(spark, sf_dir):
    artist = F.trim(F.get(F.split("title", "(?i) at | @ "), F.lit(0)))
    rows = listings(spark, sf_dir).where((F.col("status") == "active") & (F.col("start_at") > dates.at(AS_OF)) & F.col("image_url").isNull() & (F.col("category") == "music"))
    return rows.select("id", artist.alias("artist")).where(F.length("artist") >= 2)


@query("v22_to_describe", "SELECT id FROM listings_v WHERE status = 'active' AND description IS NULL AND ticket_url IS NOT NULL AND ticket_url NOT LIKE '%ticketmaster.com%'")
def v22(spark, sf_dir):
    blocked = ["ticketmaster.com", "livenation.com"]
    none = ~F.exists(F.array(*map(F.lit, blocked)), lambda d: F.contains(F.col("ticket_url"), d))
    return listings(spark, sf_dir).where((F.col("status") == "active") & F.col("description").isNull() & F.col("ticket_url").isNotNull() & none).select("id")


@query("v23_image_urls", "SELECT id, CASE WHEN coalesce(image_url, '') = '' THEN 'empty' WHEN image_url NOT LIKE 'http%' THEN 'malformed' WHEN image_url LIKE 'https://img.example.com/%' THEN 'trusted' ELSE 'fetch' END AS verdict FROM listings_v")
def v23(spark, sf_dir):
    from ..operators.enrich import image_verdict

    return listings(spark, sf_dir).select("id", image_verdict(F.col("image_url"), ["img.example.com"]).alias("verdict"))


@query("v24_title_is_venue", "SELECT id, contains(lower(trim(concat(title, ' ', coalesce(venue_name, '')))), lower(trim(venue_name))) AS is_venue FROM listings_v WHERE venue_name IS NOT NULL")
def v24(spark, sf_dir):
    from ..operators.enrich import title_is_venue

    title = F.concat_ws(" ", "title", "venue_name")
    return listings(spark, sf_dir).where("venue_name is not null").select("id", title_is_venue(title, F.col("venue_name")).alias("is_venue"))


@query("v25_enriched", "SELECT l.id, CASE WHEN l.image_url IS NULL AND l.id % 3 = 0 THEN concat('https://new/', CAST(l.id AS VARCHAR)) WHEN l.id % 8 = 1 THEN NULL ELSE l.image_url END AS image_url, coalesce(l.description, CASE WHEN l.id % 3 = 0 AND l.id % 9 <> 0 THEN 'a found description' END) AS description FROM listings_v l")
def v25(spark, sf_dir):
    from ..operators.enrich import apply_found

    rows = listings(spark, sf_dir)
    found = rows.where("id % 3 = 0").select("id", F.concat(F.lit("https://new/"), "id").alias("image_url"), F.lit("a found description").alias("description"), F.when(F.col("id") % 9 == 0, "low").otherwise("high").alias("confidence"))
    broken = rows.where("id % 8 = 1").select("id")
    return apply_found(rows.select("id", "image_url", "description"), found, broken)


@query("v26_delete", "SELECT id FROM listings_v WHERE id % 10 <> 3")
def v26(spark, sf_dir):
    rows = listings(spark, sf_dir).select("id")
    return tables.minus(rows, rows.where("id % 10 = 3"), "id")


@query("j1_with_verification", "SELECT l.id, v.status AS verification, round(v.coord_delta_meters, 4) AS delta FROM listings_v l LEFT JOIN verification_v v ON v.event_id = l.id")
def j1(spark, sf_dir):
    v = view(spark, sf_dir, "verification_v").select(F.col("event_id").alias("id"), F.col("status").alias("verification"), F.round("coord_delta_meters", 4).alias("delta"))
    return listings(spark, sf_dir).select("id").join(v, "id", "left")


@query("j2_logs", "SELECT v.event_id, l.title, v.checked_at FROM verification_v v JOIN listings_v l ON l.id = v.event_id WHERE v.status = 'verified' ORDER BY v.checked_at DESC, v.event_id LIMIT 50 OFFSET 10")
def j2(spark, sf_dir):
    rows = view(spark, sf_dir, "verification_v").where("status = 'verified'").join(listings(spark, sf_dir).select(F.col("id").alias("event_id"), "title"), "event_id")
    return rows.orderBy(F.desc("checked_at"), "event_id").offset(10).limit(50).select("event_id", "title", "checked_at")


@query("j3_flagged_places", "SELECT v.event_id, l.title FROM verification_v v JOIN listings_v l ON l.id = v.event_id WHERE v.status IN ('flagged_coordinates', 'flagged_both') ORDER BY v.checked_at DESC, v.event_id LIMIT 200")
def j3(spark, sf_dir):
    rows = view(spark, sf_dir, "verification_v").where(F.col("status").isin("flagged_coordinates", "flagged_both"))
    return rows.join(listings(spark, sf_dir).select(F.col("id").alias("event_id"), "title"), "event_id").orderBy(F.desc("checked_at"), "event_id").limit(200).select("event_id", "title")


@query("j4_sources", "SELECT s.id, s.type, v.name AS venue_name FROM sources_v s LEFT JOIN venues_v v ON v.venue_id = s.venue_id")
def j4(spark, sf_dir):
    venues = view(spark, sf_dir, "venues_v").select("venue_id", F.col("name").alias("venue_name"))
    return view(spark, sf_dir, "sources_v").join(venues, "venue_id", "left").select("id", "type", "venue_name")


@query("j5_source_errors", "SELECT s.id, coalesce(v.name, 'Unknown Venue') AS venue_name, s.last_synced_at FROM sources_v s LEFT JOIN venues_v v ON v.venue_id = s.venue_id WHERE s.sync_status = 'error' ORDER BY s.last_synced_at DESC NULLS LAST, s.id LIMIT 20")
def j5(spark, sf_dir):
    venues = view(spark, sf_dir, "venues_v").select("venue_id", "name")
    rows = view(spark, sf_dir, "sources_v").where("sync_status = 'error'").join(venues, "venue_id", "left")
    return rows.orderBy(F.desc_nulls_last("last_synced_at"), "id").limit(20).select("id", F.coalesce("name", F.lit("Unknown Venue")).alias("venue_name"), "last_synced_at")


@query("j6_known_keys", "SELECT CASE WHEN id % 4 = 0 THEN 'update' ELSE 'insert' END AS action, count(*) AS n FROM listings_v GROUP BY 1")
def j6(spark, sf_dir):
    rows = listings(spark, sf_dir).select("external_id", "source_type", "id")
    known, new = tables.split_by_key(rows.where("id % 4 = 0"), rows, ["external_id", "source_type"])
    tagged = known.select(F.lit("update").alias("action")).union(new.select(F.lit("insert").alias("action")))
    return tagged.groupBy("action").agg(F.count("*").alias("n"))


@query("j12_sync_places", "SELECT l.id, coalesce(v.lat, l.lat) AS lat FROM listings_v l LEFT JOIN (SELECT lower(name) AS name, min(lat) + 0.5 AS lat FROM venues_v WHERE lat IS NOT NULL GROUP BY 1) v ON v.name = lower(l.venue_name)")
def j12(spark, sf_dir):
    venues = view(spark, sf_dir, "venues_v").where("lat is not null").groupBy(F.lower("name").alias("name")).agg((F.min("lat") + 0.5).alias("new_lat"))
    rows = listings(spark, sf_dir).withColumn("name", F.lower("venue_name")).join(venues, "name", "left")
    return rows.select("id", F.coalesce("new_lat", "lat").alias("lat"))


_METRES = "2 * 6371000 * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))"


@query("j13_override_delta", f"SELECT l.id, round({_METRES.format(a='l.lat', b='l.lng', c='o.lat', d='o.lng')}, 2) AS metres, {_METRES.format(a='l.lat', b='l.lng', c='o.lat', d='o.lng')} > 500 AS mismatch FROM listings_v l JOIN (SELECT lower(name) AS name, min(lat) + 0.006 AS lat, min(lng) AS lng FROM venues_v WHERE venue_id < 5 AND lat IS NOT NULL GROUP BY 1) o ON o.name = lower(l.venue_name)")
def j13(spark, sf_dir):
    overrides = view(spark, sf_dir, "venues_v").where("venue_id < 5 and lat is not null").groupBy(F.lower("name").alias("name")).agg((F.min("lat") + 0.006).alias("o_lat"), F.min("lng").alias("o_lng"))
    metres = geo.haversine(F.col("lat"), F.col("lng"), F.col("o_lat"), F.col("o_lng"), geo.METRES)
    return listings(spark, sf_dir).withColumn("name", F.lower("venue_name")).join(overrides, "name").select("id", F.round(metres, 2).alias("metres"), (metres > 500).alias("mismatch"))


@query("j14_same_day", "SELECT a.id, b.id AS other FROM listings_v a JOIN listings_v b ON lower(a.title) = lower(b.title) AND lower(a.venue_name) = lower(b.venue_name) AND CAST(a.start_at AS DATE) = CAST(b.start_at AS DATE) AND a.id <> b.id AND a.status = 'active' AND b.status = 'active'")
def j14(spark, sf_dir):
    rows = listings(spark, sf_dir).where("status = 'active'").select("id", F.to_date("start_at").alias("day"), F.lower("title").alias("title"), F.lower("venue_name").alias("venue"))
    return rows.join(rows.withColumnRenamed("id", "other"), ["day", "title", "venue"]).where("id <> other").select("id", "other")


@query("j15_accept_places", "SELECT id, CASE WHEN id % 8 = 0 THEN 40.7 ELSE lat END AS lat FROM listings_v")
def j15(spark, sf_dir):
    rows = listings(spark, sf_dir).select("id", "lat")
    accepted = view(spark, sf_dir, "verification_v").where("event_id % 8 = 0").select(F.col("event_id").alias("id"), F.lit(40.7).alias("lat"))
    return tables.upsert(rows, accepted.join(rows.select("id"), "id", "left_semi"), ["id"])


_UPSERTED = "SELECT id, CASE WHEN id % 5 = 0 THEN 'renamed' ELSE title END AS title, CASE WHEN id % 5 = 0 THEN 'active' ELSE status END AS status FROM listings_v WHERE id % 2 = 0 UNION ALL SELECT id, 'renamed', 'active' FROM listings_v WHERE id % 2 = 1 AND id % 5 = 0"


@query("s6_upsert", _UPSERTED)
def s6(spark, sf_dir):
    rows = listings(spark, sf_dir).select("external_id", "source_type", "id", "title", "status")
    new = rows.where("id % 5 = 0").withColumn("title", F.lit("renamed")).withColumn("status", F.lit("active"))
    return tables.upsert(rows.where("id % 2 = 0"), new, ["external_id", "source_type"]).select("id", "title", "status")


@query("s6_touched_buckets", _UPSERTED)
def s6_buckets(spark, sf_dir):
    """The same upsert into a bucketed table, its second batch given twice."""
    rows = listings(spark, sf_dir).select("external_id", "source_type", "id", "title", "status")
    table = tables.BucketedTable(spark, f"{shared_root(spark)}/listings-{uuid.uuid4().hex}", rows.schema, ("external_id", "source_type"), 32)
    table.upsert(rows.where("id % 2 = 0"), 0)
    new = rows.where("id % 5 = 0").withColumn("title", F.lit("renamed")).withColumn("status", F.lit("active"))
    for _ in range(2):
        table.upsert(new, 1)
    return table.read().select("id", "title", "status")


@query("s7_latest_check", "SELECT user_id AS event_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n = 1")
def s7(spark, sf_dir):
    return tables.latest(view(spark, sf_dir, "events"), ["user_id"], F.desc("ts"), F.col("event_id")).select(F.col("user_id").alias("event_id"), F.col("event_type").alias("status"))


@query("s8_source_status", "SELECT type, max(last_synced_at) AS last_synced_at, CASE WHEN type = 'ical' THEN 'error' ELSE 'active' END AS sync_status FROM sources_v GROUP BY type")
def s8(spark, sf_dir):
    old = view(spark, sf_dir, "sources_v").groupBy("type").agg(F.max("last_synced_at").alias("last_synced_at")).withColumn("sync_status", F.lit("active"))
    new = old.where("type = 'ical'").select("type", F.lit("error").alias("sync_status"))
    return tables.upsert(old, new, ["type"], ["sync_status"])


@query("s9_venue_overrides", "SELECT name, CASE WHEN id % 3 = 0 THEN 1.5 ELSE lat END AS lat FROM (SELECT name, min(venue_id) AS id, min(lat) AS lat FROM venues_v GROUP BY name)")
def s9(spark, sf_dir):
    old = view(spark, sf_dir, "venues_v").groupBy("name").agg(F.min("venue_id").alias("id"), F.min("lat").alias("lat"))
    return tables.upsert(old, old.where("id % 3 = 0").withColumn("lat", F.lit(1.5)), ["name"], ["lat"]).select("name", "lat")


@query("s12_seed_sources", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 1 THEN 'reactivate' ELSE 'skip' END AS action FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 1000 + n_nationkey, 'insert' FROM nation WHERE n_nationkey < 3")
def s12(spark, sf_dir):
    from ..sources.feeds import seed_actions

    known = view(spark, sf_dir, "sources_v").select("config", "sync_status")
    feeds = view(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("https://v"), "n_nationkey", F.lit(".example.com/events.ics")).alias("url"))
    fresh = view(spark, sf_dir, "nation").where("n_nationkey < 3").select((F.col("n_nationkey") + 1000).cast("long").alias("id"), F.concat(F.lit("https://new"), "n_nationkey").alias("url"))
    return seed_actions(known, feeds.union(fresh))


@query("s13_pause_sources", "SELECT id, CASE WHEN config LIKE '%v1_.example%' THEN 'paused' ELSE sync_status END AS sync_status, CASE WHEN config LIKE '%v1_.example%' THEN 'gone' ELSE error_message END AS error_message FROM sources_v")
def s13(spark, sf_dir):
    from ..sources.feeds import paused

    rules = spark.createDataFrame([("%v1_.example%", "gone")], "pattern string, reason string")
    return paused(view(spark, sf_dir, "sources_v"), rules).select("id", "sync_status", "error_message")


@query("o3_page", f"SELECT id, start_at FROM listings_v WHERE {LIVE} ORDER BY start_at, id LIMIT 20 OFFSET 40")
def o3(spark, sf_dir):
    from ..operators.feed import page

    return page(listings(spark, sf_dir).where(dates.live(AS_OF)), 3, 20, "start_at", "id").select("id", "start_at")


@query("o4_nearby", f"SELECT id, start_at FROM listings_v WHERE {LIVE} AND lat BETWEEN {_BOX10[0]!r} AND {_BOX10[1]!r} AND lng BETWEEN {_BOX10[2]!r} AND {_BOX10[3]!r} ORDER BY start_at, id LIMIT 100")
def o4(spark, sf_dir):
    a, b, c, d = geo.around(40.7128, -74.0060, 10)
    near = F.col("lat").between(a, b) & F.col("lng").between(c, d)
    return listings(spark, sf_dir).where(dates.live(AS_OF) & near).orderBy("start_at", "id").limit(100).select("id", "start_at")


@query("o5_featured", f"SELECT id, image_url FROM listings_v WHERE {LIVE} ORDER BY image_url IS NULL, start_at, id LIMIT 6")
def o5(spark, sf_dir):
    return listings(spark, sf_dir).where(dates.live(AS_OF)).orderBy(F.col("image_url").isNull(), "start_at", "id").limit(6).select("id", "image_url")


_MILES = "2 * 3958.8 * asin(sqrt(pow(sin(radians(lat - 40.7128) / 2), 2) + cos(radians(40.7128)) * cos(radians(lat)) * pow(sin(radians(lng + 74.006) / 2), 2)))"


@query("o6_by_distance", f"SELECT venue_id, round({_MILES}, 4) AS miles, row_number() OVER (ORDER BY round({_MILES}, 4) NULLS LAST, venue_id) AS rank FROM venues_v ORDER BY rank LIMIT 50")
def o6(spark, sf_dir):
    miles = F.round(geo.haversine(F.lit(40.7128), F.lit(-74.006), F.col("lat"), F.col("lng"), geo.MILES), 4)
    top = view(spark, sf_dir, "venues_v").select("venue_id", miles.alias("miles")).orderBy(F.asc_nulls_last("miles"), "venue_id").limit(50)
    from pyspark.sql.window import Window

    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("miles"), "venue_id")).cast("long"))


@query("u1_union", "SELECT source_type, count(*) AS n FROM listings_v WHERE source_type IN ('ical', 'dice_scrape') GROUP BY 1")
def u1(spark, sf_dir):
    rows = listings(spark, sf_dir)
    parts = [rows.where(F.col("source_type") == s).select("id", "source_type", *extra) for s, extra in (("ical", []), ("dice_scrape", ["title"]))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).groupBy("source_type").agg(F.count("*").alias("n"))


@query("u2_token_sets", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, CAST(len(list_intersect(string_split(a.n_comment, ' '), string_split(b.n_comment, ' '))) AS INTEGER) AS shared FROM (SELECT n_nationkey, n_regionkey, n_name AS n_comment FROM nation) a JOIN (SELECT n_nationkey, n_regionkey, n_name AS n_comment FROM nation) b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def u2(spark, sf_dir):
    n = view(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.split("n_name", " ").alias("w"))
    pairs = n.toDF("a", "region", "wa").join(n.toDF("b", "region", "wb"), "region").where("a < b")
    return pairs.select("a", "b", F.size(F.array_intersect("wa", "wb")).alias("shared"))


@query("u3_minus", "SELECT id FROM listings_v WHERE status <> 'active'")
def u3(spark, sf_dir):
    rows = listings(spark, sf_dir).select("id", "status")
    return tables.minus(rows, rows.where("status = 'active'"), "id").select("id")
