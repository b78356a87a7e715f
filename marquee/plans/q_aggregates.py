"""Counts, windows and checks: A, W, Q, and the feed O1, O2, D3."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates
from ..operators import audit, feed
from ..schemas import FeedQuery
from .q_filters import BOX, LIVE, NOW, listings, sim
from .q_match import WALK
from .registry import query
from .testviews import AS_OF, view

_STALE = f"start_at < {NOW} AND (end_at IS NULL OR end_at < {NOW})"
_OVERVIEW = f"count(*) AS total, CAST(count_if(image_url IS NULL) AS BIGINT) AS missing_image, CAST(count_if(description IS NULL) AS BIGINT) AS missing_description, CAST(count_if(lat IS NULL OR lng IS NULL) AS BIGINT) AS missing_coordinates, CAST(count_if({_STALE}) AS BIGINT) AS stale FROM listings_v WHERE status = 'active'"


@query("a1_overview", f"SELECT {_OVERVIEW}")
def a1(spark, sf_dir):
    return audit.overview(listings(spark, sf_dir), AS_OF)


@query("a2_overview_by_source", f"SELECT source_type, {_OVERVIEW} GROUP BY source_type")
def a2(spark, sf_dir):
    return audit.overview(listings(spark, sf_dir), AS_OF, "source_type").orderBy(F.desc("total"), "source_type")


@query("a3_count_by_source", "SELECT source_type, count(*) AS n FROM listings_v GROUP BY source_type")
def a3(spark, sf_dir):
    return listings(spark, sf_dir).groupBy("source_type").agg(F.count("*").alias("n"))


@query("a4_verification_stats", "SELECT count(*) AS total, " + ", ".join(f"CAST(count_if(status = '{s}') AS BIGINT) AS {s}" for s in ("verified", "flagged_content", "flagged_coordinates", "flagged_both", "skipped", "error")) + ", max(checked_at) AS last_check FROM verification_v")
def a4(spark, sf_dir):
    from ..schemas import VERIFICATION_STATUS

    each = [F.count_if(F.col("status") == s).alias(s) for s in VERIFICATION_STATUS]
    return view(spark, sf_dir, "verification_v").agg(F.count("*").alias("total"), *each, F.max("checked_at").alias("last_check"))


@query("a5_source_health", "SELECT type, count(*) AS total, CAST(count_if(sync_status = 'active') AS BIGINT) AS active, CAST(count_if(sync_status = 'error') AS BIGINT) AS error, max(last_synced_at) AS last_sync, max(error_message) AS sample_error FROM sources_v GROUP BY type")
def a5(spark, sf_dir):
    s = view(spark, sf_dir, "sources_v").groupBy("type")
    return s.agg(F.count("*").alias("total"), F.count_if(F.col("sync_status") == "active").alias("active"), F.count_if(F.col("sync_status") == "error").alias("error"), F.max("last_synced_at").alias("last_sync"), F.max("error_message").alias("sample_error"))


@query("a6_more_dates", "SELECT title, venue_name, count(*) - 1 AS more_dates FROM listings_v GROUP BY title, venue_name HAVING count(*) > 1")
def a6(spark, sf_dir):
    return listings(spark, sf_dir).groupBy("title", "venue_name").agg((F.count("*") - 1).alias("more_dates")).where("more_dates > 0")


@query("a7_live_categories", f"SELECT DISTINCT category FROM listings_v WHERE {LIVE} AND {BOX} AND category IS NOT NULL")
def a7(spark, sf_dir):
    from ..functions.geo import in_box

    return listings(spark, sf_dir).where(dates.live(AS_OF) & in_box(F.col("lat"), F.col("lng")) & F.col("category").isNotNull()).select("category").distinct()


@query("a8_value_lists", "SELECT source_type, venue_name, min_by(title, id) AS first_title FROM listings_v GROUP BY source_type, venue_name")
def a8(spark, sf_dir):
    return listings(spark, sf_dir).groupBy("source_type", "venue_name").agg(F.min_by("title", "id").alias("first_title"))


@query("a9_stats_strip", "SELECT count(*) AS total, CAST(count_if(lat IS NULL OR lng IS NULL) AS BIGINT) AS no_place, CAST(count_if(coalesce(image_url, '') = '') AS BIGINT) AS no_image, CAST(count_if(status = 'draft') AS BIGINT) AS drafts FROM listings_v")
def a9(spark, sf_dir):
    return listings(spark, sf_dir).agg(F.count("*").alias("total"), audit.count_of(audit.no_place()).alias("no_place"), audit.count_of(audit.blank("image_url")).alias("no_image"), audit.count_of(F.col("status") == "draft").alias("drafts"))


@query("a10_quick_audit", f"SELECT count(*) AS scanned, CAST(count_if({_STALE}) AS BIGINT) AS stale, CAST(count_if(coalesce(image_url, '') = '') AS BIGINT) AS no_image, CAST(count_if(coalesce(description, '') = '') AS BIGINT) AS no_description, CAST(count_if(lat IS NULL OR lng IS NULL) AS BIGINT) AS no_place, CAST(count_if(coalesce(price_min < 0, FALSE) OR coalesce(price_max < 0, FALSE) OR coalesce(price_min > price_max, FALSE) OR coalesce(is_free AND price_min > 0, FALSE)) AS BIGINT) AS bad_prices FROM listings_v WHERE status = 'active'")
def a10(spark, sf_dir):
    issues = F.filter(audit.price_issues(), lambda i: i != "high_max")
    rows = listings(spark, sf_dir).where("status = 'active'")
    c = audit.count_of
    return rows.agg(F.count("*").alias("scanned"), c(dates.stale(AS_OF)).alias("stale"), c(audit.blank("image_url")).alias("no_image"), c(audit.blank("description")).alias("no_description"), c(audit.no_place()).alias("no_place"), c(F.size(issues) > 0).alias("bad_prices"))


_MISSING = "(CASE WHEN coalesce(image_url, '') = '' THEN 1 ELSE 0 END + CASE WHEN coalesce(description, '') = '' THEN 1 ELSE 0 END + CASE WHEN lat IS NULL OR lng IS NULL THEN 1 ELSE 0 END + CASE WHEN coalesce(category, 'other') IN ('', 'other') THEN 1 ELSE 0 END)"
_BAD = "(coalesce(price_min < 0, FALSE) OR coalesce(price_max < 0, FALSE) OR coalesce(price_min > price_max, FALSE) OR coalesce(price_max > 10000, FALSE) OR coalesce(is_free AND price_min > 0, FALSE))"
_Q1 = f"(status = 'active' AND coalesce(end_at, start_at) < {NOW})"
_SCORE = f"(CASE WHEN {_Q1} THEN 0 ELSE 20 END + CAST(floor((4 - {_MISSING}) / 4.0 * 30 + 0.5) AS INTEGER) + CASE WHEN coalesce(v.coord_delta_meters > 500, FALSE) THEN 0 ELSE 25 END + CASE WHEN {_BAD} THEN 0 ELSE 10 END + CASE WHEN id % 6 = 0 THEN 0 ELSE 15 END)"
_AUDITED = "(SELECT l.*, v.coord_delta_meters FROM listings_v l LEFT JOIN (SELECT event_id, coord_delta_meters FROM verification_v) v ON v.event_id = l.id)"


def audited(spark, sf_dir):
    rows = listings(spark, sf_dir)
    deltas = view(spark, sf_dir, "verification_v").select(F.col("event_id").alias("id"), F.col("coord_delta_meters").alias("delta_meters"))
    return audit.audited(rows, AS_OF, rows.where("id % 6 = 0").select("id"), deltas)


@query("a11_audit_summary", f"SELECT CAST(floor(avg({_SCORE}) + 0.5) AS BIGINT) AS average, CAST(count_if({_SCORE} = 100) AS BIGINT) AS perfect, CAST(count_if({_Q1}) AS BIGINT) AS stale, CAST(count_if({_MISSING} > 0) AS BIGINT) AS incomplete, CAST(count_if(coalesce(v.coord_delta_meters > 500, FALSE)) AS BIGINT) AS misplaced FROM {_AUDITED} v")
def a11(spark, sf_dir):
    from ..functions.text import js_round

    return audited(spark, sf_dir).agg(js_round(F.avg("score")).cast("long").alias("average"), F.count_if(F.col("score") == 100).alias("perfect"), F.count_if(~F.col("fresh")).alias("stale"), F.count_if(F.size("missing") > 0).alias("incomplete"), F.count_if(~F.col("placed")).alias("misplaced"))


@query("a12_run_summary", "SELECT source_type, CAST(count_if(id % 3 = 0) AS BIGINT) AS inserted, CAST(count_if(id % 3 = 1) AS BIGINT) AS updated, CAST(count_if(id % 3 = 2) AS BIGINT) AS skipped FROM listings_v GROUP BY ROLLUP (source_type)")
def a12(spark, sf_dir):
    action = F.get(F.array(F.lit("inserted"), F.lit("updated"), F.lit("skipped")), (F.col("id") % 3).cast("int"))
    rows = listings(spark, sf_dir).select("source_type", action.alias("action"))
    return rows.rollup("source_type").agg(*(F.count_if(F.col("action") == a).alias(a) for a in ("inserted", "updated", "skipped")))


@query("a13_merge_preview", "SELECT venue_id - venue_id % 3 AS canonical, count(*) AS events, CAST(count(DISTINCT venue_id) AS BIGINT) AS venues FROM listings_v WHERE venue_id IS NOT NULL GROUP BY 1")
def a13(spark, sf_dir):
    mapping = view(spark, sf_dir, "venues_v").select("venue_id", (F.col("venue_id") - F.col("venue_id") % 3).alias("canonical"))
    rows = listings(spark, sf_dir).select("venue_id").join(mapping, "venue_id")
    return rows.groupBy("canonical").agg(F.count("*").alias("events"), F.countDistinct("venue_id").alias("venues"))


@query("a14_page_count", f"SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM listings_v WHERE {LIVE}")
def a14(spark, sf_dir):
    return listings(spark, sf_dir).where(dates.live(AS_OF)).agg(F.count("*").alias("total"), F.ceil(F.count("*") / 20.0).alias("pages"))


@query("w1_representatives", f"SELECT id, title FROM (SELECT *, row_number() OVER (PARTITION BY title, venue_name ORDER BY start_at, id) AS n FROM listings_v WHERE {LIVE}) WHERE n = 1")
def w1(spark, sf_dir):
    from ..operators.tables import latest

    return latest(listings(spark, sf_dir).where(dates.live(AS_OF)), ["title", "venue_name"], F.col("start_at"), F.col("id")).select("id", "title")


@query("w2_occurrences", "SELECT id, count(*) OVER (PARTITION BY title, venue_name) AS n FROM listings_v WHERE status = 'active'")
def w2(spark, sf_dir):
    return listings(spark, sf_dir).where("status = 'active'").select("id", F.count("*").over(Window.partitionBy("title", "venue_name")).alias("n"))


@query("w3_next_dates", f"SELECT id, lead(start_at) OVER w AS next1, lead(start_at, 2) OVER w AS next2 FROM listings_v WHERE status = 'active' AND start_at >= {NOW} WINDOW w AS (PARTITION BY title, venue_name ORDER BY start_at, id)")
def w3(spark, sf_dir):
    w = Window.partitionBy("title", "venue_name").orderBy("start_at", "id")
    rows = listings(spark, sf_dir).where((F.col("status") == "active") & (F.col("start_at") >= dates.at(AS_OF)))
    return rows.select("id", F.lead("start_at").over(w).alias("next1"), F.lead("start_at", 2).over(w).alias("next2"))


@query("q1_stale_check", f"SELECT id, CAST(floor(epoch({NOW} - coalesce(end_at, start_at)) / 3600.0 + 0.5) AS BIGINT) AS hours_ago FROM listings_v WHERE {_Q1}")
def q1(spark, sf_dir):
    return listings(spark, sf_dir).where(audit.is_stale_now(AS_OF)).select("id", audit.hours_ago(AS_OF).alias("hours_ago"))


@query("q2_missing_fields", "SELECT id, concat_ws(',', CASE WHEN coalesce(image_url, '') = '' THEN 'imageUrl' END, CASE WHEN coalesce(description, '') = '' THEN 'description' END, CASE WHEN lat IS NULL OR lng IS NULL THEN 'coordinates' END, CASE WHEN coalesce(category, 'other') IN ('', 'other') THEN 'category' END) AS missing FROM listings_v")
def q2(spark, sf_dir):
    return listings(spark, sf_dir).select("id", F.array_join(audit.missing_fields(), ",").alias("missing"))


_MI = "2 * 3958.8 * asin(sqrt(pow(sin(radians(g.lat - l.lat) / 2), 2) + cos(radians(l.lat)) * cos(radians(g.lat)) * pow(sin(radians(g.lng - l.lng) / 2), 2)))"


@query("q3_coordinate_check", f"SELECT l.id, CAST(floor({_MI} * 1609.34 + 0.5) AS BIGINT) AS delta, floor({_MI} * 1609.34 + 0.5) <= 500 AS passed FROM listings_v l JOIN (SELECT name, min(lat) + 0.003 AS lat, min(lng) + 0.004 * (min(venue_id) % 2) AS lng FROM venues_v WHERE lat IS NOT NULL GROUP BY name) g ON g.name = l.venue_name WHERE l.lat IS NOT NULL")
def q3(spark, sf_dir):
    from ..functions.geo import MILES, haversine
    from ..functions.text import js_round

    g = view(spark, sf_dir, "venues_v").where("lat is not null").groupBy(F.col("name").alias("venue_name")).agg((F.min("lat") + 0.003).alias("g_lat"), (F.min("lng") + 0.004 * (F.min("venue_id") % 2)).alias("g_lng"))
    delta = js_round(haversine(F.col("lat"), F.col("lng"), F.col("g_lat"), F.col("g_lng"), MILES) * 1609.34)
    return listings(spark, sf_dir).where("lat is not null").join(g, "venue_name").select("id", delta.alias("delta"), (delta <= 500).alias("passed"))


@query("q5_scores", f"SELECT id, CAST({_SCORE} AS BIGINT) AS score, round({_SCORE} / 100.0, 4) AS confidence FROM {_AUDITED} v")
def q5(spark, sf_dir):
    return audited(spark, sf_dir).select("id", "score", F.round("confidence", 4).alias("confidence"))


_Q6 = "CASE WHEN doc_id % 10 = 9 THEN 'error' WHEN quality = 0 AND toxic = 1 THEN 'flagged_both' WHEN quality = 0 THEN 'flagged_content' WHEN toxic = 1 THEN 'flagged_coordinates' WHEN doc_id % 7 = 0 THEN 'skipped' ELSE 'verified' END"


def checked(spark, sf_dir):
    status = audit.verification_status(F.col("doc_id") % 10 == 9, F.col("quality") == 0, F.col("toxic") == 1, F.col("doc_id") % 7 == 0)
    return view(spark, sf_dir, "labels").select("doc_id", status.alias("status"))


@query("q6_verification_status", f"SELECT doc_id, {_Q6} AS status FROM labels")
def q6(spark, sf_dir):
    return checked(spark, sf_dir)


_OFF = "(?i)\\bcancelled\\s+(mon|tue|wed|thu|fri|sat|sun)|\\bthis\\s+event\\s+has\\s+been\\s+cancell?ed\\b|\\bevent\\s+cancelled\\b|\\bthis\\s+program\\s+has\\s+been\\s+cancell?ed\\b"
_PAGE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')"


@query("q7_page_verification", f"""WITH x AS (SELECT p.page_id AS event_id, p.page_id % 11 = 0 AS gone, p.page_id % 11 <> 0 AND regexp_matches({_PAGE}, '{_OFF}') AS said, b.quality = 1 AS confirmed, b.doc_id IS NOT NULL AS judged, coalesce(v.coord_delta_meters > 500, FALSE) AS far, v.coord_delta_meters AS delta FROM pages p JOIN listings_v l ON l.id = p.page_id LEFT JOIN labels b ON b.doc_id = p.page_id LEFT JOIN verification_v v ON v.event_id = p.page_id),
y AS (SELECT *, gone OR (NOT said AND confirmed IS NULL) AS skipped FROM x), z AS (SELECT *, said OR (NOT skipped AND NOT coalesce(confirmed, TRUE)) AS flagged FROM y)
SELECT event_id, CASE WHEN flagged AND far THEN 'flagged_both' WHEN flagged THEN 'flagged_content' WHEN far THEN 'flagged_coordinates' WHEN skipped THEN 'skipped' ELSE 'verified' END AS status, gone OR said AS expire, concat_ws(' | ', CASE WHEN gone THEN 'page not found' WHEN said THEN 'page says cancelled' WHEN judged THEN 'seen' END, CASE WHEN far THEN concat(CAST(round(delta) AS BIGINT), ' m off') END) AS reason FROM z""")
def q7(spark, sf_dir):
    from ..operators.verify import verify_pages

    pages = view(spark, sf_dir, "pages").select(F.col("page_id").alias("event_id"), F.when(F.col("page_id") % 11 == 0, 404).otherwise(200).alias("http_status"), "html")
    rows = listings(spark, sf_dir).select(F.col("id").alias("event_id"), "ticket_url", "status")
    verdicts = view(spark, sf_dir, "labels").select(F.col("doc_id").alias("event_id"), (F.col("quality") == 1).alias("confirmed"), F.lit("seen").alias("reason"))
    deltas = view(spark, sf_dir, "verification_v").select("event_id", F.col("coord_delta_meters").alias("delta"))
    return verify_pages(rows, pages, verdicts, deltas, ["ticketmaster.com"])


@query("q8_run_summary", f"SELECT CAST(count_if(s = 'verified') AS BIGINT) AS verified, CAST(count_if(s LIKE 'flagged%') AS BIGINT) AS flagged, CAST(count_if(s = 'skipped') AS BIGINT) AS skipped, CAST(count_if(s = 'error') AS BIGINT) AS errors FROM (SELECT {_Q6} AS s FROM labels)")
def q8(spark, sf_dir):
    s = F.col("status")
    return checked(spark, sf_dir).agg(F.count_if(s == "verified").alias("verified"), F.count_if(s.startswith("flagged")).alias("flagged"), F.count_if(s == "skipped").alias("skipped"), F.count_if(s == "error").alias("errors"))


@query("q9_bulk_status", "SELECT id, CASE WHEN status = 'draft' AND id % 2 = 0 THEN 'active' ELSE status END AS status FROM listings_v")
def q9(spark, sf_dir):
    from ..operators.tables import upsert

    rows = listings(spark, sf_dir).select("id", "status")
    return upsert(rows, rows.where("status = 'draft' and id % 2 = 0").withColumn("status", F.lit("active")), ["id"])


@query("q10_cleared_logs", "SELECT count(*) AS removed FROM verification_v")
def q10(spark, sf_dir):
    return view(spark, sf_dir, "verification_v").agg(F.count("*").alias("removed"))


@query("q11_log_search", "SELECT v.event_id FROM verification_v v JOIN listings_v l ON l.id = v.event_id WHERE contains(lower(l.title), 'lace') OR contains(lower(l.venue_name), 'lace')")
def q11(spark, sf_dir):
    rows = view(spark, sf_dir, "verification_v").join(listings(spark, sf_dir).select(F.col("id").alias("event_id"), "title", "venue_name"), "event_id")
    return rows.where(F.contains(F.lower("title"), F.lit("lace")) | F.contains(F.lower("venue_name"), F.lit("lace"))).select("event_id")


_SHOW = "regexp_replace(lower(title), '[^a-z0-9]', '', 'g')"
_PLACE = "regexp_replace(lower(coalesce(venue_name, '')), '[^a-z0-9]', '', 'g')"


@query("d3_collapsed", f"WITH g AS (SELECT *, {_SHOW} AS skey, {_PLACE} AS place FROM listings_v WHERE status = 'active'), f AS (SELECT skey, place, min_by(id, (start_at, id)) AS id, min(start_at) AS start_at, count(*) AS occurrences FROM g WHERE start_at >= {NOW} GROUP BY ALL), l AS (SELECT skey, place, max_by(id, (start_at, id)) AS id, max(start_at) AS start_at, count(*) AS occurrences FROM g GROUP BY ALL), n AS (SELECT skey, place, list_sort(list(DISTINCT g.start_at)) AS later FROM g JOIN f USING (skey, place) WHERE g.start_at > f.start_at GROUP BY ALL) SELECT coalesce(f.id, l.id) AS id, coalesce(f.start_at, l.start_at) AS start_at, coalesce(f.occurrences, l.occurrences) AS occurrences, CAST(least(coalesce(len(n.later), 0), 3) AS INTEGER) AS n_next, n.later[1] AS next1, n.later[3] AS next3 FROM l LEFT JOIN f USING (skey, place) LEFT JOIN n USING (skey, place)")
def d3(spark, sf_dir):
    rows = feed.collapse(listings(spark, sf_dir).where("status = 'active'"), AS_OF)
    nth = lambda i: F.get("next_dates", F.lit(i))
    return rows.select("id", "start_at", "occurrences", F.size("next_dates").alias("n_next"), nth(0).alias("next1"), nth(2).alias("next3"))


@query("o1_feed", f"""WITH RECURSIVE {WALK % (LIVE + ' AND lat BETWEEN 40.5 AND 40.8 AND lng BETWEEN -74.3 AND -73.6', 'TRUE')}, g AS (SELECT *, {_SHOW} AS skey, {_PLACE} AS place FROM member WHERE shown = id),
f AS (SELECT skey, place, min_by(id, (start_at, id)) AS id, min(start_at) AS start_at, count(*) AS n FROM g WHERE start_at >= {NOW} GROUP BY ALL), l AS (SELECT skey, place, max_by(id, (start_at, id)) AS id, count(*) AS n FROM g GROUP BY ALL),
later AS (SELECT skey, place, count(DISTINCT g.start_at) AS n FROM g JOIN f USING (skey, place) WHERE g.start_at > f.start_at GROUP BY ALL)
SELECT g.id, g.title, g.venue_name, g.start_at, coalesce(f.n, l.n) AS occurrences, CAST(least(coalesce(later.n, 0), 3) AS INTEGER) AS n_next FROM l LEFT JOIN f USING (skey, place) LEFT JOIN later USING (skey, place) JOIN g ON g.id = coalesce(f.id, l.id) ORDER BY g.start_at, g.id LIMIT 100""")
def o1(spark, sf_dir):
    q = FeedQuery(as_of=AS_OF, box=(40.5, 40.8, -74.3, -73.6), limit=100)
    return feed.feed(listings(spark, sf_dir), q).select("id", "title", "venue_name", "start_at", "occurrences", F.size("next_dates").alias("n_next"))


@query("o1_feed_plain", f"WITH g AS (SELECT *, {_SHOW} AS skey, {_PLACE} AS place FROM listings_v WHERE {LIVE} AND lat BETWEEN 40.5 AND 40.8 AND lng BETWEEN -74.3 AND -73.6), f AS (SELECT skey, place, min_by(id, (start_at, id)) AS id, min(start_at) AS start_at, count(*) AS n FROM g WHERE start_at >= {NOW} GROUP BY ALL), l AS (SELECT skey, place, max_by(id, (start_at, id)) AS id, max(start_at) AS start_at, count(*) AS n FROM g GROUP BY ALL) SELECT coalesce(f.id, l.id) AS id, coalesce(f.start_at, l.start_at) AS start_at, coalesce(f.n, l.n) AS occurrences FROM l LEFT JOIN f USING (skey, place) ORDER BY start_at, id LIMIT 100")
def o1_plain(spark, sf_dir):
    q = FeedQuery(as_of=AS_OF, box=(40.5, 40.8, -74.3, -73.6), limit=100)
    return feed.feed(listings(spark, sf_dir), q, deduplicate=False).select("id", "start_at", "occurrences")


_LACE = "'green lace'"


@query("o2_relevance", f"SELECT id, round(greatest({sim('title', _LACE)}, {sim('venue_name', _LACE)}), 6) AS relevance FROM listings_v WHERE {LIVE}")
def o2(spark, sf_dir):
    return listings(spark, sf_dir).where(dates.live(AS_OF)).select("id", F.round(feed.relevance("green lace"), 6).alias("relevance"))
