"""Sources and normalizers over payloads derived from the listing views: S2-S5, S10, S11, N."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import calendars as c
from ..sources import normalize as n
from ..sources import payloads as p
from .q_filters import NOW, listings
from .registry import BODIES, query
from .testviews import AS_OF, view

_VALID = f"start_at >= {NOW} - INTERVAL 24 HOUR"
_KEEP = ["external_id", "title", "category", "start_at", "end_at", "venue_name", "price_min", "is_free", "status"]
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def parsed(rows, schema, body):
    """body as JSON text, read back by the payload's schema: the way that landed payloads come in."""
    return rows.select(F.from_json(F.to_json(body), schema).alias("e")).select("e.*")


def payload_a(spark, sf_dir):
    iso = F.date_format("start_at", ISO)
    place = F.struct(F.col("lat").cast("string").alias("latitude"), F.col("lng").cast("string").alias("longitude"))
    images = F.array(F.struct(F.concat("image_url", F.lit("_SMALL.jpg")).alias("url"), F.lit("4_3").alias("ratio")), F.struct(F.concat("image_url", F.lit("_TABLET_LANDSCAPE_16_9.jpg")).alias("url"), F.lit("16_9").alias("ratio")))
    body = F.struct(
        F.col("external_id").alias("id"), F.col("title").alias("name"), F.col("ticket_url").alias("url"), F.lit("").alias("description"), F.col("description").alias("info"), images.alias("images"),
        F.struct(F.struct(F.when(F.col("id") % 9 != 0, iso).alias("dateTime"), F.date_format("start_at", "yyyy-MM-dd").alias("localDate")).alias("start"), F.struct(F.col("status").alias("code")).alias("status")).alias("dates"),
        F.array(F.struct(F.col("price_min").alias("min"), F.col("price_max").alias("max"))).alias("priceRanges"), F.array(F.struct(F.struct(F.lit("Music").alias("name")).alias("segment"))).alias("classifications"),
        F.struct(F.array(F.struct(F.col("venue_name").alias("name"), place.alias("location"))).alias("venues")).alias("_embedded"),
    )
    return parsed(listings(spark, sf_dir), p.API_A, body)


_A = "CASE WHEN id % 9 <> 0 THEN start_at ELSE date_trunc('day', start_at) END"


def listed_a(spark, sf_dir):
    return n.api_a(payload_a(spark, sf_dir), AS_OF)


@query("n1_ticketing_a", f"SELECT external_id, 'music' AS category, s AS start_at, s + INTERVAL 3 HOUR AS end_at, coalesce(description, '') AS description, coalesce(price_min = 0 AND price_max = 0, FALSE) AS is_free, CASE WHEN status = 'cancelled' THEN 'cancelled' ELSE 'active' END AS status FROM (SELECT *, {_A} AS s FROM listings_v) WHERE s >= {NOW} - INTERVAL 24 HOUR")
def n1(spark, sf_dir):
    return listed_a(spark, sf_dir).select("external_id", "category", "start_at", "end_at", F.coalesce("description", F.lit("")).alias("description"), "is_free", "status")


@query("n2_best_image", "SELECT external_id, concat(image_url, '_TABLET_LANDSCAPE_16_9.jpg') AS image FROM listings_v WHERE image_url IS NOT NULL")
def n2(spark, sf_dir):
    return payload_a(spark, sf_dir).select(F.col("id").alias("external_id"), n.best_image(F.col("images")).alias("image")).where("image is not null")


def listed_b(spark, sf_dir):
    text = lambda c: F.struct(F.col(c).cast("string").alias("text"))
    iso = lambda c: F.struct(F.date_format(c, ISO).alias("utc"))
    price = lambda c: F.struct(F.col(c).cast("string").alias("major_value"))
    venue = F.struct(F.col("venue_name").alias("name"), F.struct(F.col("lat").cast("string").alias("latitude"), F.col("lng").cast("string").alias("longitude")).alias("address"))
    body = F.struct(F.col("external_id").alias("id"), text("title").alias("name"), text("description").alias("description"), iso("start_at").alias("start"), iso("end_at").alias("end"), F.lit("live").alias("status"), "is_free", (F.col("id") % 4 == 0).alias("online_event"), venue.alias("venue"), F.struct(price("price_min").alias("minimum_ticket_price"), price("price_max").alias("maximum_ticket_price")).alias("ticket_availability"))
    return n.api_b(parsed(listings(spark, sf_dir), p.API_B, body), AS_OF)


@query("n3_ticketing_b", f"SELECT external_id, start_at, end_at, is_free OR price_min = 0 AS is_free, CASE WHEN NOT (is_free OR price_min = 0) THEN price_min END AS price_min FROM listings_v WHERE id % 4 <> 0 AND lat BETWEEN 40.4774 AND 40.9176 AND lng BETWEEN -74.2591 AND -73.7004 AND {_VALID}")
def n3(spark, sf_dir):
    return listed_b(spark, sf_dir).select("external_id", "start_at", "end_at", "is_free", "price_min")


def listed_c(spark, sf_dir):
    venue = F.struct(F.col("venue_name").alias("name"), F.lit("1 Main St").alias("address"), F.col("venue_name").alias("city"), F.lit("NY").alias("state"), F.lit("10001").alias("postal_code"), F.struct("lat", F.col("lng").alias("lon")).alias("location"))
    body = F.struct("id", "title", F.date_format("start_at", ISO).alias("datetime_utc"), venue.alias("venue"), F.struct(F.col("price_min").alias("lowest_price"), F.col("price_max").alias("highest_price")).alias("stats"))
    return n.api_c(parsed(listings(spark, sf_dir), p.API_C, body), AS_OF)


@query("n4_ticketing_c", f"SELECT CAST(id AS VARCHAR) AS external_id, start_at, concat('1 Main St, ', venue_name, ', NY 10001') AS address, price_min FROM listings_v WHERE {_VALID}")
def n4(spark, sf_dir):
    return listed_c(spark, sf_dir).select("external_id", "start_at", "address", "price_min")


def listed_parks(spark, sf_dir):
    rows = listings(spark, sf_dir)
    e = rows.select(F.col("external_id").alias("event_id"), "title", F.date_format("start_at", "yyyy-MM-dd").alias("date"), F.date_format("start_at", "HH:mm").alias("start_time"), F.lit(None).cast("string").alias("end_time"), F.lit("Great Lawn").alias("location_description"), "description", F.lit(None).cast("string").alias("snippet"), F.when(F.col("id") % 5 == 0, "1").alias("cost_free"), F.when(F.col("id") % 5 <= 1, "$5").alias("cost_description"), F.col("external_id").alias("url"))
    places = rows.where("id % 3 = 0").select(F.col("external_id").alias("event_id"), F.col("venue_name").alias("name"), F.col("lat").cast("string").alias("lat"), F.col("lng").cast("string").alias("long"), F.lit(None).cast("string").alias("address"), F.lit("B").alias("borough"))
    images = rows.where("image_url is not null").select(F.col("external_id").alias("event_id"), F.struct(F.col("image_url").alias("url")).alias("path"), F.lit(None).cast("struct<url:string>").alias("path_2"))
    return n.parks(e, places, images, AS_OF)


@query("n5_parks", f"SELECT external_id, date_trunc('minute', start_at) AS start_at, CASE WHEN id % 3 = 0 THEN coalesce(venue_name, 'NYC Park') ELSE 'Great Lawn' END AS venue_name, id % 5 <> 1 AS is_free FROM listings_v WHERE date_trunc('minute', start_at) >= {NOW} - INTERVAL 24 HOUR")
def n5(spark, sf_dir):
    return listed_parks(spark, sf_dir).select("external_id", "start_at", "venue_name", "is_free")


_TYPES = ["Farmers Market", "Block Party", "Athletic Race / Tour", "Construction"]
_PLACES = ["PROSPECT PARK: LONG MEADOW", "5 AVENUE between EAST 14 STREET and UNION SQUARE", "FOLEY SQUARE"]


@query("n6_permits", f"SELECT concat(external_id, '_', strftime(start_at, '%Y-%m-%d')) AS external_id, CASE id % 4 WHEN 0 THEN 'food_drink' WHEN 2 THEN 'fitness' ELSE 'community' END AS category, CASE id % 3 WHEN 0 THEN 'Prospect Park, Queens, NY' WHEN 1 THEN '5 Avenue & East 14 Street, Queens, NY' ELSE 'Foley Square, Queens, NY' END AS address FROM listings_v WHERE id % 4 <> 3 AND start_at > {NOW} AND start_at <= {NOW} + INTERVAL 60 DAY")
def n6(spark, sf_dir):
    pick = lambda values, m: F.get(F.array(*map(F.lit, values)), (F.col("id") % m).cast("int"))
    rows = listings(spark, sf_dir).select(F.col("external_id").alias("event_id"), F.col("title").alias("event_name"), F.date_format("start_at", ISO).alias("start_date_time"), F.lit(None).cast("string").alias("end_date_time"), F.lit("Parks").alias("event_agency"), pick(_TYPES, 4).alias("event_type"), F.lit("Queens").alias("event_borough"), pick(_PLACES, 3).alias("event_location"))
    return n.permits(rows, AS_OF).select("external_id", "category", "address")


@query("n7_permit_address", "SELECT id, CASE id % 3 WHEN 0 THEN 'Prospect Park, Bronx, NY' WHEN 1 THEN '5 Avenue & East 14 Street, Bronx, NY' ELSE 'Foley Square, Bronx, NY' END AS address FROM listings_v")
def n7(spark, sf_dir):
    place = F.get(F.array(*map(F.lit, _PLACES)), (F.col("id") % 3).cast("int"))
    return listings(spark, sf_dir).select("id", n.permit_address(place, F.lit("Bronx")).alias("address"))


def listed_clubs(spark, sf_dir):
    geocoded = view(spark, sf_dir, "venues_v").groupBy(F.col("name").alias("venue_name")).agg(F.min("lat").alias("lat"), F.min("lng").alias("lng")).withColumn("place_name", F.lit(None).cast("string"))
    event = F.struct(F.col("external_id").alias("id"), "title", F.date_format("start_at", "yyyy-MM-dd").alias("date"), F.date_format("start_at", ISO).alias("startTime"), F.date_format("end_at", ISO).alias("endTime"), F.lit("/e").alias("contentUrl"), F.struct(F.col("venue_name").alias("name")).alias("venue"))
    body = F.struct(F.col("external_id").alias("id"), event.alias("event"))
    return n.clubs(parsed(listings(spark, sf_dir), p.CLUB, body), AS_OF, geocoded)


@query("n8_clubs", f"SELECT external_id, start_at, end_at, coalesce(venue_name, 'TBA') AS venue_name, 'https://ra.co/e' AS ticket_url FROM listings_v l LEFT JOIN (SELECT name, min(lat) AS glat, min(lng) AS glng FROM venues_v GROUP BY name) v ON v.name = l.venue_name WHERE {_VALID} AND (glat IS NULL OR (glat BETWEEN 40.4774 AND 40.9176 AND glng BETWEEN -74.2591 AND -73.7004))")
def n8(spark, sf_dir):
    return listed_clubs(spark, sf_dir).select("external_id", "start_at", "end_at", "venue_name", "ticket_url")


def listed_meetups(spark, sf_dir):
    rows = listings(spark, sf_dir)
    photos = rows.where("image_url is not null").select(F.concat(F.lit("PhotoInfo:"), "id").alias("ref"), F.col("image_url").alias("photo_url"))
    venue = F.struct(F.col("venue_name").alias("name"), F.lit("1 Main St").alias("address"), F.lit("US").alias("country"), "lat", "lng")
    fee = F.when(F.col("id") % 2 != 0, F.struct(F.col("price_min").alias("amount")))
    body = F.struct(F.col("external_id").alias("id"), "title", F.date_format("start_at", ISO).alias("dateTime"), F.when(F.col("id") % 5 == 0, "ONLINE").otherwise("PHYSICAL").alias("eventType"), F.col("ticket_url").alias("eventUrl"), "description", fee.alias("feeSettings"), venue.alias("venue"), F.struct(F.concat(F.lit("PhotoInfo:"), "id").alias("__ref")).alias("featuredEventPhoto"))
    return n.meetups(parsed(rows, p.MEETUP, body), photos, AS_OF)


@query("n9_meetups", f"SELECT external_id, start_at, price_min IS NULL OR id % 2 = 0 AS is_free, image_url FROM listings_v WHERE {_VALID} AND id % 5 <> 0 AND NOT (lat IS NOT NULL AND NOT (lat BETWEEN 40.4774 AND 40.9176 AND lng BETWEEN -74.2591 AND -73.7004))")
def n9(spark, sf_dir):
    return listed_meetups(spark, sf_dir).select("external_id", "start_at", "is_free", "image_url")


def listed_concerts(spark, sf_dir):
    body = F.struct("title", F.array(F.lit("The Headliner"), F.lit("The Opener")).alias("artistNames"), F.date_format("start_at", ISO).alias("dateText"), F.col("venue_name").alias("venueName"), F.concat(F.lit("/concerts/"), "id", F.lit("-x")).alias("ticketUrl"), "description")
    return n.concerts(parsed(listings(spark, sf_dir), p.CONCERT, body), AS_OF)


@query("n12_concerts", f"SELECT CAST(id AS VARCHAR) AS external_id, concat('https://www.songkick.com/concerts/', CAST(id AS VARCHAR), '-x') AS ticket_url, coalesce(nullif(description, ''), 'Featuring: The Headliner, The Opener') AS description FROM listings_v WHERE {_VALID}")
def n12(spark, sf_dir):
    return listed_concerts(spark, sf_dir).select("external_id", "ticket_url", "description")


def calendar_text(spark, sf_dir):
    """One calendar text for each venue name, of weekly and single events."""
    stamp = F.date_format("start_at", "yyyyMMdd'T'HHmmss")
    block = F.concat(F.lit("BEGIN:VEVENT\nUID:"), "external_id", F.lit("\nSUMMARY:"), "title", F.lit("\nDTSTART:"), stamp, F.lit("Z\nLOCATION:"), F.coalesce("venue_name", F.lit("")), F.when(F.col("id") % 2 == 0, F.lit("\nRRULE:FREQ=WEEKLY;COUNT=3")).otherwise(""), F.lit("\nEND:VEVENT\n"))
    body = F.concat(F.lit("BEGIN:VCALENDAR\n"), block, F.lit("END:VCALENDAR\n"))
    return listings(spark, sf_dir).select(F.lit("Feed").alias("feed_title"), body.alias("text"))


@query("n13_calendar_events", f"SELECT count(*) AS n, CAST(count(DISTINCT split_part(external_id, '_', 1)) AS BIGINT) AS events FROM (SELECT id, external_id, unnest(CASE WHEN id % 2 = 0 THEN [0, 7, 14] ELSE [0] END) AS d, date_trunc('second', start_at) AS s FROM listings_v) WHERE s + INTERVAL 1 DAY * d >= {NOW} - INTERVAL 24 HOUR AND (id % 2 = 1 OR (s + INTERVAL 1 DAY * d >= {NOW} AND s + INTERVAL 1 DAY * d <= {NOW} + INTERVAL 60 DAY))")
def n13(spark, sf_dir):
    rows, _ = n.calendars(calendar_text(spark, sf_dir), AS_OF, "The Venue")
    return rows.agg(F.count("*").alias("n"), F.countDistinct(F.get(F.split("external_id", "_"), F.lit(0))).alias("events"))


@query("n14_recurrence", f"SELECT event_id, CAST(len(list_filter(generate_series(0, 59), lambda i: ts + INTERVAL 1 DAY * (i * 2) >= {NOW} AND ts + INTERVAL 1 DAY * (i * 2) <= {NOW} + INTERVAL 60 DAY)) AS INTEGER) AS occurrences FROM events")
def n14(spark, sf_dir):
    return view(spark, sf_dir, "events").select("event_id", F.size(n.recurrences(F.col("ts"), F.lit("FREQ=DAILY;INTERVAL=2"), AS_OF)).alias("occurrences"))


def zoned_calendars(spark, sf_dir):
    """A calendar for each row of events: a series in New York or UTC with two dates taken out, one moved and one cancelled."""
    i, s = F.col("event_id"), F.date_trunc("second", "ts").cast("timestamp_ntz")
    zone = F.when(i % 2 == 0, ";TZID=America/New_York:").otherwise(":")
    every = F.when(i % 3 == 0, 5).otherwise(7)
    rule = F.when(i % 3 == 0, "FREQ=DAILY;INTERVAL=5;COUNT=14").when(i % 3 == 1, "FREQ=WEEKLY;COUNT=10").otherwise("FREQ=DAILY;INTERVAL=7;UNTIL=20240310T120000Z")
    at = lambda k, hours=0: F.concat(F.date_format(s + F.make_dt_interval(every * k, F.lit(hours), F.lit(0), F.lit(0).cast("decimal(18,6)")), "yyyyMMdd'T'HHmmss"), F.when(i % 2 == 0, "").otherwise("Z"))
    series = F.concat(F.lit("BEGIN:VEVENT\nUID:e"), i, F.lit("\nDTSTART"), zone, at(0), F.lit("\nRRULE:"), rule, F.lit("\nEXDATE"), zone, at(2), F.lit(","), at(5), F.lit("\nEND:VEVENT\n"))
    moved = F.concat(F.lit("BEGIN:VEVENT\nUID:e"), i, F.lit("\nRECURRENCE-ID"), zone, at(3), F.lit("\nDTSTART"), zone, at(3, 5), F.lit("\nEND:VEVENT\n"))
    cancelled = F.concat(F.lit("BEGIN:VEVENT\nUID:e"), i, F.lit("\nRECURRENCE-ID"), zone, at(4), F.lit("\nDTSTART"), zone, at(4), F.lit("\nSTATUS:CANCELLED\nEND:VEVENT\n"))
    return view(spark, sf_dir, "events").select(F.lit("Feed").alias("feed_title"), F.lit("text/calendar; charset=utf-8").alias("content_type"), F.concat(series, moved, cancelled).alias("text"))


@query("n14_calendar_instances", f"WITH e AS (SELECT event_id, date_trunc('second', ts) AS s, CASE WHEN event_id % 3 = 0 THEN 5 ELSE 7 END AS step, CASE event_id % 3 WHEN 0 THEN 14 WHEN 1 THEN 10 ELSE 60 END AS n FROM events), w AS (SELECT event_id, k, s + INTERVAL 1 DAY * (step * k) AS own, s + INTERVAL 1 DAY * (step * k) + CASE WHEN k = 3 THEN INTERVAL 5 HOUR ELSE INTERVAL 0 HOUR END AS wall FROM e, unnest(generate_series(0, 59)) AS u(k) WHERE k < n AND k NOT IN (2, 4, 5)), z AS (SELECT event_id, k, CASE WHEN event_id % 2 = 0 THEN timezone('UTC', timezone('America/New_York', own)) ELSE own END AS own, CASE WHEN event_id % 2 = 0 THEN timezone('UTC', timezone('America/New_York', wall)) ELSE wall END AS start_at FROM w) SELECT concat('e', event_id) AS uid, start_at, TRUE AS recurring FROM z WHERE start_at >= {NOW} AND start_at <= {NOW} + INTERVAL 60 DAY AND (event_id % 3 <> 2 OR k = 3 OR own <= TIMESTAMP '2024-03-10 12:00:00')")
def n14_instances(spark, sf_dir):
    rows, _ = c.instances(c.events_of(zoned_calendars(spark, sf_dir)), AS_OF)
    return rows.select("uid", F.col("at").alias("start_at"), "recurring")


def listed_extracted(spark, sf_dir):
    later = F.date_format(F.col("start_at") + n.dates.hours(1), "HH:mm")
    event = F.struct(F.when(F.col("id") % 4 == 0, " ").otherwise(F.col("title")).alias("title"), F.date_format("start_at", "yyyy-MM-dd").alias("date"), F.date_format("start_at", "HH:mm").alias("startTime"), later.alias("endTime"))
    answer = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(event).alias("events"))), F.lit("\n```"))
    rows = listings(spark, sf_dir).select(F.lit("Hall").alias("venue"), F.lit("hall").alias("slug"), answer.alias("answer"))
    return n.extracted(rows, AS_OF)


@query("n16_extracted", f"SELECT concat('llm_hall_', strftime(start_at, '%Y-%m-%d'), '_', substring(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), 1, 40)) AS external_id, date_trunc('minute', start_at) AS start_at, date_trunc('minute', start_at) + INTERVAL 1 HOUR AS end_at FROM listings_v WHERE date_trunc('minute', start_at) >= {NOW} - INTERVAL 24 HOUR AND id % 4 <> 0")
def n16(spark, sf_dir):
    return listed_extracted(spark, sf_dir).select("external_id", "start_at", "end_at")


@query("n17_submissions", "SELECT id, concat_ws(',', CASE WHEN id % 4 = 0 THEN 'title' END, CASE WHEN id % 3 = 0 THEN 'startAt' END, CASE WHEN id % 5 = 0 THEN 'submitterEmail' END) AS errors FROM listings_v")
def n17(spark, sf_dir):
    k = F.col("id")
    rows = listings(spark, sf_dir).select("id", F.when(k % 4 == 0, "").otherwise(F.col("title")).alias("title"), F.col("venue_name").alias("venueName"), F.lit("1 Main Street").alias("address"), F.when(k % 3 == 0, "soon").otherwise(F.date_format("start_at", ISO)).alias("startAt"), F.col("ticket_url").alias("ticketUrl"), F.when(k % 5 == 0, "nobody").otherwise("a@b.org").alias("submitterEmail"))
    return rows.select("id", F.array_join(n.submission_errors(), ",").alias("errors"))


@query("n18_price_backfill", "SELECT id, CASE WHEN source_type = 'eventbrite_api' AND NOT is_free THEN CASE WHEN id % 4 = 1 THEN NULL ELSE 12.5 END END AS price_min, is_free OR (source_type = 'eventbrite_api' AND id % 4 = 1) AS is_free FROM listings_v")
def n18(spark, sf_dir):
    raw = F.concat(F.lit('{"ticket_availability":{"minimum_ticket_price":{"major_value":"'), F.when(F.col("id") % 4 == 1, "0.00").otherwise("12.50"), F.lit('"}}}'))
    rows = listings(spark, sf_dir).select("id", "source_type", F.lit(None).cast("double").alias("price_min"), F.lit(None).cast("double").alias("price_max"), "is_free", raw.alias("raw_source"))
    return n.backfilled_prices(rows).select("id", "price_min", "is_free")


@query("n19_organizer_id", "SELECT id, CAST(id AS VARCHAR) AS organizer FROM listings_v")
def n19(spark, sf_dir):
    k = F.col("id").cast("string")
    url = F.when(F.col("id") % 3 == 0, k).when(F.col("id") % 3 == 1, F.concat(F.lit("https://x.com/o/some-name-"), k, F.lit("?a=1"))).otherwise(F.concat(F.lit("https://x.com/e/a-night-tickets-"), k))
    return listings(spark, sf_dir).select("id", n.organizer_id(url).alias("organizer"))


@query("s3_json_ld", "SELECT page_id, CAST(1 + CAST(page_id % 2 = 0 AS INTEGER) AS INTEGER) AS events, CAST(CASE WHEN page_id % 2 = 0 THEN least(least(12, 7.5 + page_id % 9), page_id % 13) ELSE least(12, 7.5 + page_id % 9) END AS DOUBLE) AS lowest, url AS name, CAST(40 + (page_id % 50) / 100.0 AS DOUBLE) AS lat, CASE WHEN length(url) > 20 THEN concat('A page of listings with a long text: ', url) END AS meta FROM pages")
def s3(spark, sf_dir):
    k = F.col("page_id")
    offers = F.concat(F.lit('[{"price":"12"},{"price":'), (7.5 + k % 9).cast("string"), F.lit("}]"))
    first = F.concat(F.lit('<script type="application/ld+json">{"@type":"MusicEvent","name":'), F.to_json(F.array("url")).substr(F.lit(2), F.length(F.to_json(F.array("url"))) - 2), F.lit(',"location":{"geo":{"latitude":"'), (40 + k % 50 / 100).cast("string"), F.lit('"}},"offers":'), offers, F.lit("}</script>"))
    second = F.concat(F.lit('<script type="application/ld+json">[{"@type":"'), F.when(k % 2 == 0, "Event").otherwise("Place"), F.lit('","name":"y","offers":{"price":"'), (k % 13).cast("string"), F.lit('"}}]</script>'))
    meta = F.when(F.length("url") > 20, F.concat(F.lit('<meta name="description" content="A page of listings with a long text: '), "url", F.lit('">'))).otherwise('<meta name="description" content="short">')
    html = F.concat(meta, "html", first, F.lit('<script type="application/ld+json">{bad</script>'), second)
    rows = view(spark, sf_dir, "pages").select("page_id", p.json_ld_events(html).alias("e"), p.meta_description(html).alias("meta"))
    return rows.select("page_id", F.size("e").alias("events"), F.array_min(F.transform("e", lambda e: p.lowest_offer(e["offers"]))).alias("lowest"), F.col("e")[0]["name"].alias("name"), F.col("e")[0]["location"]["geo"]["latitude"].cast("double").alias("lat"), "meta")


@query("s4_page_state", "SELECT page_id, page_id AS k FROM pages")
def s4(spark, sf_dir):
    state = F.concat(F.lit('<script>window.__SERVER_DATA__ = {"k":'), F.col("page_id"), F.lit("};</script>"))
    return view(spark, sf_dir, "pages").select("page_id", F.get_json_object(p.server_state(F.concat("html", state)), "$.k").cast("long").alias("k"))


@query("s5_calendar_feed", "SELECT external_id AS uid, title AS summary, date_trunc('second', start_at) AS starts FROM listings_v")
def s5(spark, sf_dir):
    b = calendar_text(spark, sf_dir).select(F.explode(p.calendar_events(F.col("text"))).alias("b"))
    return b.select(p.calendar_field(F.col("b"), "UID").alias("uid"), p.calendar_field(F.col("b"), "SUMMARY").alias("summary"), c.utc_of(c.stamp(F.col("b"), "DTSTART", c.known_zones())).alias("starts"))


@query("s10_export_summary", "SELECT status, count(*) AS n FROM verification_v GROUP BY status")
def s10(spark, sf_dir):
    return view(spark, sf_dir, "verification_v").groupBy("status").agg(F.count("*").alias("n"))


@query("s11_geojson", "SELECT id, lng AS x, lat AS y FROM listings_v WHERE lat IS NOT NULL AND lng IS NOT NULL")
def s11(spark, sf_dir):
    from ..sources.exports import geojson_features

    f = geojson_features(listings(spark, sf_dir))
    at = lambda i: F.get_json_object("feature", f"$.geometry.coordinates[{i}]").cast("double")
    return f.select("id", at(0).alias("x"), at(1).alias("y"))


def listed_page_events(spark, sf_dir):
    venue = F.struct(F.col("venue_name").alias("name"), F.struct(F.col("lat").cast("string").alias("latitude"), F.col("lng").cast("string").alias("longitude")).alias("address"))
    tags = F.array(F.struct(F.lit("EventbriteFormat").alias("prefix"), F.lit("Comedy show").alias("display_name")), F.struct(F.when(F.col("id") % 2 == 0, "EventbriteCategory").otherwise("Other").alias("prefix"), F.lit("Music").alias("display_name")))
    body = F.struct(F.col("external_id").alias("eid"), F.col("title").alias("name"), F.col("description").alias("full_description"), F.lit("short").alias("summary"), F.date_format("start_at", "yyyy-MM-dd").alias("start_date"), F.date_format("start_at", "HH:mm").alias("start_time"), venue.alias("primary_venue"), tags.alias("tags"), (F.col("id") % 4 == 3).alias("is_cancelled"))
    return n.page_events(parsed(listings(spark, sf_dir), p.PAGE_EVENT, body), AS_OF)


@query("n10_page_events", f"SELECT external_id, date_trunc('minute', start_at) AS start_at, CASE WHEN id % 2 = 0 THEN 'music' ELSE 'comedy' END AS category, coalesce(description, 'short') AS description FROM listings_v WHERE id % 4 <> 3 AND venue_name IS NOT NULL AND (lat IS NULL OR (lat BETWEEN 40.4774 AND 40.9176 AND lng BETWEEN -74.2591 AND -73.7004)) AND date_trunc('minute', start_at) >= {NOW} - INTERVAL 24 HOUR")
def n10(spark, sf_dir):
    return listed_page_events(spark, sf_dir).select("external_id", "start_at", "category", "description")


@query("n11_cards", f"SELECT external_id, date_trunc('minute', start_at) AS start_at, CAST(CASE WHEN id % 3 = 0 THEN 0 WHEN id % 3 = 1 THEN 12.5 ELSE 9 END AS DOUBLE) AS price_min, id % 3 = 0 AS is_free FROM listings_v WHERE date_trunc('minute', start_at) >= {NOW} - INTERVAL 24 HOUR")
def n11(spark, sf_dir):
    rows = listings(spark, sf_dir)
    price = F.when(F.col("id") % 3 == 0, "Free entry").when(F.col("id") % 3 == 1, "From $12.50")
    card = rows.select(F.col("external_id").alias("externalId"), "title", F.col("ticket_url").alias("ticketUrl"), F.col("image_url").alias("imageUrl"), F.date_format("start_at", "yyyy-MM-dd HH:mm").alias("dateStr"), F.col("venue_name").alias("venueName"), price.alias("priceStr"), F.lit(None).cast("string").alias("address"))
    details = rows.select(F.col("ticket_url").alias("ticketUrl"), F.lit(None).cast("timestamp_ntz").alias("start_at"), F.lit(None).cast("timestamp_ntz").alias("end_at"), "description", F.lit(9.0).alias("price"), "lat", "lng")
    return n.cards(card.union(card), details, AS_OF).select("external_id", "start_at", "price_min", "is_free")


@query("s1_listing_tables", "SELECT source_type, status, count(*) AS n FROM listings_v GROUP BY 1, 2")
def s1(spark, sf_dir):
    from ..operators.graph import checkpointed

    return checkpointed(listings(spark, sf_dir)).groupBy("source_type", "status").agg(F.count("*").alias("n"))


@query("s2_json_pages", "SELECT external_id AS id, title FROM listings_v")
def s2(spark, sf_dir):
    """Pages of a thousand events in an envelope, written as JSON lines and read back by schema."""
    import uuid

    from ..operators.graph import shared_root

    event = F.struct(F.col("external_id").alias("id"), F.col("title").alias("name"))
    pages = listings(spark, sf_dir).groupBy(F.floor(F.col("id") / 1000)).agg(F.to_json(F.struct(F.struct(F.collect_list(event).alias("events")).alias("_embedded"))).alias("value"))
    path = f"{shared_root(spark)}/pages-{uuid.uuid4().hex}"
    pages.select("value").write.text(path)
    return p.read_pages(spark, path, p.API_A, "_embedded.events").select("id", F.col("name").alias("title"))


@query("n15_extracted_events", "SELECT id, trim(title) AS title, CASE WHEN id % 6 <> 3 THEN strftime(start_at, '%H:%M') END AS starts, CASE WHEN id % 4 <> 1 THEN price_min END AS price_min, id % 2 = 0 AS is_free FROM listings_v WHERE id % 5 <> 0 AND id % 7 <> 0")
def n15(spark, sf_dir):
    """A fifth without a title, a seventh without a date; times without a leading zero, prices as text, flags as text."""
    k = F.col("id")
    title = F.when(k % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "title", F.lit(" ")))
    day = F.when(k % 7 == 0, "soon").otherwise(F.date_format("start_at", "yyyy-MM-dd"))
    clock = F.when(k % 6 == 3, "8pm").otherwise(F.date_format("start_at", "HH:mm"))
    price = F.when(k % 4 == 1, '"about 10"').otherwise(F.coalesce(F.col("price_min").cast("string"), F.lit("null")))
    free = F.when(k % 2 == 0, "true").when(k % 3 == 0, '"true"').otherwise("null")
    fields = F.to_json(F.struct(title.alias("title"), day.alias("date"), clock.alias("startTime")))
    event = F.concat(fields.substr(F.lit(1), F.length(fields) - 1), F.lit(',"priceMin":'), price, F.lit(',"isFree":'), free, F.lit("}"))
    rows = listings(spark, sf_dir).select("id", F.concat(F.lit('```json\n{"events":['), event, F.lit("]}\n```")).alias("answer"))
    return n.extracted_events(rows).select("id", "title", F.col("startTime").alias("starts"), F.col("priceMin").alias("price_min"), F.col("isFree").alias("is_free"))


_NORMALIZED = {"n1_ticketing_a": listed_a, "n3_ticketing_b": listed_b, "n4_ticketing_c": listed_c, "n5_parks": listed_parks, "n8_clubs": listed_clubs, "n9_meetups": listed_meetups, "n12_concerts": listed_concerts, "n16_extracted": listed_extracted, "n10_page_events": listed_page_events}
_SOURCE_OF = {"n1_ticketing_a": "ticketmaster_api", "n3_ticketing_b": "eventbrite_api", "n4_ticketing_c": "seatgeek_api", "n5_parks": "nyc_parks_api", "n8_clubs": "ra_scrape", "n9_meetups": "meetup_scrape", "n12_concerts": "songkick_scrape", "n16_extracted": "llm_extraction", "n10_page_events": "eventbrite_scrape"}


@query("u1_normalizers", " UNION ALL ".join(f"SELECT '{_SOURCE_OF[name]}' AS source_type, count(*) AS n, count(DISTINCT external_id) AS ids FROM ({BODIES[name]}) HAVING count(*) > 0" for name in _NORMALIZED))
def u1_normalizers(spark, sf_dir):
    rows = n.united(*(listed(spark, sf_dir) for listed in _NORMALIZED.values()))
    return rows.groupBy("source_type").agg(F.count("*").alias("n"), F.countDistinct("external_id").alias("ids"))


@query("s4_state_events", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN ['a', 'b', 'c'] WHEN page_id % 3 = 1 THEN ['a', 'c'] ELSE ['a', 'b'] END AS slots, url AS name FROM pages")
def s4_events(spark, sf_dir):
    """Events a and c under `events` and `promoted_results`, b at depth 12 or 13; one of c has no address, which is none."""
    page = lambda slot, url: F.to_json(F.struct(F.concat(F.lit(slot), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("name"), F.lit("2024-02-01").alias("start_date"), F.lit("20:00").alias("start_time"), url.alias("url")))
    k = F.col("page_id")
    deep = F.concat(F.repeat(F.lit('{"x":'), F.lit(10)), F.when(k % 3 == 1, F.lit('[{"results":[')).otherwise(F.lit('{"results":[')), page("b", F.lit("u")), F.when(k % 3 == 1, F.lit("]}]")).otherwise(F.lit("]}")), F.repeat(F.lit("}"), F.lit(10)))
    state = F.concat(F.lit('{"list":{"events":['), page("a", F.lit("u")), F.lit(',7,{"name":"n"}]},"more":[{"promoted_results":['), page("c", F.when(k % 3 != 2, "u")), F.lit(']}],"deep":['), deep, F.lit("]}"))
    html = F.concat("html", F.lit("<script>window.__SERVER_DATA__ = "), state, F.lit(";</script>"))
    rows = view(spark, sf_dir, "pages").select("page_id", p.state_events(p.server_state(html)).alias("e"))
    return rows.select("page_id", F.array_sort(F.transform("e", lambda e: e["id"].substr(1, 1))).alias("slots"), F.col("e")[0]["name"].alias("name"))


@query("s4_cached_meetups", f"SELECT external_id, start_at, image_url FROM listings_v WHERE {_VALID} AND id % 5 <> 0 AND NOT (lat IS NOT NULL AND NOT (lat BETWEEN 40.4774 AND 40.9176 AND lng BETWEEN -74.2591 AND -73.7004))")
def s4_meetups(spark, sf_dir):
    """A saved page for each listing: its cache holds the event, its photo and an object of another kind."""
    photo = F.struct(F.lit("PhotoInfo").alias("__typename"), F.col("image_url").alias("highResUrl"))
    venue = F.struct(F.col("venue_name").alias("name"), F.lit("1 Main St").alias("address"), F.lit("US").alias("country"), "lat", "lng")
    event = F.struct(F.lit("Event").alias("__typename"), F.col("external_id").alias("id"), "title", F.date_format("start_at", ISO).alias("dateTime"), F.when(F.col("id") % 5 == 0, "ONLINE").otherwise("PHYSICAL").alias("eventType"), venue.alias("venue"), F.struct(F.lit("PhotoInfo:1").alias("__ref")).alias("displayPhoto"))
    group = F.struct(F.lit("Group").alias("__typename"), F.lit("g").alias("title"))
    cache = F.concat(F.lit('{"props":{"pageProps":{"__APOLLO_STATE__":{"Event:1":'), F.to_json(event), F.lit(',"PhotoInfo:1":'), F.to_json(photo), F.lit(',"Group:1":'), F.to_json(group), F.lit("}}}}"))
    html = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), cache, F.lit("</script></html>"))
    rows = listings(spark, sf_dir).select(F.explode(p.cached_meetups(html)).alias("e")).select("e.*")
    return n.meetups(rows, None, AS_OF).select("external_id", "start_at", "image_url")


@query("s10_export", "SELECT f.filter, count(*) AS count, count(*) FILTER (WHERE status = 'error') AS errors FROM verification_v JOIN (SELECT unnest(['all', 'error']) AS filter) f ON f.filter = 'all' OR f.filter = status GROUP BY f.filter")
def s10_export(spark, sf_dir):
    """Logs exported for all statuses and for one, and read back."""
    import uuid

    from ..operators.graph import shared_root
    from ..sources.exports import export_logs

    logs, root = view(spark, sf_dir, "verification_v"), f"{shared_root(spark)}/exports-{uuid.uuid4().hex}"
    for chosen in ("all", "error"):
        export_logs(logs, f"{root}/{chosen}", AS_OF, chosen)
    read = lambda what, schema: spark.read.schema(schema).json([f"{root}/{c}/{what}" for c in ("all", "error")])
    envelopes = read("summary", "`filter` string, `count` long, stats map<string,long>")
    rows = read("rows", "status string").withColumn("filter", F.regexp_extract(F.input_file_name(), r"/(\w+)/rows/", 1))
    counted = rows.groupBy("filter").agg(F.count("*").alias("n"))
    return envelopes.join(counted, "filter").where("n = `count`").select("filter", "count", F.coalesce(F.try_element_at("stats", F.lit("error")), F.lit(0).cast("long")).alias("errors"))
