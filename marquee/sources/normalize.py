"""Normalizers: each platform's payload rows to the common listing shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.classify import classify, from_taxonomy, lookup
from ..functions.geo import in_box
from ..functions.text import clean_title
from ..operators.enrich import title_is_venue
from ..schemas import LISTING
from .calendars import blank_null, events_of, instances, recurrences  # noqa: F401
from .payloads import calendar_field


def when_utc(c: Column) -> Column:
    """ISO text to a timestamp without zone, on the UTC clock; null if it can't be read."""
    return F.try_to_timestamp(c).cast("timestamp_ntz")


def shaped(rows: DataFrame, **columns) -> DataFrame:
    """rows as LISTING, missing columns null."""
    from pyspark.sql.types import StructType

    out = []
    for f in StructType.fromDDL(LISTING).fields:
        c = columns.get(f.name)
        out.append((F.lit(None) if c is None else c if isinstance(c, Column) else F.lit(c)).cast(f.dataType).alias(f.name))
    return rows.select(*out)


def dated(rows: DataFrame, as_of: str, start: Column, end: Column | None = None) -> DataFrame:
    """rows with start_at and a checked end_at, without those whose dates are invalid."""
    v = dates.validate(F.col("_start"), F.col("_end"), as_of)
    staged = rows.withColumn("_start", start).withColumn("_end", F.lit(None).cast("timestamp_ntz") if end is None else end).withColumn("_v", v)
    return staged.where("_v.is_valid").withColumn("start_at", F.col("_start")).withColumn("end_at", F.col("_v.end_at"))


def titled(c: Column) -> Column:
    return F.coalesce(clean_title(c), c)


def first(c: Column) -> Column:
    return F.get(c, F.lit(0))


# Image sizes in order of preference.
IMAGE_SUFFIXES = ("TABLET_LANDSCAPE_LARGE_16_9", "RETINA_LANDSCAPE_16_9", "TABLET_LANDSCAPE_16_9", "RETINA_PORTRAIT_16_9", "EVENT_DETAIL_PAGE_16_9", "RECOMENDATION_16_9")


def best_image(images: Column, suffixes=IMAGE_SUFFIXES) -> Column:
    """The first image with a preferred suffix, else the first 16:9 one, else the first."""
    having = [first(F.filter(images, _url_has(s))) for s in suffixes]
    having += [first(F.filter(images, lambda i: i["ratio"] == "16_9")), first(images)]
    return F.coalesce(*(h["url"] for h in having))


def _url_has(text: str):
    return lambda i: F.contains(i["url"], F.lit(text))


def api_a(rows: DataFrame, as_of: str) -> DataFrame:
    """N1. Description: the first of four fields that is not empty; free where both prices are 0; the end is estimated."""
    rows = dated(rows, as_of, when_utc(F.coalesce(blank_null(F.col("dates.start.dateTime")), F.col("dates.start.localDate"))))
    venue, price, kind = first(F.col("_embedded.venues")), first(F.col("priceRanges")), first(F.col("classifications"))
    about = F.coalesce(*(blank_null(F.col(c)) for c in ("description", "info", "pleaseNote", "additionalInfo")))
    title = titled(F.coalesce(blank_null(F.col("name")), F.lit("Unknown Title")))
    category = classify(from_taxonomy(kind["segment"]["name"], kind["genre"]["name"]), title, about)
    place = lambda c: blank_null(venue["location"][c]).try_cast("double")
    address = F.when(venue.isNotNull(), F.trim(F.concat(F.coalesce(venue["address"]["line1"], F.lit("")), F.lit(", "), F.coalesce(venue["city"]["name"], F.lit("")))))
    return shaped(
        rows, external_id=F.col("id"), source_type="ticketmaster_api", title=title, description=about, category=category, image_url=best_image(F.col("images")), start_at=F.col("start_at"),
        end_at=F.coalesce("end_at", dates.estimated_end(F.col("start_at"), category)), venue_name=F.coalesce(blank_null(venue["name"]), F.lit("Unknown Venue")), address=address, lat=place("latitude"), lng=place("longitude"),
        is_free=F.coalesce((price["min"] == 0) & (price["max"] == 0), F.lit(False)), price_min=price["min"], price_max=price["max"], currency=blank_null(price["currency"]), ticket_url=F.col("url"), platform="Ticketmaster",
        confidence_score=0.95, status=F.when(F.col("dates.status.code") == "cancelled", "cancelled").otherwise("active"),
    )


def api_b(rows: DataFrame, as_of: str) -> DataFrame:
    """N3. Online events and those without a place in the city go; a free one has no prices."""
    lat, lng = (F.col(f"venue.address.{c}").try_cast("double") for c in ("latitude", "longitude"))
    rows = rows.withColumn("_lat", lat).withColumn("_lng", lng).where(~F.coalesce("online_event", F.lit(False)) & in_box(F.col("_lat"), F.col("_lng")))
    rows = dated(rows, as_of, when_utc(F.col("start.utc")), when_utc(F.col("end.utc")))
    title = titled(F.coalesce(blank_null(F.col("name.text")), F.lit("Unknown Title")))
    low, high = (F.col(f"ticket_availability.{c}_ticket_price.major_value").try_cast("double") for c in ("minimum", "maximum"))
    free = F.coalesce("is_free", F.lit(False)) | F.coalesce(low == 0, F.lit(False))
    original, logo = F.col("logo.original.url"), F.col("logo.url")
    return shaped(
        rows, external_id=F.col("id"), source_type="eventbrite_api", title=title, description=F.col("description.text"), category=classify(from_taxonomy(label=F.col("category.name"), form=F.col("format.name")), title, F.col("description.text")),
        image_url=F.when(original.startswith("http"), original).otherwise(first(F.split(logo, r"\?"))), start_at=F.col("start_at"), end_at=F.col("end_at"), venue_name=F.coalesce(blank_null(F.col("venue.name")), F.lit("Unknown Venue")),
        address=blank_null(F.col("venue.address.localized_address_display")), lat=F.col("_lat"), lng=F.col("_lng"), is_free=free, price_min=F.when(~free, low), price_max=F.when(~free, high), currency=F.coalesce("currency", F.lit("USD")),
        ticket_url=F.col("url"), platform="Eventbrite", confidence_score=0.9, status=F.when(F.col("status") == "live", "active").otherwise("cancelled"),
    )


def api_c(rows: DataFrame, as_of: str) -> DataFrame:
    """N4. The address is built from its parts; free where the lowest price is 0; the end is estimated."""
    rows = dated(rows, as_of, when_utc(F.col("datetime_utc")))
    title = titled(F.coalesce(blank_null(F.col("title")), blank_null(F.col("short_title")), F.lit("Unknown Title")))
    category = classify(F.lit(None).cast("string"), title, F.col("description"))
    v = F.col("venue")
    part = lambda c: F.coalesce(v[c], F.lit(""))
    town = F.concat(part("city"), F.lit(", "), part("state"))
    address = F.when(blank_null(v["address"]).isNotNull(), F.concat(v["address"], F.lit(", "), town, F.lit(" "), part("postal_code"))).otherwise(town)
    return shaped(
        rows, external_id=F.col("id").cast("string"), source_type="seatgeek_api", title=title, description=F.col("description"), category=category, image_url=first(F.col("performers"))["image"], start_at=F.col("start_at"),
        end_at=dates.estimated_end(F.col("start_at"), category), venue_name=v["name"], address=address, lat=v["location"]["lat"], lng=v["location"]["lon"], is_free=F.coalesce(F.col("stats.lowest_price") == 0, F.lit(False)),
        price_min=F.col("stats.lowest_price"), price_max=F.col("stats.highest_price"), currency="USD", ticket_url=F.col("url"), platform="SeatGeek", confidence_score=0.9, status="active",
    )


# Borough codes.
BOROUGHS = {"M": "Manhattan", "B": "Brooklyn", "Q": "Queens", "X": "Bronx", "R": "Staten Island"}


def parks(events: DataFrame, places: DataFrame, images: DataFrame, as_of: str) -> DataFrame:
    """N5. Three tables by event_id; free if flagged, or where neither cost nor description has a dollar sign."""
    p = places.groupBy("event_id").agg(F.max(F.struct("name", "lat", "long", "address", "borough")).alias("p"))
    i = images.groupBy("event_id").agg(F.max(F.coalesce(F.col("path_2.url"), F.col("path.url"))).alias("image"))
    rows = events.where("event_id is not null and event_id <> ''").join(p, "event_id", "left").join(i, "event_id", "left")
    rows = dated(rows, as_of, dates.on_clock(F.substring("date", 1, 10), F.col("start_time")), dates.on_clock(F.substring("date", 1, 10), F.col("end_time")))
    name = F.coalesce("p.name", "location_description", F.lit("NYC Park"))
    borough = F.coalesce(lookup(BOROUGHS, F.col("p.borough")), F.col("p.borough"), F.lit(""))
    dollar = lambda c: F.coalesce(F.contains(F.col(c), F.lit("$")), F.lit(False))
    free = F.coalesce(F.col("cost_free") == "1", F.lit(False)) | ~(dollar("cost_description") | dollar("description"))
    title, about = titled(F.coalesce("title", F.lit("NYC Parks Event"))), F.coalesce("description", "snippet")
    address = F.when(F.col("p.address").isNull() & (borough != ""), F.concat_ws(", ", name, borough, F.lit("NY"))).otherwise(F.coalesce("p.address", "location_description", name))
    return shaped(
        rows, external_id=F.col("event_id"), source_type="nyc_parks_api", title=title, description=about, category=classify(F.lit(None).cast("string"), title, about), image_url=F.col("image"), start_at=F.col("start_at"), end_at=F.col("end_at"),
        venue_name=name, address=address, lat=F.col("p.lat").try_cast("double"), lng=F.col("p.long").try_cast("double"), is_free=free, price_min=F.when(free, 0.0), currency="USD",
        ticket_url=F.concat(F.lit("https://www.nycgovparks.org/events/"), "url"), platform="nyc_parks", confidence_score=0.95, is_verified=True, status="active",
    )


# Permit types that the public may attend, what they are called and their category; others are community.
PERMITS = {
    "Farmers Market": "Farmers market", "Plaza Partner Event": "Free outdoor event", "Open Street Partner Event": "Open streets community event", "Block Party": "Neighborhood block party",
    "Parade": "Public parade", "Street Festival": "Street festival", "Single Block Festival": "Block festival", "Athletic Race / Tour": "Athletic event",
}
PERMIT_CATEGORIES = {"Farmers Market": "food_drink", "Athletic Race / Tour": "fitness"}
PERMIT_DAYS = 60


def street_case(c: Column) -> Column:
    """Each word's first letter in capitals, digits and hyphens parting words too."""
    words = F.array_join(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9_']+|[^a-z0-9_']+"), F.lit(0)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), "")
    return F.regexp_replace(F.regexp_replace(words, r"\bNyc\b", "NYC"), r"\bNy\b", "NY")


def permit_address(location: Column, borough: Column) -> Column:
    """N7. `PARK: AREA` to the park, `X between Y and Z` to `X & Y`, of the first of several segments."""
    head = F.trim(first(F.split(location, r",\s*(?=[A-Z])")))
    cross = r"(?i)^(.+?)\s+between\s+(.+?)\s+and\s+"
    street = F.concat(street_case(F.trim(F.regexp_extract(head, cross, 1))), F.lit(" & "), street_case(F.trim(F.regexp_extract(head, cross, 2))))
    spot = F.when(F.contains(head, F.lit(":")), street_case(F.trim(first(F.split(head, ":"))))).when(head.rlike(cross), street).otherwise(street_case(head))
    return F.concat(spot, F.lit(", "), borough, F.lit(", NY"))


def permits(rows: DataFrame, as_of: str) -> DataFrame:
    """N6. Public permit types of the next 60 days; one listing for each day of a recurring permit."""
    start = when_utc(F.col("start_date_time"))
    rows = rows.where(F.col("event_type").isin(*PERMITS)).where((start > dates.at(as_of)) & (start <= dates.at(as_of) + dates.hours(24 * PERMIT_DAYS)))
    rows = dated(rows.where(F.trim("event_name") != ""), as_of, start, when_utc(F.col("end_date_time")))
    title = titled(F.col("event_name"))
    about = F.concat(lookup(PERMITS, F.col("event_type")), F.lit(" in "), "event_borough", F.lit(", permitted by the NYC "), "event_agency", F.lit("."))
    return shaped(
        rows, external_id=F.concat_ws("_", "event_id", F.substring("start_date_time", 1, 10)), source_type="nyc_permits", title=title, description=about, category=F.coalesce(lookup(PERMIT_CATEGORIES, F.col("event_type")), F.lit("community")),
        start_at=F.col("start_at"), end_at=F.col("end_at"), venue_name=title, address=permit_address(F.col("event_location"), F.col("event_borough")), is_free=True, currency="USD", platform="NYC Permits", confidence_score=0.75, status="active",
    )


def clubs(rows: DataFrame, as_of: str, geocoded: DataFrame) -> DataFrame:
    """N8. Start time else date; flyer else first image; places come from geocoded(venue_name, lat, lng, place_name), those outside the city go."""
    e = rows.select("event.*").where("id is not null and coalesce(title, '') <> ''").withColumn("venue_name", F.coalesce(blank_null(F.col("venue.name")), F.lit("TBA")))
    e = e.join(geocoded.where("venue_name <> 'TBA'").dropDuplicates(["venue_name"]), "venue_name", "left").where(F.col("lat").isNull() | in_box(F.col("lat"), F.col("lng")))
    e = dated(e, as_of, when_utc(F.coalesce(blank_null(F.col("startTime")), F.col("date"))), when_utc(F.col("endTime")))
    title = titled(F.col("title"))
    return shaped(
        e, external_id=F.col("id"), source_type="ra_scrape", title=title, category=classify(F.lit(None).cast("string"), title, F.lit(None).cast("string"), default="music"), image_url=F.coalesce("flyerFront", first(F.col("images"))["filename"]),
        start_at=F.col("start_at"), end_at=F.col("end_at"), venue_name=F.col("venue_name"), address=F.coalesce("place_name", blank_null(F.col("venue.address"))), lat=F.col("lat"), lng=F.col("lng"), is_free=False, currency="USD",
        ticket_url=F.concat(F.lit("https://ra.co"), "contentUrl"), platform="Resident Advisor", confidence_score=0.85, status="active",
    )


def meetups(rows: DataFrame, photos: DataFrame | None, as_of: str) -> DataFrame:
    """N9. In-person events with a venue in the city; no fee means free.

    Photos come by reference from photos(ref, photo_url), or stand in rows as photo_url where photos is None.
    """
    v = F.col("venue")
    outside = v["lat"].isNotNull() & v["lng"].isNotNull() & ~in_box(v["lat"], v["lng"])
    rows = rows.where((F.col("eventType") == "PHYSICAL") & (F.coalesce(v["name"], F.lit("")) != "") & ~outside)
    rows = dated(rows, as_of, when_utc(F.col("dateTime")))
    if photos is not None:
        rows = rows.withColumn("ref", F.coalesce("featuredEventPhoto.__ref", "displayPhoto.__ref")).join(photos, "ref", "left")
    title, fee = titled(F.col("title")), F.col("feeSettings.amount")
    country = F.when(v["country"] == "US", "USA").otherwise(v["country"])
    return shaped(
        rows, external_id=F.col("id"), source_type="meetup_scrape", title=title, description=F.col("description"), category=classify(F.lit(None).cast("string"), title, F.col("description"), default="community"), image_url=F.col("photo_url"),
        start_at=F.col("start_at"), end_at=F.col("end_at"), venue_name=v["name"], address=F.concat_ws(", ", *(blank_null(c) for c in (v["address"], v["city"], v["state"], country))), lat=v["lat"], lng=v["lng"], is_free=F.col("feeSettings").isNull(),
        price_min=fee, price_max=fee, currency="USD", ticket_url=F.col("eventUrl"), platform="Meetup", confidence_score=0.8, status="active",
    )


def concert_id(url: Column) -> Column:
    """/concerts/n, else /id/n, else the first /n."""
    found = [blank_null(F.regexp_extract(url, p, 1)) for p in (r"/concerts/(\d+)", r"/id/(\d+)", r"/(\d+)")]
    return F.coalesce(*found)


def support_acts(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r",|\band\b|&"), lambda a: F.trim(F.regexp_replace(a, r"(?i)^and\s+", ""))), lambda a: a != "")


def concerts(rows: DataFrame, as_of: str) -> DataFrame:
    """N12. A title that is just the venue becomes the artists; several artists make the description."""
    rows = dated(rows, as_of, F.coalesce(when_utc(F.col("dateText")), F.when(F.coalesce("dateText", F.lit("")) == "", dates.at(as_of))))
    artists = F.array_join("artistNames", ", ")
    named = titled(F.coalesce(blank_null(F.col("title")), blank_null(artists), F.lit("Live Event")))
    title = F.when(F.coalesce(title_is_venue(named, F.col("venueName")), F.lit(False)) & (F.size("artistNames") > 0), titled(artists)).otherwise(named)
    featuring = F.when(F.size("artistNames") > 1, F.concat(F.lit("Featuring: "), artists))
    image = F.regexp_replace("imageUrl", "^//", "https://")
    category = classify(F.lit(None).cast("string"), title, featuring, default="music")
    url = F.when(F.col("ticketUrl").startswith("http"), F.col("ticketUrl")).otherwise(F.concat(F.lit("https://www.songkick.com"), "ticketUrl"))
    return shaped(
        rows, external_id=F.coalesce(blank_null(F.col("songkickId")), concert_id(F.col("ticketUrl"))), source_type="songkick_scrape", title=title, description=F.coalesce(blank_null(F.col("description")), featuring), category=category,
        image_url=F.when(~F.contains(image, F.lit("default-artist.png")), image), start_at=F.col("start_at"), end_at=dates.estimated_end(F.col("start_at"), category), venue_name=F.col("venueName"),
        address=F.coalesce(blank_null(F.col("venueAddress")), F.concat("venueName", F.lit(", New York, NY"))), lat=F.col("lat"), lng=F.col("lng"), is_free=False, currency="USD", ticket_url=url, platform="songkick", confidence_score=0.85, status="active",
    )


IMAGE_FILE = r"(?i)\.(jpe?g|png|gif|webp|svg|avif)(\?|$)"


def calendar_image(block: Column) -> Column:
    attach = F.regexp_extract_all(block, F.lit(r"(?m)^ATTACH[^:\r\n]*:http[^\r\n]*"), F.lit(0))
    good = first(F.filter(attach, lambda a: F.contains(a, F.lit("FMTTYPE=image/")) | a.rlike(IMAGE_FILE)))
    custom = F.coalesce(*(calendar_field(block, n) for n in ("IMAGE", "X-WR-IMAGE", "X-IMAGE")))
    tag = F.regexp_extract(calendar_field(block, "DESCRIPTION"), r"""(?i)<img[^>]+src=["'](http[^"']+)["']""", 1)
    return F.coalesce(F.when(calendar_field(block, "IMAGE").startswith("http"), calendar_field(block, "IMAGE")), F.regexp_extract(good, r":(http.*)$", 1), F.when(custom.startswith("http"), custom), blank_null(tag))


def calendars(texts: DataFrame, as_of: str, venue: str) -> tuple[DataFrame, DataFrame]:
    """N13, N14. (listings, rejects(uid, rule)) of texts(feed_title, text), with content_type or without: a listing for each instance."""
    rows, rejects = instances(events_of(texts), as_of)
    field = lambda n: calendar_field(F.col("b"), n)
    rows = rows.withColumns({"summary": field("SUMMARY"), "about": field("DESCRIPTION"), "location": field("LOCATION"), "url": field("URL")})
    rows = dated(rows, as_of, F.col("at"), F.col("ends"))
    name = F.trim(first(F.split("location", ",")))
    likely = (F.length(name) > 0) & (F.length(name) < 60) & ~name.rlike(r"^\d")
    title = titled(F.coalesce("summary", F.lit("Untitled Event")))
    iso = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    listings = shaped(
        rows, external_id=F.when(F.col("recurring"), F.concat_ws("_", "uid", iso)).otherwise(F.col("uid")), source_type="ical", title=title, description=F.col("about"), category=classify(F.lit(None).cast("string"), title, F.col("about")),
        image_url=calendar_image(F.col("b")), start_at=F.col("start_at"), end_at=F.col("end_at"), venue_name=F.when(F.coalesce(likely, F.lit(False)), name).otherwise(venue), address=F.col("location"), is_free=False, currency="USD", ticket_url=F.col("url"),
        platform=F.coalesce("feed_title", F.lit(venue)), confidence_score=0.5, status="active",
    )
    return listings, rejects


def extracted_events(rows: DataFrame) -> DataFrame:
    """N15. Events of rows(..., answer), a model's JSON answer in code fences or not, with rows' other columns.

    Titles, dates and descriptions are trimmed; an event without title or a date like 2024-01-31 is dropped; times that are
    no HH:mm and prices that are no numbers become null, isFree is true only where the answer says so.
    """
    from .payloads import EXTRACTED

    plain = F.trim(F.regexp_replace("answer", r"(?m)^```[a-z]*\s*$|```", ""))
    others = [c for c in rows.columns if c != "answer"]
    e = rows.select(*others, F.explode(F.from_json(plain, EXTRACTED)["events"]).alias("e")).select(*others, "e.*")
    clock = lambda c: F.when(F.col(c).rlike(r"^\d{2}:\d{2}$"), F.col(c))
    trimmed = {c: F.trim(c) for c in ("title", "date", "description")}
    e = e.withColumns(trimmed | {"startTime": clock("startTime"), "endTime": clock("endTime"), "isFree": F.coalesce("isFree", F.lit(False))})
    return e.where((F.col("title") != "") & F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"))


def extracted(rows: DataFrame, as_of: str) -> DataFrame:
    """N16. Listings of extracted_events over rows(venue, slug, answer)."""
    e = extracted_events(rows.select("venue", "slug", "answer"))
    start = dates.on_clock(F.col("date"), F.coalesce("startTime", F.lit("00:00")))
    end = dates.on_clock(F.col("date"), F.col("endTime"))
    end = F.when(end <= start, end + dates.hours(24)).otherwise(end)
    e = dated(e, as_of, start, end)
    title = titled(F.trim("title"))
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim("title")), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 40)
    return shaped(
        e, external_id=F.concat(F.lit("llm_"), F.concat_ws("_", "slug", "date", slug)), source_type="llm_extraction", title=title, description=F.col("description"), category=classify(F.lit(None).cast("string"), title, F.col("description")), start_at=F.col("start_at"),
        end_at=F.col("end_at"), venue_name=F.col("venue"), is_free=F.coalesce("isFree", F.lit(False)), price_min=F.col("priceMin"), price_max=F.col("priceMax"), currency="USD", confidence_score=0.45, status="active",
    )


def submission_errors() -> Column:
    """N17. Field errors of a submission; none means it is a draft."""
    bad = {
        "title": ~F.coalesce(F.length(F.trim("title")).between(1, 200), F.lit(False)),
        "venueName": ~F.coalesce(F.length(F.trim("venueName")).between(1, 200), F.lit(False)),
        "address": ~F.coalesce(F.length(F.trim("address")).between(1, 300), F.lit(False)),
        "startAt": when_utc(F.col("startAt")).isNull(),
        "ticketUrl": ~F.coalesce(F.col("ticketUrl").rlike(r"^https?://[^\s/]+"), F.lit(False)),
        "submitterEmail": ~F.coalesce(F.col("submitterEmail").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.lit(False)),
    }
    return F.array_compact(F.array(*(F.when(c, name) for name, c in bad.items())))


def backfilled_prices(rows: DataFrame) -> DataFrame:
    """N18. Prices of priceless rows that aren't free from their raw JSON; 0 makes them free."""
    raw = lambda c: F.get_json_object("raw_source", f"$.ticket_availability.{c}_ticket_price.major_value").try_cast("double")
    todo = (F.col("source_type") == "eventbrite_api") & F.col("price_min").isNull() & ~F.coalesce("is_free", F.lit(False)) & raw("minimum").isNotNull()
    free = todo & (raw("minimum") == 0)
    put = lambda c, v: F.when(free, None).when(todo, v).otherwise(F.col(c))
    return rows.withColumns({"price_min": put("price_min", raw("minimum")), "price_max": put("price_max", raw("maximum")), "is_free": F.when(free, True).otherwise(F.col("is_free"))})


def organizer_id(url: Column) -> Column:
    """N19. Digits as they are; those at the end of /o/…; those at the end of /e/… (an event's)."""
    found = [F.regexp_extract(F.trim(url), p, 1) for p in (r"^(\d+)$", r"(?i)/o/.*?(\d+)(?:\?|/|$)", r"(?i)/e/.*?(\d+)(?:\?|/|$)")]
    return F.coalesce(*(blank_null(x) for x in found))


def page_events(rows: DataFrame, as_of: str) -> DataFrame:
    """N10. Public in-person events of page states; the first of each id in pull order (a `pulled` column, if there is one)."""
    from ..operators.tables import latest

    hidden = F.coalesce("is_online_event", F.lit(False)) | F.coalesce("is_cancelled", F.lit(False)) | F.coalesce("is_protected_event", F.lit(False))
    rows = rows.where(~hidden).withColumn("_id", F.coalesce("eventbrite_event_id", "eid", "id"))
    rows = latest(rows, ["_id"], *(["pulled"] if "pulled" in rows.columns else []), F.col("url"), F.col("name"))
    v, a = F.col("primary_venue"), F.col("primary_venue.address")
    placed = blank_null(a["latitude"]).isNotNull() & blank_null(a["longitude"]).isNotNull()
    rows = rows.withColumn("_lat", F.when(placed, a["latitude"].try_cast("double"))).withColumn("_lng", F.when(placed, a["longitude"].try_cast("double")))
    rows = rows.where(blank_null(v["name"]).isNotNull() & (F.col("_lat").isNull() | F.col("_lng").isNull() | in_box(F.col("_lat"), F.col("_lng"))))
    clock = lambda d, t: dates.on_clock(F.col(d), F.col(t))
    end = F.when(F.col("end_date").isNotNull() & F.col("end_time").isNotNull(), clock("end_date", "end_time"))
    rows = dated(rows, as_of, clock("start_date", "start_time"), end)
    tag = lambda prefix: first(F.filter("tags", _tagged(prefix)))["display_name"]
    title, about = titled(F.col("name")), F.coalesce("full_description", "summary")
    address = F.concat_ws(", ", *(blank_null(x) for x in (F.coalesce(a["localized_address_display"], a["address_1"]), a["city"], a["region"], a["postal_code"])))
    return shaped(
        rows, external_id=F.col("_id"), source_type="eventbrite_scrape", title=title, description=about, category=classify(from_taxonomy(label=tag("EventbriteCategory"), form=tag("EventbriteFormat")), title, about),
        image_url=F.coalesce("image.image_sizes.large", "image.url"), start_at=F.col("start_at"), end_at=F.col("end_at"), venue_name=v["name"], address=F.when(a.isNull(), v["name"]).otherwise(address), lat=F.col("_lat"), lng=F.col("_lng"),
        ticket_url=F.coalesce("tickets_url", "url"), platform="Eventbrite", currency="USD", confidence_score=0.85, status="active",
    )


def _tagged(prefix: str):
    return lambda t: t["prefix"] == prefix


def card_price(text: Column) -> Column:
    """$n or $n.nn; 0 for free; null for anything else."""
    amount = F.regexp_extract(text, r"\$\s*(\d+(?:\.\d{1,2})?)", 1)
    return F.when(text.rlike("(?i)free"), 0.0).otherwise(blank_null(amount).try_cast("double"))


def card_date(text: Column, as_of: str) -> Column:
    """The card's date at its time, else at 20:00: `YYYY-MM-DD`, `tomorrow`, or today for all that can't be read."""
    day = F.coalesce(F.try_to_timestamp(F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd")).cast("date"), F.when(text.rlike("(?i)tomorrow"), F.date_add(F.to_date(dates.at(as_of)), 1)), F.to_date(dates.at(as_of)))
    clock = F.coalesce(blank_null(F.regexp_extract(text, r"(\d{1,2}:\d{2})", 1)), F.lit("20:00"))
    return F.try_to_timestamp(F.concat_ws(" ", day.cast("string"), F.lpad(clock, 5, "0")), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")


CARD_COLUMNS = ("title", "ticketUrl", "imageUrl", "dateStr", "venueName", "priceStr", "address")


def cards(rows: DataFrame, details: DataFrame, as_of: str) -> DataFrame:
    """N11. Cards merged by id (in each column the first value that is not empty, in order of `pulled` where rows have it,
    else of the cards' own columns) with details(ticketUrl, start_at, end_at, description, price, lat, lng) of their pages."""
    order = F.struct(*(["pulled"] if "pulled" in rows.columns else []), *CARD_COLUMNS)
    text = lambda c: F.min_by(c, F.when(blank_null(F.col(c)).isNotNull(), order)).alias(c)
    merged = rows.where("coalesce(title, '') <> 'Unknown Event'").groupBy("externalId").agg(*map(text, CARD_COLUMNS))
    d = details.select("ticketUrl", *(F.col(c).alias(f"d_{c}") for c in ("start_at", "end_at", "description", "price", "lat", "lng"))).dropDuplicates(["ticketUrl"])
    rows = dated(merged.join(d, "ticketUrl", "left"), as_of, F.coalesce("d_start_at", card_date(F.col("dateStr"), as_of)), F.col("d_end_at"))
    title = titled(F.col("title"))
    category = classify(F.lit(None).cast("string"), title, F.col("d_description"))
    price = F.coalesce(card_price(F.col("priceStr")), F.col("d_price"))
    return shaped(
        rows, external_id=F.col("externalId"), source_type="dice_scrape", title=title, description=F.col("d_description"), category=category, image_url=F.col("imageUrl"), start_at=F.col("start_at"),
        end_at=F.coalesce("end_at", dates.estimated_end(F.col("start_at"), category)), venue_name=F.col("venueName"), address=F.col("address"), lat=F.col("d_lat"), lng=F.col("d_lng"), is_free=F.coalesce(price == 0, F.lit(False)), price_min=price,
        ticket_url=F.col("ticketUrl"), platform="Dice", confidence_score=0.7, status="active",
    )


def united(*pulls: DataFrame) -> DataFrame:
    """U1. Listings of several normalizers as one table; what a pull lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pulls)
