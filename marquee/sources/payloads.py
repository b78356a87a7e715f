"""Schemas of the platforms' payloads, declared and never inferred, and readers of payload files and pages."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType, StructType

from ..functions.text import unescape

API_A = (
    "id string, name string, url string, description string, info string, pleaseNote string, additionalInfo string, images array<struct<url:string,ratio:string>>, "
    "dates struct<start:struct<dateTime:string,localDate:string>,status:struct<code:string>>, priceRanges array<struct<min:double,max:double,currency:string>>, "
    "classifications array<struct<segment:struct<name:string>,genre:struct<name:string>>>, "
    "_embedded struct<venues:array<struct<name:string,address:struct<line1:string>,city:struct<name:string>,location:struct<latitude:string,longitude:string>>>>"
)
API_B = (
    "id string, name struct<text:string>, description struct<text:string>, start struct<utc:string>, `end` struct<utc:string>, status string, is_free boolean, online_event boolean, currency string, url string, "
    "logo struct<url:string,original:struct<url:string>>, category struct<name:string>, format struct<name:string>, venue struct<name:string,address:struct<latitude:string,longitude:string,localized_address_display:string>>, "
    "ticket_availability struct<minimum_ticket_price:struct<major_value:string>,maximum_ticket_price:struct<major_value:string>>"
)
API_C = (
    "id long, title string, short_title string, description string, datetime_utc string, url string, type string, "
    "venue struct<name:string,address:string,city:string,state:string,postal_code:string,location:struct<lat:double,lon:double>>, performers array<struct<name:string,image:string,url:string>>, "
    "stats struct<lowest_price:double,highest_price:double,average_price:double>, taxonomies array<struct<name:string>>"
)
PARK_EVENT = "event_id string, title string, date string, start_time string, end_time string, location_description string, description string, snippet string, cost_free string, cost_description string, url string"
PARK_PLACE = "event_id string, name string, lat string, long string, address string, borough string"
PARK_IMAGE = "event_id string, path struct<url:string>, path_2 struct<url:string>"
PERMIT = "event_id string, event_name string, start_date_time string, end_date_time string, event_agency string, event_type string, event_borough string, event_location string"
CLUB = "id string, event struct<id:string,title:string,date:string,startTime:string,endTime:string,contentUrl:string,flyerFront:string,images:array<struct<filename:string>>,venue:struct<name:string,address:string,contentUrl:string>>"
MEETUP = (
    "id string, title string, dateTime string, eventType string, eventUrl string, description string, feeSettings struct<amount:double>, "
    "venue struct<name:string,address:string,city:string,state:string,country:string,lat:double,lng:double>, featuredEventPhoto struct<__ref:string>, displayPhoto struct<__ref:string>"
)
CACHED = MEETUP + ", __typename string, highResUrl string"
CONCERT = "songkickId string, title string, artistNames array<string>, dateText string, venueName string, venueAddress string, ticketUrl string, imageUrl string, description string, lat double, lng double"
EXTRACTED = "events array<struct<title:string,description:string,date:string,startTime:string,endTime:string,isFree:boolean,priceMin:double,priceMax:double>>"
SUBMISSION = "title string, venueName string, address string, startAt string, ticketUrl string, submitterEmail string"
JSON_LD = "`@type` string, name string, description string, startDate string, endDate string, location struct<name:string,geo:struct<latitude:string,longitude:string>>, offers string"


def read_pages(spark: SparkSession, path: str, schema: str, envelope: str) -> DataFrame:
    """Rows of JSON pages: the array at a dotted path of the envelope, exploded."""
    parts = envelope.split(".")
    wrapped = f"array<struct<{_fields(schema)}>>"
    for p in reversed(parts[1:]):
        wrapped = f"struct<`{p}`:{wrapped}>"
    pages = spark.read.schema(f"`{parts[0]}` {wrapped}").json(path)
    return pages.select(F.explode(F.col(".".join(f"`{p}`" for p in parts))).alias("e")).select("e.*")


def _fields(schema: str) -> str:
    return StructType.fromDDL(schema).simpleString()[len("struct<") : -1]


def json_ld_events(html: Column) -> Column:
    """Array of JSON_LD structs of the page's Event and MusicEvent blocks; blocks that don't parse are ignored."""
    blocks = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    shape = StructType.fromDDL(JSON_LD)
    one = lambda b: F.when(F.trim(b).startswith("["), F.from_json(b, ArrayType(shape))).otherwise(F.array(F.from_json(b, shape)))
    return F.filter(F.flatten(F.coalesce(F.transform(blocks, one), F.array())), lambda e: e["@type"].isin("Event", "MusicEvent"))


def lowest_offer(offers: Column) -> Column:
    """The least price of an offer or an array of offers, as JSON text."""
    several = F.from_json(offers, "array<struct<price:string>>")
    one = F.array(F.from_json(offers, "struct<price:string>"))
    return F.array_min(F.transform(F.when(F.trim(offers).startswith("["), several).otherwise(one), lambda o: o["price"].try_cast("double")))


def meta_description(html: Column) -> Column:
    """The page's meta description where it is longer than 30 characters."""
    d = unescape(F.regexp_extract(html, r'(?is)<meta[^>]+name="description"[^>]+content="([^"]*)"', 1))
    return F.when(F.length(d) > 30, d)


def server_state(html: Column, name: str = "__SERVER_DATA__") -> Column:
    """The JSON text that a page assigns to a window variable; null if none."""
    found = F.regexp_extract(html, rf"(?s)window\.{name}\s*=\s*(\{{.*?\}})\s*;\s*(?:</script>|window\.)", 1)
    return F.when(found != "", found)


# Keys whose arrays hold events, fields that an event must have as strings, depth of the walk.
EVENT_KEYS = ("events", "results", "promoted_results")
EVENT_FIELDS = ("name", "start_date", "start_time", "url")
DEEPEST = 12


def state_events(state: Column, deepest: int = DEEPEST) -> Column:
    """Array of PAGE_EVENT structs: what lies under EVENT_KEYS of any object down to a depth, if it looks like an event.

    Shallow ones come first, within a level in the order of keys, as objects keep no order of their own. Bad JSON gives none.
    """
    none = F.array().cast("array<variant>")
    items = lambda v, at="$": F.coalesce(F.try_variant_get(v, at, "array<variant>"), none)
    fields = lambda v: F.coalesce(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), none)
    is_text = lambda v, f: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant")) == "STRING", F.lit(False))
    looks = lambda e: reduce(and_, (is_text(e, f) for f in EVENT_FIELDS)) & (is_text(e, "id") | is_text(e, "eid"))

    def step(seen, _):
        found = F.flatten(F.transform(seen["at"], lambda o: F.concat(*(items(o, f"$.{k}") for k in EVENT_KEYS))))
        below = F.flatten(F.transform(seen["at"], lambda o: F.concat(fields(o), items(o))))
        return F.struct(below.alias("at"), F.concat(seen["found"], F.filter(found, looks)).alias("found"))

    top = F.filter(F.array(F.try_parse_json(state)), lambda v: v.isNotNull())
    found = F.aggregate(F.sequence(F.lit(0), F.lit(deepest)), F.struct(top.alias("at"), none.alias("found")), step, lambda seen: seen["found"])
    return F.transform(found, lambda e: F.from_json(F.to_json(e), PAGE_EVENT))


def next_cache(html: Column, path: str = "$.props.pageProps.__APOLLO_STATE__") -> Column:
    """The map of objects by reference that a page's __NEXT_DATA__ block holds; null if none."""
    block = F.regexp_extract(html, r'(?is)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    return F.from_json(F.get_json_object(F.when(block != "", block), path), f"map<string,struct<{_fields(CACHED)}>>")


def cached_meetups(html: Column) -> Column:
    """Array of in-person events of the page's cache, as MEETUP structs with photo_url from the object that they refer to."""
    cache = next_cache(html)
    whole = lambda e: (e["__typename"] == "Event") & e["title"].isNotNull() & e["dateTime"].isNotNull() & (e["eventType"] == "PHYSICAL")
    events = F.filter(F.map_values(cache), whole)

    def with_photo(e):
        o = F.try_element_at(cache, F.coalesce(e["featuredEventPhoto"]["__ref"], e["displayPhoto"]["__ref"]))
        photo = F.when(o["__typename"] == "PhotoInfo", o["highResUrl"])
        return F.struct(*(e[f].alias(f) for f in StructType.fromDDL(MEETUP).fieldNames()), photo.alias("photo_url"))

    return F.coalesce(F.transform(events, with_photo), F.array())


def calendar_events(text: Column, typed: Column | None = None) -> Column:
    """Array of VEVENT blocks of a calendar's unfolded text; null for what is no calendar by its start, nor typed as one."""
    unfolded = F.regexp_replace(text, r"\r?\n[ \t]", "")
    blocks = F.regexp_extract_all(unfolded, F.lit(r"(?s)BEGIN:VEVENT\s(.*?)END:VEVENT"), F.lit(1))
    calendar = F.ltrim(text).startswith("BEGIN:VCALENDAR")
    return F.when(calendar if typed is None else calendar | F.coalesce(typed, F.lit(False)), blocks)


def calendar_field(block: Column, name: str) -> Column:
    """A property's value, unescaped; null if it is absent."""
    v = F.regexp_extract(block, rf"(?m)^{name}(?:;[^:\r\n]*)?:([^\r\n]*)", 1)
    v = F.replace(F.replace(F.replace(v, F.lit("\\,"), F.lit(",")), F.lit("\\;"), F.lit(";")), F.lit("\\n"), F.lit("\n"))
    return F.when(v != "", v)


PAGE_EVENT = (
    "id string, eid string, eventbrite_event_id string, name string, summary string, full_description string, start_date string, start_time string, end_date string, end_time string, url string, tickets_url string, "
    "primary_venue struct<name:string,address:struct<latitude:string,longitude:string,localized_address_display:string,address_1:string,city:string,region:string,postal_code:string>>, "
    "image struct<url:string,image_sizes:struct<large:string>>, tags array<struct<prefix:string,display_name:string>>, is_online_event boolean, is_cancelled boolean, is_protected_event boolean"
)
CARD = "externalId string, title string, ticketUrl string, imageUrl string, dateStr string, venueName string, priceStr string, address string"
