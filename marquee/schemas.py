"""Names and types that the jobs share."""

from __future__ import annotations

from dataclasses import dataclass, field

TICKET = "struct<platform:string,url:string,price_min:double,price_max:double,is_free:boolean>"
SOURCE_ID = "struct<external_id:string,source_type:string,platform:string>"

#: The common listing shape that every normalizer returns.
LISTING = (
    "external_id string, source_type string, title string, description string, category string, image_url string, "
    "start_at timestamp_ntz, end_at timestamp_ntz, venue_name string, address string, lat double, lng double, is_free boolean, "
    "price_min double, price_max double, currency string, ticket_url string, platform string, confidence_score double, status string, is_verified boolean"
)

# The accepted members of each enumeration.
CATEGORIES = ("music", "comedy", "art", "theater", "food_drink", "fitness", "community", "nightlife", "family", "sports", "film", "other")
EVENT_STATUS = ("active", "cancelled", "draft", "expired")
VERIFICATION_STATUS = ("verified", "flagged_content", "flagged_coordinates", "flagged_both", "skipped", "error")

# How far each source is trusted; others 0.5.
TRUST = {
    "ticketmaster_api": 1.0,
    "eventbrite_api": 0.9,
    "nyc_parks_api": 0.85,
    "songkick_scrape": 0.75,
    "dice_scrape": 0.7,
    "ra_scrape": 0.6,
    "scrape": 0.5,
    "ical": 0.5,
    "rss": 0.45,
    "email": 0.4,
    "submission": 0.4,
    "dice_api": 0.7,
    "seatgeek_api": 0.9,
    "llm_extraction": 0.45,
}
DEFAULT_TRUST = 0.5

# Usual hours of an event by category; others 2.5.
HOURS = {"music": 3.0, "comedy": 1.5, "theater": 2.5, "art": 3.0, "film": 2.0, "nightlife": 4.0, "sports": 3.0, "food_drink": 2.0, "fitness": 1.5, "family": 2.0, "community": 3.0, "other": 2.5}
DEFAULT_HOURS = 2.5


@dataclass(frozen=True)
class City:
    """What the jobs know about a city: its box, places that geocoders fall back to, and its zone."""

    name: str
    min_lat: float
    max_lat: float
    min_lng: float
    max_lng: float
    center: tuple[float, float]
    centroids: tuple[tuple[float, float], ...]
    zone: str
    reach_km: float = 80.0
    default_place: str = "New York, NY"


# The box and the generic centroids of the first city.
NYC = City(
    "New York City", 40.4774, 40.9176, -74.2591, -73.7004, (40.7128, -74.0060),
    ((40.664017, -73.88818), (40.712749, -74.005994), (40.6526, -73.9497), (40.789352, -73.95709), (40.7135, -73.8283), (40.847, -73.8972), (40.58337, -74.149643)),
    "America/New_York",
)


@dataclass(frozen=True)
class FeedQuery:
    """Parameters of a feed: all optional but as_of, a timestamp without zone."""

    as_of: str
    lat: float | None = None
    lng: float | None = None
    radius: float = 10.0
    box: tuple[float, float, float, float] | None = None  # min_lat, max_lat, min_lng, max_lng
    category: str | None = None
    search: str | None = None
    timeframe: str | None = None
    start: str | None = None
    end: str | None = None
    limit: int = 50
    extra: dict = field(default_factory=dict)
