"""Places: distances, cells, boxes, and what makes an address or a coordinate usable."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import NYC, City

MILES, METRES = 3958.8, 6_371_000.0  # the earth's radius


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float) -> Column:
    """Great-circle distance in the radius' unit."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def in_box(lat: Column, lng: Column, city: City = NYC) -> Column:
    """Inclusive on all sides; false for nulls."""
    return F.coalesce(lat.between(city.min_lat, city.max_lat) & lng.between(city.min_lng, city.max_lng), F.lit(False))


def valid_location(lat: Column, lng: Column, city: City = NYC, near: float = 0.005) -> Column:
    """In the city's box and not at one of its generic centroids."""
    generic = F.lit(False)
    for a, b in city.centroids:
        generic = generic | ((F.abs(lat - a) < near) & (F.abs(lng - b) < near))
    return in_box(lat, lng, city) & ~F.coalesce(generic, F.lit(True))


# Addresses that name no more than a city, and words that name a street.
GENERIC = (
    r"^brooklyn,\s*ny(,\s*us)?$", r"^new\s*york\s*\(nyc\),\s*ny(,\s*us)?$", r"^new\s*york,\s*ny(,\s*us)?$", r"^manhattan,\s*ny(,\s*us)?$",
    r"^bronx,\s*ny(,\s*us)?$", r"^queens,\s*ny(,\s*us)?$", r"^staten\s*island,\s*ny(,\s*us)?$", r"^nyc(,\s*ny)?(,\s*us)?$", r"^united\s*states$", r"^us$",
)
STREETS = r"\b(st|street|ave|avenue|rd|road|blvd|boulevard|ln|lane|pl|place|dr|drive|way|pkwy|parkway|ct|court|ter|terrace|cir|circle|hwy|highway|expy|expressway)\b"
STREET = r"\b(st|street|ave|avenue|rd|road|blvd|boulevard|ln|lane|pl|place|dr|drive|way)\b"
UNIT = r"\b(floor|fl|suite|ste|apt|room|unit|level)\b"


def generic_address(address: Column) -> Column:
    a = F.trim(address)
    empty = F.coalesce(a == "", F.lit(True))
    specific = a.rlike(f"(?i){STREETS}") | a.rlike(r"\b\d{5}(-\d{4})?\b") | a.rlike(r"^\d+")
    return F.when(empty | a.rlike("(?i)" + "|".join(GENERIC)), True).when(specific, False).otherwise(F.length(a) < 15)


# Places around the city whose names disqualify an address, and marks of other states.
NASSAU = "hempstead|garden city|mineola|great neck|long beach|rockville centre|valley stream|freeport|oceanside|lynbrook|elmont|floral park|new hyde park|manhasset|port washington|glen cove|oyster bay|hicksville|levittown|wantagh|massapequa|merrick|bellmore|east meadow|uniondale|roosevelt|inwood|woodmere"
SUFFOLK = "huntington|babylon|islip|smithtown|brookhaven|riverhead|southampton|east hampton|shelter island|southold|central islip|brentwood|bay shore|amityville|lindenhurst|west babylon|copiague|deer park|north babylon|commack|hauppauge|ronkonkoma|bohemia|holbrook|patchogue|coram|medford|centereach|stony brook|port jefferson|setauket|miller place|rocky point|sound beach|farmingville|selden|lake grove|lake ronkonkoma|shirley|mastic|mastic beach|bellport|east patchogue|sayville|west sayville|oakdale|great river|brightwaters|west islip|east islip|islip terrace|east brentwood|north amityville|north lindenhurst|melville|south huntington|east northport|cold spring harbor|dix hills|half hollow hills|wheatley heights|wyandanch"
WESTCHESTER = "yonkers|new rochelle|mount vernon|white plains|port chester|scarsdale|harrison|rye|mamaroneck|larchmont|pelham|eastchester|tuckahoe|bronxville|dobbs ferry|ardsley|hastings|tarrytown|sleepy hollow|ossining|peekskill|mount pleasant|greenburgh|elmsford|valhalla|hawthorne|pleasantville|briarcliff manor|yorktown|mount kisco|bedford|north castle"
OTHER_STATES = "newark|jersey city|hoboken|secaucus|weehawken|union city|bayonne|kearny|rutherford|east rutherford|meadowlands|paramus|hackensack|fort lee|edgewater|englewood|teaneck|greenwich|stamford|norwalk|bridgeport"
MARKS = r", nj|, n\.j\.|, ct|, conn"
OUTSIDE = rf"{MARKS}|,\s*({NASSAU}|{SUFFOLK}|{WESTCHESTER}|{OTHER_STATES})(\s*,|\s+ny\b|\s+new york\b|$)"


def outside_city(address: Column) -> Column:
    return F.coalesce(F.lower(address).rlike(OUTSIDE), F.lit(False))


def resolve_location(address: Column, lat: Column, lng: Column, geo_lat: Column, geo_lng: Column, city: City = NYC) -> Column:
    """struct(lat, lng, is_verified) from the listing's own coordinates and a geocoder's."""
    own, far = valid_location(lat, lng, city), haversine(F.lit(city.center[0]), F.lit(city.center[1]), geo_lat, geo_lng, METRES) > city.reach_km * 1000

    def place(a: Column, b: Column, sure: bool) -> Column:
        return F.struct(a.cast("double").alias("lat"), b.cast("double").alias("lng"), F.lit(sure).alias("is_verified"))

    nowhere = place(F.lit(None), F.lit(None), False)
    out = F.when(outside_city(address), nowhere).when(own & ~generic_address(address), place(lat, lng, True))
    out = out.when(F.coalesce(far, F.lit(False)), nowhere).when(valid_location(geo_lat, geo_lng, city), place(geo_lat, geo_lng, True))
    return out.when(own, place(lat, lng, False)).otherwise(nowhere)


def sanitize_address(address: Column) -> Column:
    """Comma segments without unit parts; segments that are nothing else go."""
    cleared = F.regexp_replace(F.coalesce(address, F.lit("")), r"(?i)\s*\(nyc\)", "")

    def segment(s: Column) -> Column:
        t = F.trim(s)
        street = t.rlike(f"(?i){STREET}") | t.rlike(r"^\d+\s+[a-zA-Z]")
        return F.when(~t.rlike(f"(?i){UNIT}"), t).when(street, F.trim(F.regexp_replace(t, rf"(?i)\s*{UNIT}.*$", ""))).otherwise("")

    return F.array_join(F.filter(F.transform(F.split(cleared, ","), segment), lambda s: s != ""), ", ")


def around(lat: float, lng: float, radius: float) -> tuple[float, float, float, float]:
    """min_lat, max_lat, min_lng, max_lng of a radius in miles: 69 miles a degree of latitude."""
    dy, dx = radius / 69.0, radius / (69.0 * math.cos(math.radians(lat)))
    return lat - dy, lat + dy, lng - dx, lng + dx


def cell(lat: Column, lng: Column, size: float) -> tuple[Column, Column]:
    return F.floor(lat / size), F.floor(lng / size)


def nine_cells(lat: Column, lng: Column, size: float) -> Column:
    """Array of structs (y, x): the place's cell and its eight neighbours, for an equi-join on cells."""
    y, x = cell(lat, lng, size)
    return F.array(*(F.struct((y + i).alias("y"), (x + j).alias("x")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
