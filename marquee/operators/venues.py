"""The venue registry: resolving names to venues, and merging venues that are one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import METRES, haversine, nine_cells, outside_city, valid_location
from ..functions.text import share_identity, venue_key, venue_tokens
from .graph import checkpointed, greedy_heads
from .tables import first_alias, minus

PROXIMITY = 150.0  # metres
CELL = 0.0027  # degrees: over 150 m in latitude, and in longitude up to 60 degrees
SHARED = 0.5
#: Titles of permits that stand where a venue's name should.
PERMIT_TITLE = r"(?i)block party|family (and friends )?day|farmers? market|open streets?"


def keyed(venues: DataFrame) -> DataFrame:
    """venues with key and tokens, worked out once for each distinct name."""
    names = venues.select("name").distinct().withColumn("key", venue_key(F.col("name"))).withColumn("tokens", F.filter(venue_tokens(F.col("key")), lambda t: t != ""))
    return venues.join(names, "name")


def _near(a: DataFrame, b: DataFrame, metres: float, cell: float) -> DataFrame:
    """Pairs of a(.., lat, lng) and b(.., lat_b, lng_b) at most metres apart, with `distance`; an equi-join on cells."""
    y, x = F.floor(F.col("lat") / cell), F.floor(F.col("lng") / cell)
    left = a.where("lat is not null and lng is not null").withColumn("_y", y).withColumn("_x", x)
    right = b.where("lat_b is not null and lng_b is not null").select("*", F.inline(nine_cells(F.col("lat_b"), F.col("lng_b"), cell))).withColumnsRenamed({"y": "_y", "x": "_x"})
    distance = haversine(F.col("lat"), F.col("lng"), F.col("lat_b"), F.col("lng_b"), METRES)
    return left.join(right, ["_y", "_x"]).withColumn("distance", distance).where(F.col("distance") <= metres).drop("_y", "_x")


def resolve(names: DataFrame, venues: DataFrame, aliases: DataFrame, geocoded: DataFrame | None = None) -> DataFrame:
    """name, venue_id, matched_by for distinct names(name, lat, lng): exact key, alias, proximity with a shared name, else created.

    venues(venue_id, name, lat, lng); aliases(normalized_alias, venue_id); geocoded(name, lat, lng) fills places that are
    unusable, unless names have an address that is out of the city. Of several venues: fewest tokens, then nearest, then
    least id. Placeholder and empty names resolve to null. Names that nothing matches come in order of name: each becomes a
    venue, or goes by proximity to one that an earlier name became. Their venue_id is null and new_key the new venue's key.
    """
    ok = valid_location(F.col("lat"), F.col("lng"))
    placed = F.min(F.when(ok, F.struct("lat", "lng"))).alias("p")  # of a name's places the least usable one
    own = names.groupBy("name").agg(placed).select("name", "p.lat", "p.lng")
    if geocoded is not None:
        g = geocoded.groupBy("name").agg(placed.alias("g"))
        if "address" in names.columns:
            g = g.join(names.where(outside_city(F.col("address"))).select("name").distinct(), "name", "left_anti")
        own = own.join(g, "name", "left").select("name", F.when(ok, F.col("lat")).otherwise(F.col("g.lat")).alias("lat"), F.when(ok, F.col("lng")).otherwise(F.col("g.lng")).alias("lng"))
    own = keyed(own.select("name", F.when(ok, F.col("lat")).alias("lat"), F.when(ok, F.col("lng")).alias("lng")))
    usable = (F.col("key") != "") & (F.lower(F.trim("name")) != "unknown venue")
    asked, unnamed = own.where(usable), own.where(~usable)
    registry = keyed(venues.select("venue_id", "name", "lat", "lng")).select("venue_id", F.col("key").alias("key_b"), F.col("tokens").alias("tokens_b"), F.col("lat").alias("lat_b"), F.col("lng").alias("lng_b"))

    exact = registry.where("key_b <> ''").groupBy(F.col("key_b").alias("key")).agg(F.min("venue_id").alias("exact_id"))
    alias = first_alias(aliases, F.col("venue_id")).select(F.col("normalized_alias").alias("key"), F.col("venue_id").alias("alias_id"))
    found = asked.join(exact, "key", "left").join(alias, "key", "left")
    rest = found.where("exact_id is null and alias_id is null")
    close = _near(rest, registry, PROXIMITY, CELL).where(share_identity(F.col("tokens"), F.col("tokens_b"), SHARED))
    best = close.groupBy("name").agg(F.min_by("venue_id", F.struct(F.size("tokens_b"), "distance", "venue_id")).alias("near_id"))
    out = found.join(best, "name", "left")
    how = F.when(F.col("exact_id").isNotNull(), "exact_name").when(F.col("alias_id").isNotNull(), "alias").when(F.col("near_id").isNotNull(), "proximity").otherwise("created")
    out = checkpointed(out.select("name", "key", "tokens", "lat", "lng", F.coalesce("exact_id", "alias_id", "near_id").alias("venue_id"), how.alias("matched_by")))
    into = _among_new(out.where("matched_by = 'created'"))
    how = F.when(F.col("near_key").isNotNull(), "proximity").otherwise(F.col("matched_by"))
    new = F.when(F.col("matched_by") == "created", F.coalesce("near_key", "key"))
    out = out.join(into, "key", "left").select("name", "venue_id", how.alias("matched_by"), new.alias("new_key"))
    none = unnamed.select("name", F.lit(None).cast("long").alias("venue_id"), F.lit(None).cast("string").alias("matched_by"), F.lit(None).cast("string").alias("new_key"))
    return out.union(none)


def _among_new(created: DataFrame) -> DataFrame:
    """key, near_key: names that become no venue, with the best of the new ones that come before them and match by proximity."""
    ok = F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.struct("lat", "lng"))
    new = checkpointed(created.groupBy("key").agg(F.min("name").alias("first"), F.min_by("tokens", "name").alias("tokens"), F.min_by(ok, F.when(ok.isNotNull(), F.col("name"))).alias("p")).select("key", "first", "tokens", "p.lat", "p.lng"))
    before = new.select(F.col("key").alias("u"), F.col("first").alias("first_b"), F.col("tokens").alias("tokens_b"), F.col("lat").alias("lat_b"), F.col("lng").alias("lng_b"))
    close = _near(new, before, PROXIMITY, CELL).where((F.col("first_b") < F.col("first")) & share_identity(F.col("tokens"), F.col("tokens_b"), SHARED))
    edges = checkpointed(close.select("u", F.col("key").alias("v"), F.struct(F.size("tokens_b").alias("n"), "distance", "first_b").alias("rank")))
    got = greedy_heads(new.select(F.col("key").alias("id"), F.struct("first").alias("place"), F.lit(None).cast("string").alias("group")), edges.select("u", "v"))
    heads, folded = got.where("id = head").select(F.col("id").alias("u")), got.where("id <> head").select(F.col("id").alias("v"))
    return edges.join(heads, "u").join(folded, "v").groupBy(F.col("v").alias("key")).agg(F.min_by("u", "rank").alias("near_key"))


def backfilled(venues: DataFrame, matched: DataFrame) -> DataFrame:
    """venues with places from matched(venue_id, name, lat, lng) where they have none; the least name's valid place."""
    ok = matched.where(valid_location(F.col("lat"), F.col("lng"))).groupBy("venue_id").agg(F.min_by(F.struct("lat", "lng"), "name").alias("p"))
    empty = F.col("lat").isNull() | F.col("lng").isNull()
    rows = venues.join(ok, "venue_id", "left")
    return rows.withColumns({"lat": F.when(empty & F.col("p").isNotNull(), F.col("p.lat")).otherwise(F.col("lat")), "lng": F.when(empty & F.col("p").isNotNull(), F.col("p.lng")).otherwise(F.col("lng"))}).select(venues.columns)


def fold_pairs(venues: DataFrame, metres: float, cell: float, least: int, strict: bool) -> DataFrame:
    """small, large: venue ids where small's tokens lie within large's, and both are near."""
    k = keyed(venues.select("venue_id", "name", "lat", "lng"))
    a = k.select("venue_id", "name", "tokens", "lat", "lng").where(F.size("tokens") >= least)
    b = k.select(F.col("venue_id").alias("id_b"), F.col("tokens").alias("tokens_b"), F.col("lat").alias("lat_b"), F.col("lng").alias("lng_b"))
    near = _near(a, b, metres, cell).where("venue_id <> id_b")
    inside = F.size(F.array_intersect("tokens", "tokens_b")) == F.size("tokens")
    size = F.size("tokens") < F.size("tokens_b") if strict else F.size("tokens") <= F.size("tokens_b")
    return near.where(inside & size).select(F.col("name").alias("small_name"), F.col("venue_id").alias("small"), F.col("id_b").alias("large"))


def assign(venues: DataFrame, pairs: DataFrame, same_set: bool) -> DataFrame:
    """duplicate, canonical: in order of token count, then id, each venue takes those of its pairs(small, large) that none
    has taken, and with same_set those of its token set; whoever is taken takes none."""
    k = checkpointed(keyed(venues.select("venue_id", "name")).select(F.col("venue_id").alias("id"), F.struct(F.size("tokens").alias("n"), "venue_id").alias("place"), F.when(F.size("tokens") > 0, F.array_join(F.array_sort("tokens"), " ")).alias("group")))
    nodes = k if same_set else k.withColumn("group", F.lit(None).cast("string"))
    ranked = pairs.join(k.select(F.col("id").alias("small"), F.col("place").alias("p")), "small").join(k.select(F.col("id").alias("large"), F.col("place").alias("q")), "large").where("p < q")
    got = greedy_heads(nodes, ranked.select(F.col("small").alias("u"), F.col("large").alias("v")))
    return got.where("id <> head").select(F.col("id").alias("duplicate"), F.col("head").alias("canonical"))


def dedupe_by_tokens(venues: DataFrame) -> DataFrame:
    """Same tokens anywhere, or contained within 150 m."""
    return assign(venues, fold_pairs(venues, PROXIMITY, CELL, 1, strict=False), same_set=True)


def dedupe_by_name(venues: DataFrame) -> DataFrame:
    """Strictly contained names of three tokens or more within 500 m; a permit's generic title takes no other venue."""
    pairs = fold_pairs(venues, 500.0, 0.009, 3, strict=True).where(~F.col("small_name").rlike(PERMIT_TITLE))
    return assign(venues, pairs, same_set=False)


def merge_into(listings: DataFrame, venues: DataFrame, aliases: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(listings, venues, aliases) with mapping(duplicate, canonical) applied: repointed, dropped, and duplicates' names added as aliases."""
    m = mapping.withColumnRenamed("duplicate", "venue_id")

    def repointed(df: DataFrame) -> DataFrame:
        return df.join(m, "venue_id", "left").withColumn("venue_id", F.coalesce("canonical", "venue_id")).select(df.columns)

    names = keyed(venues.select("venue_id", "name")).join(m, "venue_id").where("key <> ''")
    added = names.select(F.col("name").alias("alias"), F.col("key").alias("normalized_alias"), F.col("canonical").alias("venue_id"), F.lit("venue_merge").alias("source_type"))
    all_aliases = repointed(aliases).withColumn("_new", F.lit(0)).unionByName(added.withColumn("_new", F.lit(1)))
    return repointed(listings), minus(venues, m, "venue_id"), first_alias(all_aliases, F.col("_new"), F.col("venue_id")).drop("_new")
