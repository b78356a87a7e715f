"""Checks, scores and counts over listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import at, overdue, stale
from ..functions.text import js_round


def blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def no_place() -> Column:
    return F.col("lat").isNull() | F.col("lng").isNull()


def count_of(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def price_issues() -> Column:
    low, high = F.col("price_min"), F.col("price_max")
    checks = {"negative_min": low < 0, "negative_max": high < 0, "min_over_max": low > high, "high_max": high > 10000, "free_with_price": F.col("is_free") & (low > 0)}
    return F.array_compact(F.array(*(F.when(c, name) for name, c in checks.items())))


def missing_fields() -> Column:
    checks = {"imageUrl": blank("image_url"), "description": blank("description"), "coordinates": no_place(), "category": blank("category") | (F.col("category") == "other")}
    return F.array_compact(F.array(*(F.when(c, name) for name, c in checks.items())))


def is_stale_now(as_of: str) -> Column:
    """Active, and its end (else its start) has passed."""
    return (F.col("status") == "active") & (F.coalesce("end_at", "start_at") < at(as_of))


def hours_ago(as_of: str) -> Column:
    micros = F.unix_micros(at(as_of).cast("timestamp")) - F.unix_micros(F.coalesce("end_at", "start_at").cast("timestamp"))
    return js_round(micros / 3.6e9)


def quality_score(fresh: Column, missing: Column, placed: Column, priced: Column, single: Column) -> Column:
    points = lambda c, n: F.when(c, n).otherwise(0)
    return points(fresh, 20) + js_round((4 - missing) / 4.0 * 30).cast("int") + points(placed, 25) + points(priced, 10) + points(single, 15)


def audited(listings: DataFrame, as_of: str, duplicates: DataFrame, deltas: DataFrame, most_metres: float = 500) -> DataFrame:
    """Row checks, duplicates(id) and coordinate deltas(id, delta_meters) joined into a score for each listing."""
    dup = duplicates.select("id").distinct().withColumn("dup", F.lit(True))
    rows = listings.join(dup, "id", "left").join(deltas.select("id", "delta_meters"), "id", "left")
    checks = rows.select(
        "id",
        "source_type",
        (~is_stale_now(as_of)).alias("fresh"),
        missing_fields().alias("missing"),
        F.coalesce(F.col("delta_meters") <= most_metres, F.lit(True)).alias("placed"),
        price_issues().alias("issues"),
        F.col("dup").isNull().alias("single"),
    )
    score = quality_score(F.col("fresh"), F.size("missing"), F.col("placed"), F.size("issues") == 0, F.col("single"))
    return checks.withColumn("score", score.cast("long")).withColumn("confidence", F.col("score") / 100.0)


def overview(listings: DataFrame, as_of: str, *by: str) -> DataFrame:
    """Active listings: all, without image, description, place (nulls only), and stale ones; by source if asked."""
    active = listings.where("status = 'active'")
    null = lambda c: F.col(c).isNull()
    return active.groupBy(*by).agg(
        F.count("*").alias("total"), count_of(null("image_url")).alias("missing_image"), count_of(null("description")).alias("missing_description"), count_of(no_place()).alias("missing_coordinates"), count_of(stale(as_of)).alias("stale")
    )


def expire(listings: DataFrame, as_of: str) -> DataFrame:
    """Listings with the overdue ones' status set to expired."""
    return listings.withColumn("status", F.when(F.coalesce(overdue(as_of), F.lit(False)), "expired").otherwise(F.col("status")))


def verification_status(error: Column, content: Column, coordinates: Column, skipped: Column) -> Column:
    return F.when(error, "error").when(content & coordinates, "flagged_both").when(content, "flagged_content").when(coordinates, "flagged_coordinates").when(skipped, "skipped").otherwise("verified")
