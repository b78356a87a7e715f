"""Found images and descriptions, and checks of what listings show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORTEST = 10  # characters of a description worth keeping


def image_verdict(url: Column, trusted: list[str]) -> Column:
    """empty, malformed, trusted (by host) or fetch."""
    host = F.try_parse_url(url, F.lit("HOST"))
    ok = url.rlike("^https?://") & host.isNotNull()
    return F.when(F.coalesce(url, F.lit("")) == "", "empty").when(~ok, "malformed").when(host.isin(*trusted), "trusted").otherwise("fetch")


def title_is_venue(title: Column, venue: Column) -> Column:
    return F.contains(F.lower(F.trim(title)), F.lower(F.trim(venue)))


def apply_found(listings: DataFrame, found: DataFrame, broken: DataFrame) -> DataFrame:
    """found(id, image_url, description, confidence) fills what is null; images of broken(id) become null."""
    f = found.select("id", F.col("image_url").alias("_i"), F.col("description").alias("_d"), F.col("confidence").alias("_c"))
    rows = listings.join(f, "id", "left").join(broken.select("id").withColumn("_b", F.lit(True)), "id", "left")
    usable = F.when((F.col("_c") != "low") & (F.length("_d") >= SHORTEST), F.col("_d"))
    image = F.when(F.col("image_url").isNull(), F.col("_i")).when(F.col("_b").isNull(), F.col("image_url"))
    return rows.withColumn("image_url", image).withColumn("description", F.coalesce("description", usable)).select(listings.columns)
