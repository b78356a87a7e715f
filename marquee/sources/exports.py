"""Exports: logs as JSON with a summary, listings as map features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def geojson_features(listings: DataFrame) -> DataFrame:
    """id, feature: a GeoJSON point of each listing with a place; longitude first."""
    rows = listings.where("lat is not null and lng is not null")
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates"))
    properties = F.struct("id", "title", "category", "venue_name", "start_at")
    return rows.select("id", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("feature"))


def export_logs(logs: DataFrame, path: str, as_of: str, chosen: str = "all") -> None:
    """logs(status, ...) of a status (or all) as JSON lines under path/rows, with a one-row envelope under path/summary."""
    rows = logs if chosen == "all" else logs.where(F.col("status") == chosen)
    rows.write.mode("overwrite").json(f"{path}/rows")
    summary(rows, as_of, chosen).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def summary(rows: DataFrame, as_of: str, chosen: str = "all") -> DataFrame:
    """The envelope of an export: when, which status, how many rows, and how many of each status."""
    stats = rows.groupBy("status").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("status", "n"))).alias("stats"), F.coalesce(F.sum("n"), F.lit(0)).alias("count"))
    return stats.select(F.lit(as_of).alias("exported_at"), F.lit(chosen).alias("filter"), "count", "stats")
