"""Feed sources by the JSON of their configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

URL = "$.feedUrl"
MOST_RULES = 10_000  # every source is compared with every rule


def seed_actions(known: DataFrame, feeds: DataFrame) -> DataFrame:
    """id, action for feeds(id, url) against known(config, sync_status): insert, reactivate a paused one, or skip."""
    have = known.select(F.get_json_object("config", URL).alias("url"), "sync_status").groupBy("url").agg(F.max(F.col("sync_status") == "paused").alias("paused"))
    action = F.when(F.col("paused").isNull(), "insert").when(F.col("paused"), "reactivate").otherwise("skip")
    return feeds.join(have, "url", "left").select("id", action.alias("action"))


def paused(sources: DataFrame, rules: DataFrame) -> DataFrame:
    """sources with those paused whose feed URL is like a pattern of rules(pattern, reason), a hand-kept list of MOST_RULES at most."""
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    url = F.get_json_object("config", URL)
    hit = sources.select("id", url.alias("url")).join(F.broadcast(rules), F.expr("url LIKE pattern")).groupBy("id").agg(F.min("reason").alias("_r"))
    rows = sources.join(hit, "id", "left")
    status, message = F.when(F.col("_r").isNotNull(), "paused").otherwise(F.col("sync_status")), F.coalesce("_r", "error_message")
    return rows.withColumn("sync_status", status).withColumn("error_message", message).select(sources.columns)
