"""Verification of listings from saved pages and external verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_text, says_cancelled
from .audit import verification_status


def verify_pages(listings: DataFrame, pages: DataFrame, verdicts: DataFrame, deltas: DataFrame, blocked: list[str], most_metres: float = 500) -> DataFrame:
    """event_id, status, expire, reason.

    listings(event_id, ticket_url, status); pages(event_id, http_status, html); verdicts(event_id, confirmed, reason);
    deltas(event_id, delta in metres). Blocked domains and pages without a verdict are skipped; a 404 is skipped and
    expires the listing; a page that says cancelled anywhere in its text is not confirmed and expires it.
    """
    rows = listings.join(pages, "event_id").join(verdicts, "event_id", "left").join(deltas, "event_id", "left")
    off = F.exists(F.array(*map(F.lit, blocked)), lambda d: F.contains(F.lower("ticket_url"), d))
    gone = F.col("http_status") == 404
    cancelled = ~off & ~gone & says_cancelled(html_text(F.col("html")))
    skipped = off | gone | (~cancelled & F.col("confirmed").isNull())
    flagged = cancelled | (~skipped & ~F.coalesce("confirmed", F.lit(True)))
    far = F.coalesce(F.col("delta") > most_metres, F.lit(False))
    why = F.concat_ws(" | ", F.when(gone, "page not found").when(off, "blocked domain").when(cancelled, "page says cancelled").otherwise(F.col("reason")), F.when(far, F.concat(F.round("delta").cast("long"), F.lit(" m off"))))
    failed = F.coalesce(F.col("http_status") >= 500, F.lit(False))
    return rows.select("event_id", verification_status(failed, flagged, far, skipped).alias("status"), (gone | cancelled).alias("expire"), why.alias("reason"))
