"""Scalar functions on literal cases, nulls and boundaries."""

from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from marquee.functions import classify, dates, geo, text
from marquee.plans.testviews import AS_OF
from marquee.sources import normalize, payloads


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("a", "b", "alike"),
    [("Rosalía: Live Tour", "Rosalia Live Tour", True), ("Jazz Night", "Jazz Night with the Trio", True), ("Comedy Hour", "Poetry Hour", False), ("Blue Moon Band", "Blue Moon", True), ("x", "x", False), ("The Big Show", "A Small Fair", False)],
)
def test_similar_titles(spark, a, b, alike):
    t = lambda c: text.title_tokens(F.col(c))
    assert one(spark, text.share_identity(t("a"), t("b"), 0.55), a=a, b=b) == alike


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("DJ night!! at the  NYC hall", "DJ Night At The NYC Hall"), ("🎉🎉 party", "Party"), ("ab", None), ("ROCK show", "ROCK Show"), ("word " * 40, "Word " * 23 + "Word…"), ("o'BRIEN live", "O'brien LIVE")],
)
def test_clean_title(spark, raw, clean):
    assert one(spark, text.clean_title(F.col("t")), t=raw) == clean


@pytest.mark.parametrize(("raw", "key"), [("The Café & Bar", "cafe and bar"), ("A  Hall—An Annex", "hall annex"), ("", ""), ("Ｆｕｌｌ Width", "full width")])
def test_venue_key(spark, raw, key):
    assert one(spark, text.venue_key(F.col("t")), t=raw) == key


def test_page_text_is_whole_unless_cut(spark):
    page = "<p>" + "word " * 4000 + "</p><p>This event has been <b>cancelled</b></p>"
    assert len(one(spark, text.html_text(F.col("t")), t=page)) > 20_000 and len(one(spark, text.html_text(F.col("t"), 8000), t=page)) == 8000
    assert one(spark, text.says_cancelled(text.html_text(F.col("t"))), t=page)


def test_keys_of_null(spark):
    df = spark.createDataFrame([(None,)], "t string")
    row = df.select(text.comparison_key(F.col("t")).alias("a"), text.venue_key(F.col("t")).alias("b"), F.size(text.title_tokens(F.col("t"))).alias("c"), F.size(text.trigrams(F.col("t"))).alias("d"), text.clean_title(F.col("t")).alias("e")).first()
    assert tuple(row) == ("", "", 0, 0, None)


def test_trigrams(spark):
    assert set(one(spark, text.trigrams(F.col("t")), t="Cat, cat!")) == {"  c", " ca", "cat", "at "}


@pytest.mark.parametrize(("raw", "same"), [("Hamilton (NY)", True), ("Hamilton (Brooklyn) ", True), ("Hamilton (LA)", False)])
def test_show_key(spark, raw, same):
    assert (one(spark, text.show_key(F.col("t")), t=raw) == "hamilton") == same


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("12 Main St, Floor 2, Queens, NY", "12 Main St, Queens, NY"), ("88 Long Road Suite 5, NY", "88 Long Road, NY"), ("Hall (NYC), Room 4", "Hall"), ("", ""), ("Pier 4", "Pier 4")],
)
def test_sanitize_address(spark, raw, clean):
    assert one(spark, geo.sanitize_address(F.col("t")), t=raw) == clean


@pytest.mark.parametrize(("raw", "out"), [("1 Pier, Hoboken, NJ", True), ("5 Main St, Yonkers NY", True), ("Harrison Ave, Brooklyn, NY", False), ("9 Road, Rye", True), ("", False)])
def test_outside_city(spark, raw, out):
    assert one(spark, geo.outside_city(F.col("t")), t=raw) == out


@pytest.mark.parametrize(("raw", "generic"), [("Brooklyn, NY", True), ("NYC", True), ("12 X", False), ("Some Place 11201", False), ("Short spot", True), ("A longer spot without number", False), ("Main St", False)])
def test_generic_address(spark, raw, generic):
    assert one(spark, geo.generic_address(F.col("t")), t=raw) == generic


@pytest.mark.parametrize(
    ("start", "end", "valid", "kept"),
    [("2024-01-14 20:00:00", None, True, False), ("2024-01-14 19:59:59", None, False, False), ("1970-01-01 10:00:00", None, False, False), ("2026-01-15 20:00:00", None, True, False), ("2026-01-15 20:00:01", None, False, False), ("2024-02-01 10:00:00", "2024-02-01 10:00:00", True, False), ("2024-02-01 10:00:00", "2024-02-01 10:00:01", True, True)],
)
def test_dates(spark, start, end, valid, kept):
    row = spark.createDataFrame([(start, end)], "s string, e string").select(dates.validate(F.col("s").cast("timestamp_ntz"), F.col("e").cast("timestamp_ntz"), AS_OF).alias("v")).first().v
    assert row.is_valid == valid and (row.end_at is not None) == kept


@pytest.mark.parametrize(
    ("name", "as_of", "end"),
    [("tonight", "2024-01-15 20:00:00", "2024-01-16 09:00:00"), ("tonight", "2024-01-16 06:30:00", "2024-01-17 09:00:00"), ("this_week", "2024-01-21 12:00:00", "2024-01-29 04:59:59.999"), ("next_2_days", "2024-03-09 12:00:00", "2024-03-11 03:59:59.999")],
)
def test_timeframes(spark, name, as_of, end):
    got = spark.range(1).select(dates.timeframe_end(name, as_of, "America/New_York").alias("x")).first().x
    assert got == datetime.fromisoformat(end)


def test_categories(spark):
    assert one(spark, classify.from_keywords(F.col("t"), F.lit(None)), t="Stand-up at the opera") == "comedy"
    assert one(spark, classify.from_keywords(F.col("t"), F.lit(None)), t="laughter") is None
    assert one(spark, classify.from_taxonomy(F.col("t"), F.lit("Comedy")), t="Miscellaneous") == "other"
    assert one(spark, classify.classify(F.lit(None).cast("string"), F.col("t"), F.lit(None).cast("string"), default="music"), t="nothing") == "music"


@pytest.mark.parametrize(
    ("rule", "start", "n"),
    [("FREQ=DAILY;COUNT=3", "2024-01-16 10:00:00", 3), ("FREQ=WEEKLY;BYDAY=MO,WE;COUNT=4", "2024-01-15 21:00:00", 4), ("FREQ=WEEKLY;INTERVAL=2;UNTIL=20240301", "2024-01-16 10:00:00", 4), ("FREQ=MONTHLY", "2024-01-31 10:00:00", 1), ("FREQ=MONTHLY", "2023-12-20 10:00:00", 2), ("FREQ=MONTHLY;BYDAY=2TU", "2024-01-16 10:00:00", None), ("FREQ=YEARLY", "2024-01-16 10:00:00", None)],
)
def test_recurrence(spark, rule, start, n):
    got = spark.createDataFrame([(start, rule)], "s string, r string").select(normalize.recurrences(F.col("s").cast("timestamp_ntz"), F.col("r"), AS_OF).alias("x")).first().x
    assert (None if got is None else len(got)) == n


def test_calendar(spark):
    body = "BEGIN:VCALENDAR\nBEGIN:VEVENT\nUID:a\nSUMMARY:Late\\, long\n  show\nDTSTART;TZID=X:20240120T200000\nDTEND:20240120T230000\nRRULE:FREQ=WEEKLY;COUNT=3\nEXDATE:20240127T200000\nLOCATION:The Hall, 1 Main St\nATTACH;FMTTYPE=image/png:https://x/y\nEND:VEVENT\nBEGIN:VEVENT\nUID:b\nSUMMARY:Odd\nDTSTART:20240120T200000\nRRULE:FREQ=YEARLY\nEND:VEVENT\nEND:VCALENDAR"
    rows, rejects = normalize.calendars(spark.createDataFrame([(None, body), ("F", "<html>")], "feed_title string, text string"), AS_OF, "Venue")
    got = sorted(rows.collect(), key=lambda r: r.start_at)
    assert [r.external_id for r in got] == ["a_2024-01-20T20:00:00.000Z", "a_2024-02-03T20:00:00.000Z"]
    assert got[0].title == "Late, Long Show" and got[0].venue_name == "The Hall" and got[0].image_url == "https://x/y" and got[0].end_at.hour == 23 and got[0].platform == "Venue"
    assert [r.uid for r in rejects.collect()] == ["b"]


def test_json_ld_and_state(spark):
    page = '<meta name="description" content="A long enough description &amp; more of it"><script type="application/ld+json">{"@type":"Event","offers":[{"price":"20"},{"price":"x"},{"price":"12.5"}]}</script><script type="application/ld+json">{oops</script><script>window.__SERVER_DATA__ = {"a":1};</script>'
    row = spark.createDataFrame([(page,)], "h string").select(payloads.json_ld_events(F.col("h")).alias("e"), payloads.meta_description(F.col("h")).alias("d"), payloads.server_state(F.col("h")).alias("s"), payloads.lowest_offer(F.get(payloads.json_ld_events(F.col("h")), F.lit(0))["offers"]).alias("p")).first()
    assert len(row.e) == 1 and row.d == "A long enough description & more of it" and row.s == '{"a":1}' and row.p == 12.5


def test_concert_parts(spark):
    assert one(spark, normalize.concert_id(F.col("t")), t="/x/id/77-y") == "77" and one(spark, normalize.concert_id(F.col("t")), t="/concerts/12-a/99") == "12"
    assert one(spark, normalize.support_acts(F.col("t")), t="The One, and Two & Three and Four") == ["The One", "Two", "Three", "Four"]


def test_permit_address(spark):
    assert one(spark, normalize.permit_address(F.col("t"), F.lit("Queens")), t="BEACH 86 STREET between ROCKAWAY BEACH BLVD and SHORE FRONT, OTHER STREET between A and B") == "Beach 86 Street & Rockaway Beach Blvd, Queens, NY"
