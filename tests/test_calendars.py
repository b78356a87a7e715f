"""Calendar instances: zones across a clock change, lists of excluded dates, overrides, content types."""

from datetime import datetime as T

from marquee.sources import calendars, normalize

AS_OF = "2024-03-01 00:00:00"


def block(*lines):
    return "BEGIN:VEVENT\n" + "\n".join(lines) + "\nEND:VEVENT\n"


def run(spark, *blocks, head="BEGIN:VCALENDAR\nX-WR-CALNAME:Rooms\n", kind=None, as_of=AS_OF):
    texts = spark.createDataFrame([(None, head + "".join(blocks), kind)], "feed_title string, text string, content_type string")
    rows, rejects = calendars.instances(calendars.events_of(texts), as_of)
    return sorted((r.uid, r["at"], r.recurring) for r in rows.collect()), [tuple(r) for r in rejects.collect()]


def starts(spark, *blocks, **more):
    return [x[1] for x in run(spark, *blocks, **more)[0]]


WEEKLY = ("UID:w", "DTSTART;TZID=America/New_York:20240301T200000", "DTEND;TZID=America/New_York:20240301T220000", "RRULE:FREQ=WEEKLY;COUNT=4")


def test_a_series_keeps_its_hour_across_the_clock_change(spark):
    assert starts(spark, block(*WEEKLY)) == [T(2024, 3, 2, 1), T(2024, 3, 9, 1), T(2024, 3, 16, 0), T(2024, 3, 23, 0)]


def test_zones_by_name_alias_quotes_and_unknown(spark):
    for line, hour in (("DTSTART;TZID=Europe/Paris:20240305T200000", 19), ('DTSTART;TZID="Pacific Standard Time":20240305T100000', 18), ("DTSTART;TZID=Nowhere/Land:20240305T200000", 20), ("DTSTART:20240305T200000", 20), ("DTSTART:20240305T200000Z", 20)):
        assert run(spark, block("UID:a", line))[0] == [("a", T(2024, 3, 5, hour), False)]


def test_lists_of_excluded_dates_in_zones_repeated_and_whole_days(spark):
    dates = ("EXDATE;TZID=America/New_York:20240308T200000,20240322T200000",)
    assert starts(spark, block(*WEEKLY, *dates)) == [T(2024, 3, 2, 1), T(2024, 3, 16, 0)]
    assert starts(spark, block(*WEEKLY, "EXDATE:20240302T010000Z", "EXDATE;VALUE=DATE:20240315")) == [T(2024, 3, 9, 1), T(2024, 3, 23, 0)]
    assert starts(spark, block(*WEEKLY, "EXDATE:bad,,20240309T010000Z")) == [T(2024, 3, 2, 1), T(2024, 3, 16, 0), T(2024, 3, 23, 0)]


def test_overrides_move_cancel_and_add(spark):
    moved = block("UID:w", "RECURRENCE-ID;TZID=America/New_York:20240308T200000", "DTSTART;TZID=America/New_York:20240309T150000", "DTEND;TZID=America/New_York:20240309T160000")
    gone = block("UID:w", "RECURRENCE-ID:20240316T000000Z", "DTSTART:20240316T000000Z", "STATUS:CANCELLED")
    extra = block("UID:w", "RECURRENCE-ID:20240401T000000Z", "DTSTART:20240402T000000Z")
    assert starts(spark, block(*WEEKLY), moved, gone, extra) == [T(2024, 3, 2, 1), T(2024, 3, 9, 20), T(2024, 3, 23, 0), T(2024, 4, 2)]
    texts = spark.createDataFrame([("F", "BEGIN:VCALENDAR\n" + block(*WEEKLY) + moved)], "feed_title string, text string")
    rows, _ = normalize.calendars(texts, AS_OF, "Hall")
    got = {r.external_id: (r.start_at, r.end_at) for r in rows.collect()}
    assert got["w_2024-03-09T20:00:00.000Z"] == (T(2024, 3, 9, 20), T(2024, 3, 9, 21))
    assert got["w_2024-03-16T00:00:00.000Z"] == (T(2024, 3, 16), T(2024, 3, 16, 2)) and len(got) == 4


def test_edits_of_an_override_excluded_overrides_and_windows(spark):
    edit = lambda n, to: block("UID:w", "RECURRENCE-ID:20240309T010000Z", f"DTSTART:{to}", f"SEQUENCE:{n}")
    assert starts(spark, block(*WEEKLY), edit(1, "20240310T010000Z"), edit(2, "20240311T010000Z"))[1] == T(2024, 3, 11, 1)
    assert len(starts(spark, block(*WEEKLY, "EXDATE:20240309T010000Z"), edit(1, "20240310T010000Z"))) == 3
    assert starts(spark, block(*WEEKLY), edit(1, "20250101T000000Z")) == [T(2024, 3, 2, 1), T(2024, 3, 16), T(2024, 3, 23)]
    assert starts(spark, block(*WEEKLY), edit(1, "20240501T000000Z"), as_of="2024-03-20 00:00:00") == [T(2024, 3, 23), T(2024, 5, 1)]


def test_overrides_without_their_event_and_until_in_utc(spark):
    lone = [block("UID:x", f"RECURRENCE-ID:2024030{d}T010000Z", f"DTSTART:2024030{d}T050000Z") for d in (6, 4)]
    assert run(spark, *lone)[0] == [("x", T(2024, 3, 4, 5), False)]
    daily = ("UID:d", "DTSTART;TZID=America/New_York:20240304T220000", "RRULE:FREQ=DAILY;UNTIL=20240306T030000Z")
    assert starts(spark, block(*daily)) == [T(2024, 3, 5, 3), T(2024, 3, 6, 3)]


def test_rejects_content_types_repeated_feeds_and_empty(spark):
    odd = block("UID:o", "DTSTART:20240305T200000Z", "RRULE:FREQ=MONTHLY;BYDAY=2TU")
    assert run(spark, odd) == ([], [("o", "FREQ=MONTHLY;BYDAY=2TU")])
    one = block("UID:a", "DTSTART:20240305T200000Z")
    assert run(spark, one, head="", kind=None)[0] == []
    assert len(run(spark, one, head="junk\n", kind="text/calendar; charset=utf-8")[0]) == 1
    assert run(spark, one, head="<html>", kind="text/html")[0] == []
    assert len(run(spark, one, one)[0]) == 1
    empty = spark.createDataFrame([], "feed_title string, text string")
    assert calendars.instances(calendars.events_of(empty), AS_OF)[0].collect() == []
    texts = spark.createDataFrame([(None, "BEGIN:VCALENDAR\nX-WR-CALNAME:Rooms\n" + one)], "feed_title string, text string")
    assert [r.platform for r in normalize.calendars(texts, AS_OF, "Hall")[0].collect()] == ["Rooms"]


def test_texts_are_parsed_and_rules_run_once(spark):
    """What the joins read is written: no property is looked for, and no rule run, in the plan behind it."""
    texts = spark.createDataFrame([("F", "BEGIN:VCALENDAR\n" + block(*WEEKLY))], "feed_title string, text string")
    rows, rejects = calendars.instances(calendars.events_of(texts), AS_OF)
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (rows, rejects)]
    assert len(rows.collect()) == 4 and not any(name in plan for plan in plans for name in ("EXDATE", "DTSTART", "VEVENT", "UNTIL", "BYDAY"))
