"""Instances of calendar events: recurrence in the event's own zone, excluded dates, overrides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..operators.graph import checkpointed
from .payloads import calendar_events, calendar_field

#: Zone names that some calendars write, and what they stand for.
ALIASES = {"Eastern Standard Time": "America/New_York", "Central Standard Time": "America/Chicago", "Mountain Standard Time": "America/Denver", "Pacific Standard Time": "America/Los_Angeles"}
#: Content types that are taken for a calendar whatever the text starts with.
CALENDAR_TYPES = r"text/calendar|application/ics|application/octet-stream"
STAMP = "struct<wall:timestamp_ntz,zone:string,all_day:boolean>"
DAYS = 60


def blank_null(x: Column) -> Column:
    return F.when(x != "", x)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once for each row, however often f names it, also within lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def known_zones() -> list[str]:
    """Zone names that Spark converts by."""
    return sorted(str(z) for z in SparkSession.active()._jvm.java.time.ZoneId.getAvailableZoneIds().toArray())


def in_utc(wall: Column, zone: Column) -> Column:
    return F.to_utc_timestamp(wall.cast("timestamp"), zone).cast("timestamp_ntz")


def utc_of(stamp: Column) -> Column:
    return in_utc(stamp["wall"], stamp["zone"])


def _zone(params: Column, zones: list[str]) -> Column:
    """Of a property's parameters; UTC where they name none that is known (a floating time counts as UTC)."""
    named = F.regexp_extract(params, r';TZID="?/?([^";:]+)"?', 1)
    alias = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    named = F.coalesce(F.try_element_at(alias, named), named)
    return F.when(named.isin(zones), named).otherwise("UTC")


def _stamp(value: Column, params: Column, zones: list[str]) -> Column:
    def read(x: Column) -> Column:
        value, params = x["value"], x["params"]
        wall = F.coalesce(F.try_to_timestamp(F.regexp_replace(value, "Z$", ""), F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(value, F.lit("yyyyMMdd"))).cast("timestamp_ntz")
        zone = F.when(value.endswith("Z"), "UTC").otherwise(_zone(params, zones))
        return bound(wall, lambda w: F.when(w.isNotNull(), F.struct(w.alias("wall"), zone.alias("zone"), (F.length(value) == 8).alias("all_day"))).cast(STAMP))

    # An absent property isn't tried: a text that doesn't parse costs far more than one that does.
    return bound(F.struct(value.alias("value"), params.alias("params")), lambda x: F.when(x["value"] != "", read(x)))


def stamp(block: Column, name: str, zones: list[str]) -> Column:
    """A DATE or DATE-TIME property as wall time, zone, and whether it is a date; null if it is absent or can't be read."""
    line = rf"{name}((?:;[^:\r\n]*)?):([^\r\n]*)"
    found = F.regexp_extract(block, rf"(?m)^{line}", 0)
    return bound(found, lambda x: _stamp(F.trim(F.regexp_extract(x, line, 2)), F.regexp_extract(x, line, 1), zones))


def stamps(block: Column, name: str, zones: list[str]) -> Column:
    """All values of a property that may be repeated and hold lists."""
    lines = F.regexp_extract_all(block, F.lit(rf"(?m)^{name}(?:;[^:\r\n]*)?:[^\r\n]*"), F.lit(0))
    one = lambda line: F.transform(F.split(F.regexp_extract(line, ":([^:]*)$", 1), ","), lambda v: _stamp(F.trim(v), F.regexp_extract(line, r"^[A-Z-]+((?:;[^:]*)?):", 1), zones))
    return F.filter(F.flatten(F.transform(lines, one)), lambda x: x.isNotNull())


def occurrences(start: Column, rule: Column, last: Column, zone: Column | None = None) -> Column:
    """N14. Wall times from start up to last of DAILY, WEEKLY (with BYDAY) and MONTHLY rules with INTERVAL, COUNT and UNTIL.

    Null where the rule has anything else, or an interval below 1. An UNTIL with a Z is compared in UTC.
    """
    part = lambda n: blank_null(F.regexp_extract(rule, rf"(?:^|;){n}=([^;]+)", 1))
    asked, until, byday = part("INTERVAL").try_cast("int"), part("UNTIL"), part("BYDAY")
    ends = F.coalesce(F.try_to_timestamp(F.regexp_replace(until, "Z$", ""), F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(until, F.lit("yyyyMMdd"))).cast("timestamp_ntz")
    plain = (part("INTERVAL").isNull() | F.coalesce(asked >= 1, F.lit(False))) & ~rule.rlike("BYSETPOS|BYMONTHDAY|BYYEARDAY|BYWEEKNO|BYHOUR|BYMONTH|BYDAY=[^;]*[0-9]") & (byday.isNull() | (part("FREQ") == "WEEKLY"))
    parts = F.struct(
        start.alias("start"), last.alias("last"), (F.lit(None).cast("string") if zone is None else zone).alias("zone"), plain.alias("plain"), part("FREQ").alias("freq"), F.greatest(F.coalesce(asked, F.lit(1)), F.lit(1)).alias("every"),
        part("COUNT").try_cast("int").alias("count"), byday.alias("byday"), ends.alias("until"), until.endswith("Z").alias("in_utc"), F.greatest(F.datediff(last, start), F.lit(0)).alias("span"),
    )
    return bound(parts, lambda p: _walls(p, zone is not None))


def _walls(p: Column, zoned: bool) -> Column:
    """The wall times of a rule's parts, each a field of p."""
    start, every, span = p["start"], p["every"], p["span"]
    step = lambda n: F.make_dt_interval(n.cast("int"), F.lit(0), F.lit(0), F.lit(0).cast("decimal(18,6)"))
    daily = F.transform(F.sequence(F.lit(0), (span / every).cast("int")), lambda i: start + step(i * every))
    own_day = F.get(F.array(*map(F.lit, ("SU", "MO", "TU", "WE", "TH", "FR", "SA"))), F.dayofweek(start) - 1)
    number = lambda d: F.array_position(F.array(*map(F.lit, ("MO", "TU", "WE", "TH", "FR", "SA", "SU"))), d) - 1
    # Days from the start to each weekday that is named, in the start's week.
    offsets = F.transform(F.coalesce(F.split(p["byday"], ","), F.array(own_day)), lambda d: number(d) - F.weekday(start))
    weeks = F.sequence(F.lit(0), (span / (every * 7)).cast("int") + 1)
    weekly = bound(offsets, lambda o: F.filter(F.array_sort(F.flatten(F.transform(weeks, lambda w: F.transform(o, lambda d: start + step(w * every * 7 + d))))), lambda t: t >= start))
    clock = start - F.date_trunc("day", start).cast("timestamp_ntz")
    months = F.filter(F.transform(F.sequence(F.lit(0), (span / (every * 28)).cast("int") + 1), lambda m: F.add_months(start.cast("date"), m * every).cast("timestamp_ntz") + clock), lambda t: F.dayofmonth(t) == F.dayofmonth(start))
    all_ = F.when(p["plain"] & (p["freq"] == "DAILY"), daily).when(p["plain"] & (p["freq"] == "WEEKLY"), weekly).when(p["plain"] & (p["freq"] == "MONTHLY"), months)
    some = bound(all_, lambda a: F.when(p["count"].isNotNull(), F.slice(a, 1, F.greatest(p["count"], F.lit(1)))).otherwise(a))
    told = lambda t: F.when(p["in_utc"], in_utc(t, p["zone"])).otherwise(t) if zoned else t
    return F.filter(some, lambda t: (t <= p["last"]) & (p["until"].isNull() | (told(t) <= p["until"])))


def recurrences(start: Column, rule: Column, as_of: str, days: int = DAYS) -> Column:
    """occurrences of a start in UTC within [now, now + days]."""
    now = dates.at(as_of)
    return F.filter(occurrences(start, rule, now + dates.hours(24 * days)), lambda t: t >= now)


def events_of(texts: DataFrame) -> DataFrame:
    """feed, feed_title, b (the VEVENT block) and its parsed properties, for texts(feed_title, text) with content_type or without.

    A text counts as a calendar by its first line, or by its content type. Blocks without UID or start are left out.
    """
    zones = known_zones()
    typed = F.col("content_type").rlike(CALENDAR_TYPES) if "content_type" in texts.columns else F.lit(False)
    title = F.coalesce("feed_title", calendar_field(F.col("text"), "X-WR-CALNAME"))
    b = texts.select(F.xxhash64("feed_title", "text").alias("feed"), title.alias("feed_title"), F.explode_outer(calendar_events(F.col("text"), typed)).alias("b"))
    field = lambda n: calendar_field(F.col("b"), n)
    at = lambda n: stamp(F.col("b"), n, zones)
    parsed = F.struct(
        field("UID").alias("uid"), field("RRULE").alias("rule"), at("DTSTART").alias("s"), at("DTEND").alias("t"), at("RECURRENCE-ID").alias("replaced"), stamps(F.col("b"), "EXDATE", zones).alias("gone"),
        F.coalesce(field("SEQUENCE").try_cast("int"), F.lit(0)).alias("sequence"), (F.upper(F.trim(F.coalesce(field("STATUS"), F.lit("")))) == "CANCELLED").alias("cancelled"),
    )
    # As a row's one entry, and by outer explodes, so that no filter works it out again.
    return b.select("feed", "feed_title", "b", F.inline_outer(F.array(parsed))).where("s is not null and uid is not null").withColumn("lasts", utc_of(F.col("t")) - utc_of(F.col("s")))


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key's rows the one of greatest SEQUENCE, then the latest start, then the greatest block."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct("sequence", "s", "b", *(c for c in rest if c not in ("sequence", "s", "b")))).alias("x")).select(*keys, *(f"x.{c}" for c in rest))


def instances(events: DataFrame, as_of: str, days: int = DAYS) -> tuple[DataFrame, DataFrame]:
    """(instances, rejects(uid, rule)) of events_of rows: feed, uid, at, ends (UTC), recurring, and the event's feed_title and b.

    Rules run on the wall clock of the event's zone, so a show stays at its hour across a clock change. Instances meet
    overrides (blocks with RECURRENCE-ID) in one join on feed, uid and the instant that is replaced: a moved one comes at
    its new time, a cancelled one not at all, and one that the rule doesn't have is added. Excluded dates take out instants,
    or whole days where they are dates, overridden or not. Only recurring instances are cut to [now, now + days]. Overrides
    without their event count as single events, the earliest for each uid. Of equal keys the latest edit counts.
    """
    now, last = dates.at(as_of), dates.at(as_of) + dates.hours(24 * days)
    # Written once, as is what rules come to: texts are parsed and rules run a single time, not for each of the joins below.
    events = checkpointed(events)
    walls = F.when(F.col("rule").isNotNull(), occurrences(F.col("s.wall"), F.col("rule"), last + dates.hours(24), F.col("s.zone")))
    masters = checkpointed(_latest(events.where("replaced is null"), ["feed", "uid"]).withColumn("walls", walls))
    ruled = masters.where("rule is not null")
    rejects = ruled.where("walls is null").select("uid", "rule")
    own = ruled.where("walls is not null").select("feed", "uid", F.explode_outer(F.transform("walls", lambda t: in_utc(t, F.col("s.zone")))).alias("was"))
    # Outside of the time asked for, an instance only counts if it is replaced; then the override brings it in.
    own = own.where(F.col("was").between(now, last))
    edits = _latest(events.where("replaced is not null").withColumn("was", utc_of(F.col("replaced"))), ["feed", "uid", "was"])
    moved = edits.select("feed", "uid", "was", utc_of(F.col("s")).alias("to"), F.col("lasts").alias("new_lasts"), "cancelled")
    both = own.join(moved, ["feed", "uid", "was"], "full").join(ruled.where("walls is not null").select("feed", "uid", "feed_title", "b", "lasts", "gone", F.col("s.zone").alias("zone")), ["feed", "uid"])
    day = F.to_date(F.from_utc_timestamp(F.col("was").cast("timestamp"), F.col("zone")))
    excluded = F.exists("gone", lambda g: F.when(g["all_day"], F.to_date(g["wall"]) == day).otherwise(utc_of(g) == F.col("was")))
    at = F.coalesce("to", "was")
    kept = both.where(~excluded & ~F.coalesce("cancelled", F.lit(False)) & (at >= now) & (at <= last))
    cols = ["feed", "uid", "feed_title", "b"]
    recurring = kept.select(*cols, at.alias("at"), (at + F.coalesce("new_lasts", "lasts")).alias("ends"), F.lit(True).alias("recurring"))
    alone = _latest(edits.join(masters.select("feed", "uid"), ["feed", "uid"], "left_anti").withColumn("sequence", -F.unix_micros(F.col("was").cast("timestamp"))), ["feed", "uid"])
    single = masters.where("rule is null").select(*cols, "s", "lasts").unionByName(alone.select(*cols, "s", "lasts"))
    return recurring.unionByName(single.select(*cols, utc_of(F.col("s")).alias("at"), (utc_of(F.col("s")) + F.col("lasts")).alias("ends"), F.lit(False).alias("recurring"))), rejects
