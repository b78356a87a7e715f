"""Dates of listings against a given time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DEFAULT_HOURS, HOURS


def at(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def hours(n: float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n * 3600).cast("decimal(18,6)"))


def validate(start: Column, end: Column, as_of: str) -> Column:
    """struct(is_valid, end_at, reason): no start, an epoch start, one too old or too far off; a bad end becomes null."""
    now = at(as_of)
    far = F.add_months(F.to_date(now), 24).cast("timestamp_ntz") + (now - F.date_trunc("day", now).cast("timestamp_ntz"))
    reason = F.when(start.isNull(), "unparseable").when(start < at("1970-01-02 00:00:00"), "epoch").when(start < now - hours(24), "past").when(start > far, "future")
    return F.struct(reason.isNull().alias("is_valid"), F.when(reason.isNull() & (end > start), end).alias("end_at"), reason.alias("reason"))


def usual_hours(category: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in HOURS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.coalesce(category, F.lit("other"))), F.lit(DEFAULT_HOURS))


def estimated_end(start: Column, category: Column) -> Column:
    return start + F.make_dt_interval(F.lit(0), F.lit(0), (usual_hours(category) * 60).cast("int"), F.lit(0).cast("decimal(18,6)"))


def live(as_of: str) -> Column:
    """Active and not over; one without an end lasts four hours."""
    now = at(as_of)
    return (F.col("status") == "active") & ((F.col("end_at") > now) | (F.col("end_at").isNull() & (F.col("start_at") > now - hours(4))))


def overdue(as_of: str) -> Column:
    """Active and to be expired; one without an end after six hours."""
    now = at(as_of)
    return (F.col("status") == "active") & ((F.col("end_at") < now) | (F.col("end_at").isNull() & (F.col("start_at") < now - hours(6))))


def stale(as_of: str) -> Column:
    now = at(as_of)
    return (F.col("status") == "active") & (F.col("start_at") < now) & (F.col("end_at").isNull() | (F.col("end_at") < now))


def to_wall(ts: Column, zone: str) -> Column:
    """UTC to the city's clock, both without zone."""
    return F.from_utc_timestamp(ts.cast("timestamp"), zone).cast("timestamp_ntz")


def from_wall(ts: Column, zone: str) -> Column:
    return F.to_utc_timestamp(ts.cast("timestamp"), zone).cast("timestamp_ntz")


def timeframe_end(name: str, as_of: str, zone: str) -> Column:
    """UTC end of tonight (04:00 of the next day), next_2_days or this_week, on the city's clock."""
    day = F.to_date(to_wall(at(as_of), zone))
    late = hours(24) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0.001).cast("decimal(18,6)"))
    if name == "next_2_days":
        wall = F.date_add(day, 1).cast("timestamp_ntz") + late
    elif name == "this_week":
        wall = F.date_add(day, 8 - F.dayofweek(day)).cast("timestamp_ntz") + late  # a Sunday's week ends next Sunday
    else:
        wall = F.date_add(day, 1).cast("timestamp_ntz") + hours(4)
    return from_wall(wall, zone)


def on_clock(day: Column, clock: Column) -> Column:
    """Date text and HH:MM; null if either can't be read."""
    return F.try_to_timestamp(F.concat_ws(" ", day, clock), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")
