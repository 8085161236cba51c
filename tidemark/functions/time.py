"""Clock functions. Times are naive UTC (timestamp_ntz); zones are IANA names, never fixed offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local(ts: Column, zone: str) -> Column:
    """Wall clock in a zone of a UTC time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def to_utc(ts: Column, zone: str) -> Column:
    """UTC of a wall clock in a zone."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def in_session(ts: Column, start: int, end: int, zone: str = "UTC") -> Column:
    """Minute of the local day in [start, end); an end before the start wraps midnight, equal ends mean all day."""
    minute = minute_of_day(local(ts, zone))
    if start == end:
        return F.lit(True)
    inside = (minute >= start) & (minute < end)
    return inside if start < end else (minute >= start) | (minute < end)


#: Named sessions in UTC hours.
SESSIONS = {"asia": (0, 8), "london": (7, 16), "ny_overlap": (12, 17), "london_ny": (7, 21), "ny": (13, 21)}


def named_session(ts: Column, name: str) -> Column:
    start, end = SESSIONS[name]
    return in_session(ts, start * 60, end * 60)


def past_deadline(ts: Column, hour: int, minute: int = 0, zone: str = "America/New_York", friday_hour: int | None = None) -> Column:
    """The local clock is at or past the day's flat time; Fridays may have an earlier one."""
    here = local(ts, zone)
    limit = F.lit(hour * 60 + minute)
    if friday_hour is not None:
        limit = F.when(F.dayofweek(here) == 6, friday_hour * 60).otherwise(limit)
    return minute_of_day(here) >= limit


def deadline_between(before: Column, after: Column, hour: int, minute: int = 0, zone: str = "America/New_York", friday_hour: int | None = None) -> Column:
    """A day's flat time, by the local clock, lies strictly between two UTC times; for the few days of one gap between bars."""
    here, there = local(before, zone), local(after, zone)
    limit = F.make_dt_interval(F.lit(0), F.lit(hour), F.lit(minute))
    if friday_hour is not None:
        friday = F.make_dt_interval(F.lit(0), F.lit(friday_hour))
    at = lambda day: day.cast("timestamp_ntz") + (limit if friday_hour is None else F.when(F.dayofweek(day) == 6, friday).otherwise(limit))
    return F.exists(F.sequence(F.to_date(here), F.to_date(there)), lambda day: (at(day) > here) & (at(day) < there))


def server_day(ts: Column, offset_minutes: int) -> Column:
    return F.to_date(ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(offset_minutes)))


def server_offset(server: Column, utc: Column) -> Column:
    """Difference of two clocks in minutes, rounded to quarters of an hour."""
    seconds = F.unix_timestamp(server.cast("timestamp")) - F.unix_timestamp(utc.cast("timestamp"))
    return (F.round(seconds / 900) * 15).cast("int")


def in_weekend(ts: Column, hour: int = 21) -> Column:
    """From Friday at the hour until Sunday at the hour, UTC."""
    day, h = F.dayofweek(ts), F.hour(ts)
    return (day == 7) | ((day == 6) & (h >= hour)) | ((day == 1) & (h < hour))


def calendar_time(date: Column, clock: Column, zone: str = "America/New_York") -> Column:
    """UTC of `MM-dd-yyyy` and `8:30am`; null for untimed entries."""
    return to_utc(F.try_to_timestamp(F.concat(date, F.lit(" "), F.upper(clock)), F.lit("MM-dd-yyyy h:mma")).cast("timestamp_ntz"), zone)
