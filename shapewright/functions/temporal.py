"""Dates held as integers, differences by crossed boundaries, text styles."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from shapewright.functions.text import zero_pad


def moment(as_of: datetime | str | None) -> Column:
    """The reference time of a report: a given one, or now."""
    if as_of is None:
        return F.current_timestamp()
    text = as_of if isinstance(as_of, str) else as_of.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


def day_number(as_of: date | datetime | str, plus_days: int = 0) -> int:
    """yyyymmdd of the day as an integer."""
    day = datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    return int((day + timedelta(days=plus_days)).strftime("%Y%m%d"))


def shift(ts: Column, unit: str, amount: int) -> Column:
    """DATEADD for units from MICROSECOND to YEAR, written as an interval."""
    if unit.upper() == "MILLISECOND":
        unit, amount = "MICROSECOND", amount * 1000
    return F.timestamp_add(unit.upper(), F.lit(amount), ts)


def _since(ts: Column, start: str) -> Column:
    """Interval from a start to the time as the wall clock shows it, whatever the session's zone."""
    return ts.cast("timestamp_ntz") - F.lit(start).cast("timestamp_ntz")


def utc_instant(ts: Column) -> Column:
    """A time without zone read as UTC; the type that watermarks need."""
    seconds = _since(ts, "1970-01-01").cast("interval second").cast("decimal(18,6)")
    return F.timestamp_micros((seconds * 1_000_000).cast("long"))


def utc_wall_time(ts: Column) -> Column:
    """The reverse of utc_instant."""
    seconds = (F.unix_micros(ts).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def seconds_between(start: Column, end: Column) -> Column:
    """DATEDIFF(second): second boundaries crossed, so 0.9 s to 1.1 s counts 1."""
    second = lambda ts: _since(ts, "0001-01-01").cast("interval second").cast("long")
    return second(end) - second(start)


def millis_between(start: Column, end: Column) -> Column:
    """DATEDIFF(millisecond), for times from 1900 on."""
    milli = lambda ts: (_since(ts, "1900-01-01") * 1000).cast("interval second").cast("long")
    return milli(end) - milli(start)


def date_to_int(ts: Column) -> Column:
    """Style 112: yyyymmdd, as an integer."""
    return F.date_format(ts, "yyyyMMdd").cast("int")


def time_to_int(ts: Column) -> Column:
    """hhmmss as an integer."""
    return F.date_format(ts, "HHmmss").cast("int")


def decode_datetime(day: Column, time: Column) -> Column:
    """yyyymmdd and hhmmss integers to one timestamp without zone; NULL if they are no date."""
    text = F.concat(zero_pad(day, 8), zero_pad(time, 6))
    return F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def duration_text(duration: Column) -> Column:
    """hhmmss integer to hh:mm:ss; hours above 99 keep all their digits."""
    text = duration.cast("string")
    padded = F.when(F.length(text) > 6, text).otherwise(zero_pad(text, 6))
    size = F.length(padded)
    return F.concat(
        F.substring(padded, F.lit(1), size - 4),
        F.lit(":"),
        F.substring(padded, size - 3, F.lit(2)),
        F.lit(":"),
        F.substring(padded, size - 1, F.lit(2)),
    )


def canonical_text(ts: Column, millis: bool = False) -> Column:
    """Style 20 (seconds) or 121 (milliseconds)."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS" if millis else "yyyy-MM-dd HH:mm:ss")


def accounting_end(day: str) -> Column:
    """Two milliseconds before the start of the day given as yyyymmdd."""
    start = F.to_timestamp_ntz(F.lit(day), F.lit("yyyyMMdd"))
    return shift(start, "MILLISECOND", -2)
