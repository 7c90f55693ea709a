"""Column expressions over feed timestamps and time buckets (session time zone: UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ----------------------------------------------------------------------------
LOCAL_ZONE = "Asia/Kolkata"
SLOT_MINUTES = 15
CYCLE_MINUTES = 30
WINDOW_MINUTES = 180
# ---------------------------------------------------------------------------------------------


def parse_feed_timestamp(value: Column) -> Column:
    """``20260912T120000Z``, ``20260510120000`` or ISO text; fields past their range roll over."""
    v = F.trim(value)
    compact = r"^([0-9]{4})([0-9]{2})([0-9]{2})T?([0-9]{2})([0-9]{2})([0-9]{2})Z?$"

    def part(i: int) -> Column:
        return F.regexp_extract(v, compact, i).cast("int")

    year_start = F.make_date(part(1), F.lit(1), F.lit(1))
    day = F.date_add(F.add_months(year_start, part(2) - 1), part(3) - 1)
    seconds = part(4) * 3600 + part(5) * 60 + part(6)
    rolled = F.timestamp_seconds(F.unix_date(day).cast("long") * 86400 + seconds)
    return F.when(v.rlike(compact), rolled).otherwise(v.try_cast("timestamp"))


def feed_stamp(ts: Column) -> Column:
    """``YYYYMMDDHHMMSS`` form of a timestamp."""
    return F.date_format(ts, "yyyyMMddHHmmss")


def floor_minutes(ts: Column, minutes: int) -> Column:
    step = minutes * 60
    return F.timestamp_seconds(F.floor(F.unix_micros(ts) / (step * 1000000)).cast("long") * step)


def slot_start(ts: Column) -> Column:
    return floor_minutes(ts, SLOT_MINUTES)


def local_day(ts: Column) -> Column:
    """Calendar day in the feed's home time zone."""
    return F.to_date(F.from_utc_timestamp(ts, LOCAL_ZONE))


def local_day_bounds(day: str) -> tuple[Column, Column]:
    """UTC instants ``[start, end)`` of one calendar day in the home time zone."""
    start = F.to_utc_timestamp(F.lit(day).cast("timestamp"), LOCAL_ZONE)
    return start, start + F.expr("INTERVAL 24 HOURS")


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1000000.0
