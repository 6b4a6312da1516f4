"""The trading clock.  Instants are LONG nanoseconds since the epoch, UTC; sessions are New York calendar dates.

The session time zone of Spark must be UTC (``timestamp_micros`` values are read as UTC wall time).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Trading time zone, regular hours in minutes of the day, nanoseconds of a minute.
ZONE = "America/New_York"
OPEN_MINUTE, CLOSE_MINUTE = 570, 960
MINUTE_NS = 60_000_000_000


def _div(a: Column, n: int) -> Column:
    """Floor division of a long."""
    return F.call_function("div", a - F.pmod(a, F.lit(n)), F.lit(n))


def eastern(ts_ns: Column) -> Column:
    """New York wall time."""
    return F.from_utc_timestamp(F.timestamp_micros(_div(ts_ns, 1000)), ZONE)


def session_date(ts_ns: Column) -> Column:
    return F.to_date(eastern(ts_ns))


def minute_of_day(ts_ns: Column) -> Column:
    et = eastern(ts_ns)
    return F.hour(et) * 60 + F.minute(et)


def minute_bucket(ts_ns: Column) -> Column:
    return _div(ts_ns, MINUTE_NS)


def day_bounds(day: Column) -> tuple[Column, Column]:
    """[start, end) of a New York day in nanoseconds; 23 or 25 hours on the days the clocks change."""

    def at(d):
        return F.unix_micros(F.to_utc_timestamp(d.cast("timestamp"), ZONE)) * 1000

    return at(day), at(F.date_add(day, 1))


def to_ns(ts: Column) -> Column:
    """Nanoseconds of a timestamp, exact to the microsecond."""
    return F.unix_micros(ts.cast("timestamp")) * 1000
