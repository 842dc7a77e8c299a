"""Clock columns from integer nanoseconds; keys stay integers, as Spark timestamps hold microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEW_YORK, CHICAGO = "America/New_York", "America/Chicago"
NANOS = 1_000_000_000


def instant(ns: Column) -> Column:
    """The timestamp of an epoch in nanoseconds, cut to microseconds."""
    return F.timestamp_micros(_micros(ns))


def _micros(ns: Column) -> Column:
    """Integer division toward minus infinity; no double is involved, as they can't hold epochs."""
    down = ns - F.pmod(ns, F.lit(1000).cast("long"))
    return F.call_function("div", down, F.lit(1000).cast("long"))


def wall(at: Column, zone: str) -> Column:
    """The wall clock of ``zone`` at a UTC timestamp."""
    return F.from_utc_timestamp(at, zone)


def clock_columns(ns: Column) -> dict[str, Column]:
    """dt, date (both UTC), dt_utc, dt_et and dt_ct."""
    at = instant(ns)
    return {"dt": at, "date": F.to_date(at), "dt_utc": at, "dt_et": wall(at, NEW_YORK), "dt_ct": wall(at, CHICAGO)}


def micros_of_day(at: Column) -> Column:
    return F.pmod(F.unix_micros(at), F.lit(86_400_000_000).cast("long"))


def of_day(clock: str) -> int:
    """Microseconds from midnight of hh:mm[:ss]."""
    h, m, *s = (int(x) for x in clock.split(":"))
    return ((h * 60 + m) * 60 + (s[0] if s else 0)) * 1_000_000


def in_session(at: Column, start: str = "09:30:00", end: str = "16:00:00") -> Column:
    """Whether a wall clock lies in the session; both ends belong to it."""
    return micros_of_day(at).between(of_day(start), of_day(end))
