"""Trading sessions: calendar days of a zone that roll at a cutoff hour."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Boundary:
    """A session calendar: wall clock of tz; from cutoff_hour on (unless 0) it is the next day's session."""

    tz: str = "America/Chicago"
    cutoff_hour: int = 17

    def date(self, ts: Column | str) -> Column:
        return session_date(ts, self.tz, self.cutoff_hour)


CME = Boundary()
PRAGUE = Boundary("Europe/Prague", 0)


def session_date(ts: Column | str, tz: str, cutoff_hour: int = 0) -> Column:
    """The session day of an instant (session time zone UTC)."""
    local = F.from_utc_timestamp(F.col(ts) if isinstance(ts, str) else ts, tz)
    if cutoff_hour:
        local = local + F.make_interval(hours=F.lit(24 - cutoff_hour))
    return F.to_date(local)


def deadline(session: Column, hhmm: str, tz: str, early: dict[str, str] | None = None) -> Column:
    """The instant of the hard close of a session; early closes by ISO date come before it."""
    at = F.lit(hhmm)
    for day, t in sorted((early or {}).items()):
        at = F.when(session == F.lit(day).cast("date"), F.lit(min(t, hhmm))).otherwise(at)
    return F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", session.cast("string"), at), "yyyy-MM-dd HH:mm"), tz)


def localised(naive: Column, tz: str) -> Column:
    """The instant of a wall-clock time; null where the zone skips it or has it twice.

    naive holds the wall clock as if it were UTC. A resolved instant that doesn't show the wall time again means
    a gap; another instant half an hour or an hour off that shows it too means a fold.
    """
    u = F.to_utc_timestamp(naive, tz)
    shows = lambda x: F.from_utc_timestamp(x, tz) == naive
    step = lambda m: u + F.make_interval(mins=F.lit(m))
    twice = shows(step(30)) | shows(step(-30)) | shows(step(60)) | shows(step(-60))
    return F.when(shows(u) & ~twice, u)
