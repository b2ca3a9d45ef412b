"""When results expire: a small algebra of times.

never, immediately, `5 min` or `in 5 min` (also 5min), `at 12:30[:15] [CET]`, `on Tuesday`, EOD, EOW, EOM (end of day,
week or month), a date or time; several, separated by commas: the earliest.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta, timezone

from ..errors import EngineError

# Hours from UTC.
ZONES = {"UTC": 0, "GMT": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3}
# Seconds of the units of durations.
UNITS = {"ms": 0.001, "millisecond": 0.001, "s": 1, "sec": 1, "second": 1, "min": 60, "minute": 60, "h": 3600, "hr": 3600, "hour": 3600, "d": 86400, "day": 86400, "w": 604800, "week": 604800, "mo": 2592000, "month": 2592000}
# Names of days, further short ones besides their first three letters, and of periods.
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
SHORT_DAYS = {"tues": "tuesday", "thur": "thursday", "thurs": "thursday"}
_PERIODS = {"eod": "day", "end of day": "day", "eow": "week", "end of week": "week", "eom": "month", "end of month": "month"}


@dataclass(frozen=True, order=True)
class Expires:
    """kind: never, immediately, duration, time, weekday, end, at, first."""

    kind: str = "never"
    value: object = None
    zone: int | None = None

    def at(self, start: datetime, zone: int = 0) -> datetime | None:
        """When something that is ready at `start` expires; None for never. zone: hours from UTC where none is said."""
        local = start.astimezone(timezone(timedelta(hours=self.zone if self.zone is not None else zone)))
        midnight = local.replace(hour=0, minute=0, second=0, microsecond=0)
        match self.kind:
            case "never":
                return None
            case "immediately":
                return start
            case "duration":
                return start + timedelta(seconds=self.value)
            case "time":
                h, m, s = self.value
                then = midnight + timedelta(hours=h, minutes=m, seconds=s)
                return (then if then > local else then + timedelta(days=1)).astimezone(UTC)
            case "weekday":
                return (midnight + timedelta(days=(self.value - local.weekday() - 1) % 7 + 1)).astimezone(UTC)
            case "end":
                if self.value == "month":
                    return (midnight.replace(day=28) + timedelta(days=4)).replace(day=1).astimezone(UTC)
                return (midnight + timedelta(days=1 if self.value == "day" else 7 - local.weekday())).astimezone(UTC)
            case "at":
                return self.value
        return min((t for e in self.value if (t := e.at(start, zone)) is not None), default=None)

    @property
    def is_volatile(self) -> bool:
        return self.kind == "immediately" or self.kind == "first" and any(e.is_volatile for e in self.value)

    def __or__(self, other: Expires) -> Expires:
        return combined([self, other])

    def __str__(self) -> str:
        zone = next((f" {z}" for z, h in ZONES.items() if h == self.zone), "") if self.zone is not None else ""
        match self.kind:
            case "duration":
                n, unit = next((self.value / s, u) for u, s in (("days", 86400), ("hours", 3600), ("min", 60), ("s", 1), ("ms", 0.001)) if u == "ms" or self.value >= s and self.value % s == 0)
                return f"in {round(n)} {unit}"
            case "time":
                return f"at {self.value[0]:02}:{self.value[1]:02}" + f":{self.value[2]:02}" * bool(self.value[2]) + zone
            case "weekday":
                return f"on {DAYS[self.value].capitalize()}"
            case "end":
                return f"end of {self.value}"
            case "at":
                return self.value.strftime("%Y-%m-%dT%H:%M:%SZ")
            case "first":
                return ", ".join(map(str, self.value))
        return self.kind


NEVER, IMMEDIATELY = Expires(), Expires("immediately")


def combined(parts: list[Expires]) -> Expires:
    """The earliest of several: flat, each once, without `never`; `immediately` rules out all others."""
    flat = {e for p in parts for e in (p.value if p.kind == "first" else (p,)) if e.kind != "never"}
    if IMMEDIATELY in flat:
        return IMMEDIATELY
    shortest = min((e for e in flat if e.kind == "duration"), key=lambda e: e.value, default=None)
    flat = {e for e in flat if e.kind != "duration"} | ({shortest} if shortest else set())
    if len(flat) < 2:
        return next(iter(flat), NEVER)
    return Expires("first", tuple(sorted(flat, key=str)))


def parse_expires(text: str) -> Expires:
    parts = [p.strip() for p in text.split(",")]
    if not all(parts):
        raise EngineError("argument", f"empty expiration in {text!r}")
    return combined([_atom(p) for p in parts]) if len(parts) > 1 else _atom(parts[0])


def _atom(text: str) -> Expires:
    low = text.lower()
    if low in ("never", "immediately"):
        return Expires(low)
    if low in _PERIODS:
        return Expires("end", _PERIODS[low])
    if m := re.fullmatch(r"on\s+(\w+)", low):
        day = next((i for i, d in enumerate(DAYS) if SHORT_DAYS.get(m[1], m[1]) in (d, d[:3])), None)
        if day is None:
            raise EngineError("argument", f"{m[1]!r} isn't a day of the week")
        return Expires("weekday", day)
    if m := re.fullmatch(r"at\s+(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?(?:\s+(\S+))?", low):
        time = tuple(int(x or 0) for x in m.groups()[:3])
        if time[0] > 23 or time[1] > 59 or time[2] > 59:
            raise EngineError("argument", f"{text!r} isn't a time of day")
        return Expires("time", time, ZONES.get((m[4] or "").upper()))
    if (m := re.fullmatch(r"(?:in\s+)?(\d+)\s*([a-z]+)", low)) and (unit := UNITS.get(m[2], UNITS.get(m[2].removesuffix("s")))):
        return Expires("duration", int(m[1]) * unit)
    try:
        then = datetime.fromisoformat(text)
    except ValueError:
        raise EngineError("argument", f"{text!r} isn't an expiration") from None
    return Expires("at", then.replace(tzinfo=UTC) if then.tzinfo is None else then.astimezone(UTC))
