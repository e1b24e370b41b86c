"""Time ranges and requests (F5, F6, F15 and their defaults)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import UTC, date, datetime, timedelta

from sitelens.functions.requests import BEACON_PATH

HOUR = 3_600_000
UNITS = {"h": HOUR, "d": 24 * HOUR, "w": 7 * 24 * HOUR}


@dataclass(frozen=True)
class TimeRange:
    """Milliseconds since the epoch; both ends count."""

    start: int
    end: int

    def __post_init__(self) -> None:
        if self.end < self.start:
            raise ValueError("a range ends before it starts")

    def days(self) -> list[date]:
        """The UTC days it touches."""
        first = datetime.fromtimestamp(self.start / 1000, UTC).date()
        last = datetime.fromtimestamp(self.end / 1000, UTC).date()
        return [first + timedelta(days=i) for i in range((last - first).days + 1)]


def _ms(moment: datetime) -> int:
    return round(moment.timestamp() * 1000)


def last(span: str, now: datetime) -> TimeRange:
    """'24h', '7d' or '2w' until now."""
    m = re.fullmatch(r"([1-9][0-9]*)([hdw])", span)
    if not m:
        raise ValueError(f"{span!r} is no span such as 24h, 7d or 2w")
    return TimeRange(_ms(now) - int(m[1]) * UNITS[m[2]], _ms(now))


def on_day(day: str) -> TimeRange:
    """A UTC day from midnight to the next midnight, which counts too."""
    start = datetime.fromisoformat(day).replace(tzinfo=UTC)
    return TimeRange(_ms(start), _ms(start + timedelta(days=1)))


def between(start: str, until: str) -> TimeRange:
    a, b = (datetime.fromisoformat(x) for x in (start, until))
    return TimeRange(*(_ms(x if x.tzinfo else x.replace(tzinfo=UTC)) for x in (a, b)))


def asked_span(now: datetime, last_: str | None = None, day: str | None = None, start: str | None = None, until: str | None = None) -> TimeRange:
    """One way of naming a span must be used, and both ends of an explicit one."""
    ways = [last_ is not None, day is not None, start is not None or until is not None]
    if sum(ways) != 1:
        raise ValueError("name one of: a relative span, a day, or a start and an end")
    if last_ is not None:
        return last(last_, now)
    if day is not None:
        return on_day(day)
    if start is None or until is None:
        raise ValueError("an explicit span needs both ends")
    return between(start, until)


CURRENT_MONTH = "current month"


@dataclass(frozen=True)
class Request:
    """What a question is asked with. ``span`` None means all rows given (windows are already cut)."""

    span: TimeRange | str | None = None
    include_bots: bool = False
    bot_agents: tuple[str, ...] = ()
    limit: int | None = 20
    param: str = "q"
    redirects: tuple[str, ...] = ("302", "303", "307")
    paths: tuple[str, ...] | None = None
    host: str | None = None
    countries: tuple[str, ...] | None = None
    rendered_only: bool | str = False
    #: For logs that a few senders flood: their rows are dealt over many tasks where visitors are looked up, at the price of counting senders first.
    spread_senders: bool = False

    def __post_init__(self) -> None:
        if isinstance(self.rendered_only, str) and not self.rendered_only.startswith("/"):
            raise ValueError("a beacon path starts with /")
        for c in self.countries or ():
            if not re.fullmatch("[A-Z]{2}", c):
                raise ValueError(f"{c!r} is no country of two capital letters")

    @property
    def beacon_path(self) -> str:
        return self.rendered_only if isinstance(self.rendered_only, str) else BEACON_PATH

    def on_beacon_path(self) -> Request:
        """Narrowed to the collection path unless paths are named; an empty list stays empty."""
        return self if self.paths is not None else replace(self, paths=(BEACON_PATH,))


def countries(names: Sequence[str]) -> tuple[str, ...]:
    return tuple(n.upper() for n in names)
