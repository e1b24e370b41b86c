"""Tumbling windows, hourly and daily in UTC (T1 to T7, M1): which to compute, and computing many in one job."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.operators.questions import Question, visitors
from sitelens.operators.rows import pruned
from sitelens.plans.request import HOUR, Request, TimeRange

WINDOW = ["granularity", "window_start"]
SIZES = {"hourly": HOUR, "daily": 24 * HOUR}


@dataclass(frozen=True, order=True)
class Span:
    """A closed window: milliseconds, the end exclusive."""

    start: int
    granularity: str

    @property
    def end(self) -> int:
        return self.start + SIZES[self.granularity]


def recent(now: int, granularity: str, count: int = 2) -> list[Span]:
    """The windows that closed last, newest first; the open one is never among them."""
    size = SIZES[granularity]
    return [Span(now // size * size - k * size, granularity) for k in range(1, count + 1)]


def overlapping(span: TimeRange, granularity: str, now: int) -> list[Span]:
    """Every closed window that a range touches, oldest first (a backfill)."""
    size = SIZES[granularity]
    return [Span(s, granularity) for s in range(span.start // size * size, span.end + 1, size) if s + size <= now]


def coverage(span: TimeRange) -> list[Span]:
    """A range by whole windows: whole days as daily ones, whole hours around them; partial edges drop out."""
    day, end = SIZES["daily"], span.end + 1
    first, last = -(-span.start // HOUR) * HOUR, end // HOUR * HOUR
    d0, d1 = -(-first // day) * day, last // day * day
    if d0 >= d1:
        return [Span(s, "hourly") for s in range(first, last, HOUR)]
    return [
        *[Span(s, "hourly") for s in range(first, d0, HOUR)],
        *[Span(s, "daily") for s in range(d0, d1, day)],
        *[Span(s, "hourly") for s in range(d1, last, HOUR)],
    ]


def with_windows(log: DataFrame, granularities: Sequence[str] = ("hourly", "daily")) -> DataFrame:
    """Each row once per granularity, with the window it falls into (as a timestamp)."""
    each = [F.struct(F.lit(g).alias("granularity"), F.timestamp_millis(F.col("ts_ms") - F.pmod("ts_ms", F.lit(SIZES[g]))).alias("window_start")) for g in granularities]
    return log.withColumn("w", F.explode(F.array(*each))).select("*", "w.granularity", "w.window_start").drop("w")


def _only(log: DataFrame, spans: Iterable[Span]) -> DataFrame:
    """Rows of the wanted windows; the outer bounds prune directories and row groups first.

    Where days between them are not wanted, as when late rows touch old windows, their directories are not listed either.
    """
    spans = list(spans)
    outer = TimeRange(min(s.start for s in spans), max(s.end for s in spans) - 1)
    log = pruned(log, outer)
    days = {d.strftime("%Y-%m-%d") for s in spans for d in TimeRange(s.start, s.end - 1).days()}
    if len(days) < len(outer.days()) and {"year", "month", "day"} <= set(log.columns):
        log = log.filter(F.concat_ws("-", "year", "month", "day").isin(*sorted(days)))
    rows = with_windows(log, sorted({s.granularity for s in spans}))
    starts = {g: sorted({s.start for s in spans if s.granularity == g}) for g in SIZES}
    keep = F.lit(False)
    for g, wanted in starts.items():
        if not wanted:
            continue
        size, (low, high) = SIZES[g], (wanted[0], wanted[-1])
        at = F.unix_millis("window_start")
        whole = len(wanted) == (high - low) // size + 1
        keep |= (F.col("granularity") == g) & (at.between(low, high) if whole else at.isin(*wanted))
    return rows.filter(keep)


def compute(log: DataFrame, question: Question, request: Request, spans: Sequence[Span]) -> DataFrame:
    """The answer of a question for many windows in one job, with their granularity and start."""
    if not spans:
        raise ValueError("no windows to compute")
    return question.answer(_only(log, spans), request, WINDOW)


def compute_visitors(log: DataFrame, request: Request, spans: Sequence[Span], salts: DataFrame, split: bool = False) -> DataFrame:
    return visitors(_only(log, spans), request, salts, WINDOW, split)


def pending(spans: DataFrame, ledger: DataFrame) -> DataFrame:
    """Windows that no ledger row holds yet: what a resumed backfill still has to do (T5)."""
    return spans.join(ledger.select(*WINDOW), WINDOW, "left_anti")


def as_rows(spark, spans: Iterable[Span]) -> DataFrame:
    rows = [(s.granularity, s.start) for s in spans]
    frame = spark.createDataFrame(rows, "granularity string, ms long")
    return frame.select("granularity", F.timestamp_millis("ms").alias("window_start"))


@dataclass(frozen=True)
class Scheduled:
    """A question computed at a cadence with a narrowing of its own."""

    name: str
    question: Question
    granularity: str
    request: Request


def matrix(configured: Sequence[tuple[str, Question, Sequence[str], Request]]) -> list[Scheduled]:
    """Every question at each of its cadences; repeated names are refused."""
    names = [n for n, *_ in configured]
    if doubled := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"configured twice: {', '.join(doubled)}")
    return [Scheduled(n, q, g, r) for n, q, gs, r in configured for g in gs]


def due(now: datetime, lag_minutes: int = 15) -> int:
    """The instant up to which windows count as closed, given how late rows may come."""
    if not 0 <= lag_minutes <= 59:
        raise ValueError("a lag is 0 to 59 whole minutes")
    return round(now.astimezone(UTC).timestamp() * 1000) - lag_minutes * 60_000
