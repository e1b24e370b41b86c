"""A range answered out of stored windows, with the log for what is not stored (M1 to M10 in one plan).

A range is covered by stored days, stored hours and, if a log is given, by scans of it, at the least cost: the shortest path through the
hours of the range, where each stored window costs one read and each hour of log as much as ``LOG_HOUR`` reads. One DataFrame then adds up the stored windows and one
scan over all pieces of log.

Without a log, parts of hours at both ends drop out, windows that are missing at the ends are skipped and counted, and one that is missing between
others is refused. A missing day is its 24 hours, if all of these are stored. Narrowings that were not named are taken from
what is stored (see ``identity``); with a log, windows that were narrowed otherwise are read from it instead.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass, replace
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.operators.merge import added_up
from sitelens.operators.questions import Question
from sitelens.operators.rows import pruned, reranked, top
from sitelens.plans.identity import adopted, identity
from sitelens.plans.request import HOUR, Request, TimeRange
from sitelens.plans.windows import SIZES, WINDOW, Span
from sitelens.sources.stores import SummaryStore

#: What scanning an hour of log costs, in reads of a stored window.
LOG_HOUR = 50
DAY = SIZES["daily"]


@dataclass(frozen=True, order=True)
class Piece:
    """A part of a range, its end exclusive, and what answers it: daily, hourly, log or nothing."""

    start: int
    end: int
    source: str


def candidates(span: TimeRange) -> list[Span]:
    """Every whole hour and whole day inside a range."""
    end = span.end + 1
    return [Span(s, g) for g, size in SIZES.items() for s in range(-(-span.start // size) * size, end - size + 1, size)]


def cover(span: TimeRange, have: Collection[Span], log: bool = False, log_hour: float = LOG_HOUR) -> list[Piece]:
    """The cheapest pieces of a range, in order.

    Hours that nothing answers are pieces of nothing. A day costs what an hour does; of equal paths the one with fewer pieces of longer windows stands.
    """
    have, end = set(have), span.end + 1
    first, last = -(-span.start // HOUR) * HOUR, end // HOUR * HOUR
    if first > last:  # within an hour
        return [Piece(span.start, end, "log")] if log else []
    hours = (last - first) // HOUR
    lacking = log_hour if log else 1e9
    cost, step = [0.0] * (hours + 1), [("", 0)] * hours
    for i in reversed(range(hours)):
        at = first + i * HOUR
        ways = [(lacking + cost[i + 1], 2, "log" if log else "nothing", 1)]
        if Span(at, "hourly") in have:
            ways.append((1 + cost[i + 1], 1, "hourly", 1))
        if at % DAY == 0 and i + 24 <= hours and Span(at, "daily") in have:
            ways.append((1 + cost[i + 24], 0, "daily", 24))
        cost[i], _, *step[i] = min(ways)
    pieces, i = [], 0
    while i < hours:
        source, n = step[i]
        pieces.append(Piece(first + i * HOUR, first + (i + n) * HOUR, source))
        i += n
    if log:
        pieces = [Piece(span.start, first, "log"), *pieces, Piece(last, end, "log")]
    joined: list[Piece] = []
    for p in pieces:
        if p.start == p.end:
            continue
        if joined and p.source == joined[-1].source and p.source in ("log", "nothing"):
            joined[-1] = Piece(joined[-1].start, p.end, p.source)
        else:
            joined.append(p)
    return joined


def without_gaps(pieces: Sequence[Piece]) -> tuple[list[Piece], int]:
    """The pieces that have answers, and how many hours at the ends have none; hours without an answer between them are refused."""
    told = [k for k, p in enumerate(pieces) if p.source != "nothing"]
    if not told:
        raise ValueError("no stored window covers any whole hour of the range")
    inside = pieces[told[0] : told[-1] + 1]
    if holes := [p for p in inside if p.source == "nothing"]:
        hours = sum(p.end - p.start for p in holes) // HOUR
        raise ValueError(f"{hours} hours are missing between stored windows, the first from {holes[0].start}")
    return inside, sum(p.end - p.start for p in pieces if p.source == "nothing") // HOUR


def in_pieces(log: DataFrame, pieces: Sequence[Piece]) -> DataFrame:
    """Rows of pieces of log in one scan, each with the start of its piece as a window of granularity ``log``."""
    if len(pieces) == 1:
        rows = pruned(log, TimeRange(pieces[0].start, pieces[0].end - 1))
    else:
        rows = pruned(log, TimeRange(pieces[0].start, pieces[-1].end - 1))
        days = sorted({d.strftime("%Y-%m-%d") for p in pieces for d in TimeRange(p.start, p.end - 1).days()})
        if {"year", "month", "day"} <= set(log.columns):
            rows = rows.filter(F.concat_ws("-", "year", "month", "day").isin(*days))
        rows = rows.filter(reduce(lambda a, b: a | b, [F.col("ts_ms").between(p.start, p.end - 1) for p in pieces]))
    start = F.lit(pieces[0].start)
    for p in pieces[1:]:
        start = F.when(F.col("ts_ms") >= p.start, p.start).otherwise(start)
    return rows.withColumns({"granularity": F.lit("log"), "window_start": F.timestamp_millis(start)})


@dataclass(frozen=True)
class Answer:
    """Rows and how they came about."""

    rows: DataFrame
    pieces: tuple[Piece, ...]
    #: The request that was answered, and the narrowings that were taken from the store.
    request: Request
    taken: tuple[str, ...]
    #: The newest computation among the stored windows.
    computed_at: datetime | None
    #: Whole hours at the ends that nothing answers.
    skipped_hours: int

    @property
    def windows(self) -> int:
        """Stored windows that are read."""
        return sum(p.source in SIZES for p in self.pieces)

    @property
    def span(self) -> TimeRange:
        return TimeRange(self.pieces[0].start, self.pieces[-1].end - 1)


def _chosen(rows: Sequence[Mapping[str, Any]], own: Mapping[str, Any]) -> list[Mapping[str, Any]]:
    """One ledger row a window: that of the narrowing asked for, else the one written last."""
    best: dict[tuple, Mapping[str, Any]] = {}
    for r in sorted(rows, key=lambda r: (r["digest"] == own["digest"], r["written_at"])):
        best[r["granularity"], r["start"]] = r
    return list(best.values())


def answered(
    store: SummaryStore, name: str, question: Question, span: TimeRange, request: Request = Request(), named: Collection[str] = (),  # noqa: B008
    log: DataFrame | None = None, log_hour: float = LOG_HOUR,
) -> Answer:
    """The answer of the configured ``name`` over a range. ``named`` are the narrowings of ``request`` that were asked for on purpose."""
    own = identity(question, request)
    rows = store.entries(name, candidates(span))
    if log is not None:
        # What does not match is cheaper to scan than to refuse.
        deep = lambda r: not question.ranked or r["limit"] is None or (request.limit is not None and r["limit"] >= request.limit)
        rows = [r for r in rows if r["digest"] == own["digest"] and deep(r)]
    chosen = {Span(r["start"], r["granularity"]): r for r in _chosen(rows, own)}
    pieces, skipped = without_gaps(cover(span, chosen, log is not None, log_hour))
    if len(pieces) > 1 and not question.added:
        if log is None:
            raise ValueError(f"{name} does not combine over windows; ask for one window or a fresh answer")
        pieces = [Piece(span.start, span.end + 1, "log")]
    read = [chosen[Span(p.start, p.source)] for p in pieces if p.source in SIZES]
    request, taken = adopted(question, request, named, read) if read else (request, [])
    answer = lambda out: Answer(out, tuple(pieces), request, tuple(taken), max((r["computed_at"] for r in read), default=None), skipped)
    scanned = [p for p in pieces if p.source == "log"]
    if len(pieces) == 1 and scanned:
        return answer(question.answer(log, replace(request, span=TimeRange(pieces[0].start, pieces[0].end - 1))))
    parts = [store.of_entries(name, read).drop("computed_at")] if read else []
    if len(pieces) == 1:
        rows = parts[0].drop(*WINDOW)
        return answer(top(rows, question.added[0], list(question.keys), request.limit) if question.ranked and question.added else rows)
    if scanned:
        whole = question.answer(in_pieces(log, scanned), replace(request, span=None, limit=None), WINDOW)
        parts.append(whole)
    merged = added_up(reduce(lambda a, b: a.unionByName(b), parts), question)
    return answer(reranked(merged, question.added, list(question.keys), request.limit) if question.ranked else merged)
